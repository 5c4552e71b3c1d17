"""Blocked Bloom filters as small tables of 64-bit words, built and probed by SQL functions alone.

A key sets three bits of one word. A filter has at most `words` rows, whatever it holds, which
is what allows a broadcast: 65,536 rows of two longs are about one megabyte. A fuller filter
lets more keys through, never fewer, so results that recheck its answers stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.tables import cut, free_name

WORDS = 1 << 16
MOST_WORDS = 1 << 20
BITS = 3


def words_for(rows: int, least: int = WORDS, most: int = MOST_WORDS) -> int:
    """Words enough for four keys each, within the bound that keeps a filter fit for broadcast."""
    words = least
    while words < rows // 4 and words < most:
        words *= 2
    return words


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _bits(key: Column) -> list[Column]:
    picked = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(picked, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BITS)]


def build(keys: DataFrame, key: Column, words: int = WORDS, least: int = 1) -> DataFrame:
    """The filter (word, bits) of the keys of all rows; `least` 2 keeps only bits that two rows set.

    A row sets its distinct bits only, so that no single row sets a bit twice.
    """
    bits = F.array_distinct(F.array(*_bits(key)))
    return (
        keys.select(_word(key, words).alias("word"), F.explode(bits).alias("bit"))
        .groupBy("word", "bit")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )


def probe(df: DataFrame, key: Column, filter_: DataFrame, flag: str, words: int = WORDS) -> DataFrame:
    """All rows of `df` with the boolean `flag`: whether the filter may hold the row's key.

    The filter has at most `words` rows, so it is broadcast and the rows of `df` stay where they are.
    """
    word, bits, need, at = (free_name(df, f"__{c}") for c in ("word", "bits", "need", "at"))
    held = F.broadcast(filter_.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    mask = None
    for bit in _bits(key):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        mask = one if mask is None else mask.bitwiseOR(one)
    marked = df.withColumns({need: mask, at: _word(key, words)})
    joined = marked.join(held, F.col(at) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(need)) == F.col(need), F.lit(False))
    return joined.withColumn(flag, hit).drop(need, at, word, bits)


#: Words in one row of a packed filter.
PER_ROW = 512


def packed(filter_: DataFrame, words: int) -> DataFrame:
    """The filter as rows of `PER_ROW` words each, eight bytes a word: a 2 ** 24 word filter is 128 MB to broadcast."""
    none = filter_.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = filter_.select("word", "bits").unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    at = F.expr(f"word div {PER_ROW}").alias("at")
    lists = whole.groupBy(at).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return lists.select("at", F.col("held.bits").alias("bits"))


def probe_packed(df: DataFrame, key: Column, filter_: DataFrame, flag: str, words: int) -> DataFrame:
    """As `probe`, by a packed filter."""
    row, bits, need, word = (free_name(df, f"__{c}") for c in ("row", "bits", "need", "word"))
    held = F.broadcast(filter_.select(F.col("at").alias(row), F.col("bits").alias(bits)))
    mask = None
    for bit in _bits(key):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        mask = one if mask is None else mask.bitwiseOR(one)
    marked = df.withColumns({need: mask, word: _word(key, words)})
    joined = marked.join(held, F.expr(f"`{word}` div {PER_ROW}") == F.col(row), "left")
    one = F.get(F.col(bits), (F.col(word) % PER_ROW).cast("int"))
    hit = F.coalesce(one.bitwiseAND(F.col(need)) == F.col(need), F.lit(False))
    return joined.withColumn(flag, hit).drop(need, word, row, bits)


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of `df` whose `column` is not among the values in `gone`, a table of that one column.

    A filter of the values that go lets most rows that stay pass where they are; only the others are joined.
    """
    key, maybe = free_name(df, "__gone"), free_name(df, "__maybe")
    gone = cut(gone.select(F.col(column).alias(key)).dropna().distinct())
    words = words_for(gone.count())
    marked = probe(df, F.col(column), cut(build(gone, F.col(key), words)), maybe, words)
    stay = marked.filter(~F.col(maybe)).drop(maybe)
    asked = marked.filter(F.col(maybe)).drop(maybe)
    return stay.unionByName(asked.join(gone, asked[column] == F.col(key), "left_anti"))
