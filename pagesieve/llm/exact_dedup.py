"""Exact deduplication: two passes of a Bloom filter, and only possible repeats are shuffled.

Two texts are equal when they are identical after all characters of `[\\x20\\x09-\\x0D]` are deleted.
The first pass builds a filter of the bits that at least two hashes set. The second one probes
it with each row: a row with a bit that no other row sets is unique and passes straight
through; only the others are grouped by their hash. A false alarm of the filter is a group of one row.

A filter holds `MOST_WORDS` words of 64 bits and so serves `FILL` rows a word at most, by which about one unique row in 120 is a false alarm.
More rows are taken in rounds: the hashes are written once more in folders by a part of the hash, without a shuffle, and
each round builds and probes a filter for one folder.

Defined cases: a null text counts as empty, and all empty texts are equal; of equal texts the one
with the most code points stays, among those the smallest `doc_id`; a null `doc_id` comes after all
others; rows that repeat a `doc_id` with an equal text are copies with one `keep_id` and are marked alike. An
empty table gives an empty result. Columns other than `doc_id` and `text` are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm import bloom
from pagesieve.llm.tables import cut
from pagesieve.session import work_folder

#: Words of a filter (128 MB as it is broadcast), and rows for each of them.
MOST_WORDS = 1 << 24
FILL = 4

SPACES = "[\\x20\\x09-\\x0D]"


def text_hash(text: Column) -> Column:
    """SHA-256 of the text without white space, lowercase hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", "").cast("binary"), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and length in code points, written once, as both passes read them."""
    return cut(
        docs.select(
            "doc_id",
            text_hash(F.col("text")).alias("text_sha256"),
            F.coalesce(F.length("text"), F.lit(0)).alias("n"),
        )
    )


def possible_repeats(rows: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """The `rows` of `fingerprints` with the boolean maybe: whether another row may have the same hash; written."""
    key, n = F.col("text_sha256"), rows.count()
    rounds = max(1, -(-n // (FILL * most_words)))
    parts = [rows]
    if rounds > 1:
        path = work_folder(rows.sparkSession, "dedup-rounds")
        rows.withColumn("round", F.pmod(F.xxhash64(key, F.lit(2)), F.lit(rounds))).write.partitionBy("round").parquet(path)
        written = rows.sparkSession.read.parquet(path)
        parts = [written.filter(F.col("round") == r).drop("round") for r in range(rounds)]
    words = bloom.words_for(-(-n // rounds), min(bloom.WORDS, most_words), most_words)
    # Each round is written before the next begins, so one filter is in memory at a time.
    seen = []
    for part in parts:
        twice = cut(bloom.packed(bloom.build(part, key, words, least=2), words))
        seen.append(cut(bloom.probe_packed(part, key, twice, "maybe", words)))
    return reduce(DataFrame.unionByName, seen)


def exact_dedup(docs: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    seen = possible_repeats(fingerprints(docs), most_words)
    unique = seen.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    again = seen.filter("maybe").select("doc_id", "text_sha256", "n")
    # Both sides of the join are written tables, so a group with a large share of all rows can be split.
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id"))
    groups = cut(again.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    groups = groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    repeated = again.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return unique.unionByName(repeated)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all columns as they are: the one with most code points, then the smallest doc_id.

    Ids may repeat and may be null: rows are told apart by their text. Rows whose id is in no group of two or more pass where they are,
    by a filter of the ids in such groups; of the others the texts are hashed again and joined with what stays. Only rows that agree in
    text, length and id with the one that stays are grouped themselves, to keep one of them.
    """
    again = possible_repeats(fingerprints(docs)).filter("maybe").drop("maybe")
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id")
    groups = again.groupBy("text_sha256").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
    groups = cut(groups.filter("size > 1").select("text_sha256", "best"))
    involved = cut(again.join(groups, "text_sha256").select("text_sha256", "best", order.alias("own"), "doc_id"))
    copies = involved.filter("own = best").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    groups = cut(groups.join(copies, "text_sha256"))
    # A null id counts as involved as soon as any is.
    ids = involved.select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("id")).distinct()
    ids = cut(ids)
    words = bloom.words_for(ids.count())
    maybe, row = "maybe", F.struct(*docs.columns).alias("row")
    packed = docs.select(row, "doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("id"), "text")
    marked = bloom.probe(packed, F.col("id"), cut(bloom.build(ids, F.col("id"), words)), maybe, words)
    stay = marked.filter(~F.col(maybe)).select("row.*")
    asked = marked.filter(maybe).select(
        "row", "doc_id", text_hash(F.col("text")).alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).alias("n")
    )
    judged = asked.join(groups, "text_sha256", "left").withColumn("own", order)
    judged = judged.filter(F.col("best").isNull() | (F.col("own") == F.col("best")))
    single = judged.filter("copies is null or copies = 1").select("row.*")
    same = judged.filter("copies > 1").groupBy("text_sha256").agg(F.first("row").alias("row")).select("row.*")
    return stay.unionByName(single).unionByName(same)
