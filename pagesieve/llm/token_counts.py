"""Token counts: an exact histogram of encoded lengths, and sums over its tail for every context limit.

Documents are encoded and counted by length; the histogram has one row for each length that occurs. For a
limit c, the documents longer than c keep c tokens and the others all: sums from either end of the
histogram give that for every c. The sums run in two steps, within bands of lengths
and over the totals of bands, so no task holds the whole histogram however long it gets.

Defined cases: a null or empty text has zero tokens and is counted at length 0; an empty table gives an empty
histogram, no quantiles and no truncated totals; columns other than the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.llm.byte_bpe import count_tokens
from pagesieve.llm.tables import cut

#: Lengths in a band, the most rows that a task has to put in order; lengths up to a million make 8,192 bands.
BAND = 128


def length_histogram(docs: DataFrame, rank_path: str, column: str = "text") -> DataFrame:
    """n_tokens and n_docs: the documents of each encoded length."""
    lengths = count_tokens(docs.select(column), rank_path, column)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def _upto(total: Column, window: Window) -> Column:
    return F.coalesce(F.sum(total).over(window), F.lit(0)).cast("long")


def limits(histogram: DataFrame, asked: Sequence[int] = (), shares: Sequence[float] = ()) -> DataFrame:
    """For each length that occurs, and each of the limits `asked`, as a context limit: what fits, what is longer, what remains when cut.

    Columns: n_tokens, n_docs, docs_upto (documents not longer), docs_over, tokens_upto, tokens_over (all
    tokens of the longer documents), truncated_total (all tokens when each document is cut at this limit). A limit that
    does not occur as a length has n_docs 0. With `shares`, quantile_of lists those of which this length is the quantile: the
    least one that at least this share of all documents does not exceed. An empty histogram gives the limits asked for, all zero.
    """
    if asked:
        wanted = F.explode(F.array(*[F.lit(n).cast("long") for n in asked])).alias("n_tokens")
        added = histogram.sparkSession.range(1).select(wanted, F.lit(0).cast("long").alias("n_docs"))
        histogram = histogram.select(F.col("n_tokens").cast("long"), "n_docs").unionByName(added)
        histogram = histogram.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = cut(histogram).withColumn("band", F.floor(F.col("n_tokens") / BAND))
    # One row for each band meets in one task; their number is the greatest length divided by the band's width.
    bands = rows.groupBy("band").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select(
        "band",
        _upto(F.col("docs"), before).alias("docs_before"),
        _upto(F.col("tokens"), before).alias("tokens_before"),
        F.sum("docs").over(all_).alias("docs_all"),
        F.sum("tokens").over(all_).alias("tokens_all"),
    )
    within = Window.partitionBy("band").orderBy("n_tokens")
    sums = (
        rows.select("*", _upto(F.col("n_docs"), within).alias("d"), _upto(tokens, within).alias("t"))
        .join(bands, "band")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("docs_before") + F.col("d")).alias("docs_upto"),
            (F.col("docs_all") - F.col("docs_before") - F.col("d")).alias("docs_over"),
            (F.col("tokens_before") + F.col("t")).alias("tokens_upto"),
            (F.col("tokens_all") - F.col("tokens_before") - F.col("t")).alias("tokens_over"),
        )
        .withColumn("truncated_total", F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_over"))
    )
    if not shares:
        return sums
    docs = F.col("docs_upto") + F.col("docs_over")

    def here(share: float) -> Column:
        least = F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * docs))
        return F.when((F.col("docs_upto") >= least) & (F.col("docs_upto") - F.col("n_docs") < least), F.lit(float(share)))

    return sums.withColumn("quantile_of", F.array_compact(F.array(*[here(s) for s in shares])))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that remain when each document is cut at `limit`, which need not occur as a length.

    `sums` is the result of `limits`; the row of the next smaller length has all that is needed.
    """
    below = F.struct("n_tokens", "tokens_upto", "docs_over")
    last = F.max(F.when(F.col("n_tokens") <= limit, below))
    everything = F.max(F.col("docs_upto"))
    return sums.agg(last.alias("last"), everything.alias("docs")).select(
        F.lit(limit).cast("long").alias("limit"),
        F.coalesce(
            F.col("last.tokens_upto") + limit * F.col("last.docs_over"), limit * F.coalesce("docs", F.lit(0))
        ).alias("truncated_total"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least this share of all documents does not exceed."""
    docs = F.col("docs_upto") + F.col("docs_over")
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    reached = F.min(F.when(F.col("docs_upto") >= F.ceil(F.col("share") * docs), F.col("n_tokens")))
    return sums.select("*", wanted).groupBy("share").agg(reached.alias("n_tokens"))
