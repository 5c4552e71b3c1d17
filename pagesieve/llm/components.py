"""Connected components of a graph given by its links, by contraction with pointer jumping.

In each round every id points to its least smaller neighbour; pointers are followed to their ends, the links are rewritten
to these ends, and those within one end are gone. The rounds end when no link is left; long
chains collapse in one round, as pointers double their reach with each hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.tables import cut, join_checked


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the least id reachable) of all ids that occur in `links`; nulls link nothing."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    pairs = cut(_ordered(pairs))
    labels = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = cut(labels.select("id", F.col("id").alias("component")))
    while not pairs.isEmpty():
        up = cut(pairs.groupBy("b").agg(F.min("a").alias("p")))
        while True:
            hop = join_checked(up, up.select(F.col("b").alias("p"), F.col("p").alias("q")), "p", "left")
            hop = cut(hop.select("b", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            up = hop.select("b", "p")
            if hop.filter("moved").isEmpty():
                break
        labels = cut(_moved(labels, up, "component"))
        pairs = _moved(_moved(pairs, up, "a"), up, "b")
        pairs = cut(_ordered(pairs))
    return labels


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _moved(df: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """`df` with the ids in `column` replaced by what they point to."""
    joined = join_checked(df, up.select(F.col("b").alias(column), F.col("p").alias("__to")), column, "left")
    return joined.select(*[F.coalesce("__to", column).alias(column) if c == column else c for c in df.columns])
