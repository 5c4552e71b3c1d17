"""Small helpers on whole DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but each expression is evaluated once per row.

    A projected expression is copied into the filters that are pushed below it and into
    every element access on an array it builds, which would scan the page text again each
    time. What a generator puts out is never copied; the outer form gives exactly one row
    and, unlike the inner form, no extra filter on its input is derived.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def one_row(*totals: DataFrame) -> DataFrame:
    """Single-row totals side by side in one row, without a join."""
    columns = [c for t in totals for c in t.columns]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), totals)
    return rows.agg(*[F.max(c).alias(c) for c in columns])


#: A side of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 50_000


def join_checked(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a narrow ``side``: broadcast if its rows, counted first, are few, so that ``df`` stays where it is.

    Of a longer side each task holds its share by hash, so that the rows of ``df`` are dealt out but not sorted.
    """
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if few else side.hint("shuffle_hash"), on, how)
