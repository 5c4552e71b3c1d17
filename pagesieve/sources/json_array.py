"""JSON arrays of objects, read by many tasks.

A file is read in pieces that end at each opening brace, by as many tasks as it has splits. Whether a piece begins within a string
depends on all quotes before it, and its depth on all brackets before it outside of strings. Both compose: every piece, and every split, is
summed up for either state at its start, and sums over the splits before tell which of the two holds. Then each piece knows the
object it belongs to. The one window over a whole file has one narrow row for each split.

An object may span pieces and splits; it is put together in one row, so only a single object must fit into a task. Several arrays in
one file, one after the other, count as one. What stands between the objects (numbers, strings, nulls) is passed over. An empty file
or array gives no rows; an object that is broken, or cut off, is a row of nulls, as Spark's reader has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _brackets(text: Column) -> Column:
    """Opened less closed brackets; opening braces are the ends of pieces and not within them."""
    return F.length(F.regexp_replace(text, r"[^\[]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of all files in order (``file``, ``start`` of the split, ``k``), with what each one adds to quotes and depth."""
    rows = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("k"),
        "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside = F.regexp_replace("plain", r'"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace("plain", r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    return rows.withColumn("plain", plain).select(
        "file", "start", "k", "value",
        (F.length(F.regexp_replace("plain", r'[^"]', "")) % 2).alias("quotes"),
        _brackets(outside).alias("outside"),
        _brackets(inside).alias("inside"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``quoted`` (begins within a string) and ``depth`` of brackets, both before the brace that a piece follows."""
    split = Window.partitionBy("file", "start").orderBy("k")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    # The brace between two pieces belongs to the later one; only the first piece of a file has none.
    brace = F.when((F.col("start") == 0) & (F.row_number().over(split) == 1), 0).otherwise(1)
    pieces = pieces.select("*", odd.alias("odd"), brace.alias("brace"))
    # What a piece adds if its split begins outside (0) or within a string (1).
    adds = [
        F.when(F.col("odd") == state, F.col("brace") + F.col("outside")).otherwise(F.col("inside")) for state in (0, 1)
    ]
    pieces = pieces.select("*", *[a.alias(f"add{s}") for s, a in enumerate(adds)])
    pieces = pieces.select("*", *[F.coalesce(F.sum(f"add{s}").over(before), F.lit(0)).alias(f"sum{s}") for s in (0, 1)])
    splits = pieces.groupBy("file", "start").agg(
        (F.sum("quotes") % 2).alias("q"), F.sum("add0").alias("all0"), F.sum("add1").alias("all1")
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("*", (F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2).alias("state"))
    gone = F.when(F.col("state") == 0, F.col("all0")).otherwise(F.col("all1"))
    splits = splits.select("file", "start", "state", F.coalesce(F.sum(gone).over(earlier), F.lit(0)).alias("base"))
    summed = F.when(F.col("state") == 0, F.col("sum0")).otherwise(F.col("sum1"))
    return pieces.join(splits, ["file", "start"]).select(
        "file", "start", "k", "value", "brace",
        (F.col("odd") != F.col("state")).alias("quoted"),
        (F.col("base") + summed).alias("depth"),
    )


def read_array(spark: SparkSession, path: str, schema: str, into: str = "seq") -> DataFrame:
    """The objects of the JSON array(s) at ``path`` as rows of ``schema``; column ``into`` has their order by file and place."""
    split = Window.partitionBy("file", "start").orderBy("k")
    begins = ((F.col("brace") == 1) & ~F.col("quoted") & (F.col("depth") == 1)).cast("int")
    rows = _placed(_pieces(spark, path)).select("*", begins.alias("begins"))
    rows = rows.withColumn("nth", F.sum("begins").over(split))
    # Objects that began before a split, in all files: one narrow row for each split again.
    order = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "start").agg(F.sum("begins").alias("n"))
    splits = splits.select("file", "start", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier"))
    rows = rows.join(splits, ["file", "start"]).select(
        "file", (F.col("earlier") + F.col("nth")).alias("seq"), F.struct("start", "k", "value", "begins").alias("piece")
    )
    # The text before the first object of a file falls to the last one of the file before, or to none: it has no brace.
    text = F.concat_ws("{", F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["value"]))
    objects = rows.groupBy("file", "seq").agg(F.max("piece.begins").alias("whole"), text.alias("text")).filter("whole = 1")
    return objects.select("seq", F.from_json(F.concat(F.lit("{"), "text"), schema).alias("o")).select("o.*", F.col("seq").alias(into))
