"""Exported detections and analysis results as JSON lines; reports as Parquet or CSV, also in order and numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.functions.frames import join_checked
from pagesieve.schemas import DETECTION
from pagesieve.session import work_folder
from pagesieve.sources.json_array import read_array


def as_exported(detections: DataFrame, *more: str) -> DataFrame:
    """The seven exported fields of listed detections."""
    return detections.select(
        "table_name",
        F.col("doc_id").cast("string").alias("document_name"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        "found",
        "pages_found",
        "confidence_score",
        "match_details",
        *more,
    )


def export_detections(detections: DataFrame, path: str) -> None:
    as_exported(detections).write.mode("overwrite").json(path)


def export_parts(parts: DataFrame, path: str) -> None:
    """Write the rows of ``listed_parts`` with file paths: objects of bounded size, told apart by ``part`` and ``seq``."""
    as_exported(parts, "seq", "part").write.mode("overwrite").json(path)


def export_part_arrays(parts: DataFrame, path: str) -> None:
    """The same as JSON arrays of one object, one after the other: a file of any size without line ends between its rows."""
    row = as_exported(parts, "seq", "part")
    row.select(F.to_json(F.array(F.struct(*row.columns)))).write.mode("overwrite").option("lineSep", " ").text(path)


def load_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read parts back: one row per detection without its pages, and the flat rows of all pages."""
    rows = spark.read.schema(f"{DETECTION}, seq bigint, part int").json(path)
    heads = rows.filter("part = 0").drop("pages_found", "match_details", "part")
    return heads, rows.select("document_name", "table_name", F.explode("pages_found").alias("page"), "seq")


def load_detections(
    spark: SparkSession, path: str, min_confidence: float | None = None, multi_line: bool = False
) -> DataFrame:
    """Read exported detections back; ``multi_line`` for JSON arrays, which many tasks read whatever their size.

    ``seq`` keeps the order of the rows in the files.
    """
    if multi_line:
        rows = read_array(spark, path, DETECTION)
    else:
        rows = spark.read.schema(DETECTION).json(path).withColumn("seq", F.monotonically_increasing_id())
    rows = rows.withColumn("file_path", F.coalesce("file_path", F.lit("")))
    return rows if min_confidence is None else at_least(rows, min_confidence)


def at_least(detections: DataFrame, min_confidence: float) -> DataFrame:
    """Detections of at least this confidence."""
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must be between 0 and 1")
    return detections.filter(F.col("confidence_score") >= min_confidence)


def write_frames(frames: dict[str, DataFrame], root: str, file_format: str = "parquet") -> dict[str, str]:
    """Write each frame below ``root``; returns the paths by name."""
    paths = {}
    for name, frame in frames.items():
        path = f"{root.rstrip('/')}/{name}"
        writer = frame.write.mode("overwrite").format(file_format)
        if file_format == "csv":
            writer = writer.option("header", True)
        writer.save(path)
        paths[name] = path
    return paths


#: Rows of a numbered part, less than the 1,048,576 of a sheet.
PART_ROWS = 1_000_000


def write_ordered(frame: DataFrame, path: str, keys: list[str], part_rows: int = PART_ROWS, file_format: str = "parquet") -> None:
    """Write ``frame`` in the order of ``keys`` with ``row`` (from 0) and ``part``, one file for each part of ``part_rows`` rows.

    Rows are dealt by ranges of the keys and written; the counts of the ranges then number them, so no task holds more than a range or
    a part. Nulls come first; rows with equal keys follow one another in any order, so keys should be unique.
    """
    spark = frame.sparkSession
    ranged = work_folder(spark, "ranged")
    place = F.monotonically_increasing_id()
    (
        frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select("*", F.shiftright(place, 33).alias("range_no"), place.bitwiseAND((1 << 33) - 1).alias("range_row"))
        .write.parquet(ranged)
    )
    rows = spark.read.parquet(ranged)
    counts = rows.groupBy("range_no").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = counts.select("range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("range_first"))
    row = F.col("range_first") + F.col("range_row")
    numbered = (
        join_checked(rows, counts, "range_no")
        .select(*frame.columns, row.alias("row"), F.call_function("div", row, F.lit(part_rows)).alias("part"))
        .repartition("part").sortWithinPartitions("part", "row")
    )
    writer = numbered.write.mode("overwrite").partitionBy("part").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
