"""File manifest: one row per input file with size, time and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """The files of one folder (not its subfolders) as path, modificationTime, length, content.

    Spark lists no files of zero length; such a file could not be opened as a document either.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def file_manifest(files: DataFrame) -> DataFrame:
    """doc_id is the file name without its extension; the hash is always taken from the content."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(
        F.regexp_replace(name, "(?<=.)\\.[^.]*$", "").alias("doc_id"),
        name.alias("file_name"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").cast("double").alias("last_modified"),
        F.md5("content").alias("file_hash"),
    )
