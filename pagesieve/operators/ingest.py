"""Ingest transforms: from extracted texts and a file manifest to stored documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.blocks import page_spine
from pagesieve.functions.text import strip


def normalize_page_text(text: Column) -> Column:
    """Without surrounding whitespace; a page that could not be read is empty."""
    return strip(F.coalesce(text, F.lit("")))


def fold_image_text(meta: DataFrame, images: DataFrame) -> DataFrame:
    """Per page the non-empty image texts in image order, joined by a space; "" without images.

    The group is one page's images: its result is one text value.
    """
    texts = images.withColumn("text", normalize_page_text(F.col("text"))).filter("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("image_idx", "text")))
    folded = texts.groupBy("doc_id", "page").agg(ordered.alias("found")).select(
        "doc_id", "page", F.array_join(F.col("found.text"), " ").alias("text")
    )
    return (
        page_spine(meta.select("doc_id", "page_count"))
        .join(folded, ["doc_id", "page"], "left")
        .select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    )


def merged_text(ocr: Column, digital: Column) -> Column:
    """OCR text, a space, digital text, without surrounding whitespace."""
    return strip(F.concat(ocr, F.lit(" "), digital))


def merge_ocr_digital(ocr: DataFrame, digital: DataFrame) -> DataFrame:
    """Merge two channel tables page by page; a page missing on one side fails the query."""
    sides = ocr.withColumnRenamed("text", "ocr").join(
        digital.withColumnRenamed("text", "digital"), ["doc_id", "page"], "full_outer"
    )
    missing = F.col("ocr").isNull() | F.col("digital").isNull()
    text = F.when(missing, F.raise_error(F.lit("text lists must have the same length"))).otherwise(
        merged_text(F.col("ocr"), F.col("digital"))
    )
    return sides.select("doc_id", "page", text.alias("text"))


def assemble_pages(
    meta: DataFrame, channels: DataFrame, enable_digital: bool = True, enable_ocr: bool = True
) -> DataFrame:
    """Pages 1..page_count of every document with both channels; what is missing or disabled is ""."""

    def channel(name: str, enabled: bool) -> Column:
        return (F.coalesce(name, F.lit("")) if enabled else F.lit("")).alias(name)

    return (
        page_spine(meta.select("doc_id", "page_count"))
        .join(channels, ["doc_id", "page"], "left")
        .select("doc_id", "page", channel("digital", enable_digital), channel("ocr", enable_ocr))
    )


def build_metadata(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest rows with the number of pages found and the time of processing."""
    counts = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    return manifest.join(counts, "doc_id", "left").withColumns({
        "page_count": F.coalesce("page_count", F.lit(0)),
        "processing_date": F.current_timestamp(),
    })


def change_status(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``status``: new, no_stored_hash, changed or unchanged."""
    known = stored.select("doc_id", F.col("file_hash").alias("stored_hash"), F.lit(True).alias("known"))
    status = (
        F.when(F.col("known").isNull(), "new")
        .when(F.coalesce("stored_hash", F.lit("")) == "", "no_stored_hash")
        .when(F.col("stored_hash") == F.col("file_hash"), "unchanged")
        .otherwise("changed")
    )
    return manifest.join(known, "doc_id", "left").withColumn("status", status).drop("stored_hash", "known")


def to_process(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    return change_status(manifest, stored).filter("status <> 'unchanged'").drop("status")


def channel_flags() -> dict[str, Column]:
    """Aggregates over page rows: which channels were extracted at all."""
    return {f"has_{c}": F.coalesce(F.max(F.col(c).isNotNull()), F.lit(False)) for c in ("digital", "ocr")}


def to_store(files: DataFrame, stored: DataFrame) -> DataFrame:
    """What a run has to write: files with new content, and known content that brings another channel.

    ``files`` has page_count, has_digital and has_ocr of what was extracted. ``since`` is null for new content;
    for known content it is that of the stored document, whose pages stay.
    """
    status = change_status(files, stored)
    before = stored.select(
        "doc_id",
        F.col("since").alias("since"),
        F.col("page_count").alias("_pages"),
        F.coalesce("has_digital", F.lit(False)).alias("_digital"),
        F.coalesce("has_ocr", F.lit(False)).alias("_ocr"),
    )
    known = F.col("status") == "unchanged"
    adds = (F.col("has_digital") & ~F.col("_digital")) | (F.col("has_ocr") & ~F.col("_ocr"))

    def kept(name: str, merged: Column) -> Column:
        return F.when(known, merged).otherwise(F.col(name)).alias(name)

    rows = status.join(before, "doc_id", "left").filter(~known | adds)
    return rows.withColumns({
        "since": F.when(known, F.col("since")),
        "page_count": kept("page_count", F.greatest("page_count", "_pages")),
        "has_digital": kept("has_digital", F.col("has_digital") | F.col("_digital")),
        "has_ocr": kept("has_ocr", F.col("has_ocr") | F.col("_ocr")),
        "processing_date": F.current_timestamp(),
    }).drop("status", "_pages", "_digital", "_ocr")


def resume_filter(
    manifest: DataFrame, log: DataFrame, skip_existing: bool = True, by_name_only: bool = False
) -> DataFrame:
    """Files not yet completed. By default a file with new content counts as not completed."""
    if not skip_existing:
        return manifest
    keys = ["file_name"] if by_name_only else ["file_name", "file_hash"]
    return manifest.join(log.filter("success").select(*keys), keys, "left_anti")


def append_log(log: DataFrame, results: DataFrame) -> DataFrame:
    """Completed files once each, failures every time."""
    rows = log.unionByName(results)
    completed = rows.filter("success").dropDuplicates(["file_name", "file_hash"])
    return completed.unionByName(rows.filter("not success"))


def ingest_summary(log: DataFrame) -> DataFrame:
    """Files, successes, failures, and pages of the successful files."""
    return log.agg(
        F.count("*").alias("total_files"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("pages_processed"))), F.lit(0)).alias("total_pages"),
    )


def failed_files(log: DataFrame) -> DataFrame:
    return log.filter("not success").select("file_name", "error")
