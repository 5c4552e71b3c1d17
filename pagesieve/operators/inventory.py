"""Inventory reports over the store.

Lengths and previews are taken before any join, so page texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.blocks import join_documents, page_spine
from pagesieve.functions.frames import one_row
from pagesieve.functions.numbers import fixed, round_even
from pagesieve.functions.text import sanitize

MISSING = "N/A"


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def _short_hash(length: int) -> Column:
    known = F.coalesce("file_hash", F.lit("")) != ""
    return F.when(known, F.concat(F.substring("file_hash", 1, length), F.lit("..."))).otherwise(MISSING)


def document_overview(meta: DataFrame) -> DataFrame:
    """One row per document; what is missing reads N/A."""
    present = set(meta.columns)
    shown = ["file_name", "file_path", "page_count", "file_size"]
    dates = [c for c in ("processing_date", "last_modified") if c in present]
    return meta.select(
        "doc_id",
        *[_shown(c).alias(c) for c in shown],
        _short_hash(16).alias("file_hash"),
        *[_shown(c).alias(c) for c in dates],
    )


def channel_text_report(meta: DataFrame, channels: DataFrame, channel: str) -> DataFrame:
    """Non-empty pages of one channel (``digital`` or ``ocr``): report text and raw length."""
    text = F.col(channel)
    pages = channels.filter(text != "").select(
        "doc_id", "page", sanitize(text).alias("text"), F.length(text).alias("text_length")
    )
    return join_documents(pages, meta.select("doc_id", "page_count", "file_name")).select(
        "doc_id", "page", "text", "text_length", _shown("file_name").alias("file_name")
    )


def _length(channel: str) -> Column:
    return F.coalesce(F.length(channel), F.lit(0))


def page_lengths(meta: DataFrame, channels: DataFrame) -> DataFrame:
    """Every page 1..page_count with the length of both channels, empty pages included."""
    lengths = channels.select(
        "doc_id", "page", F.length("digital").alias("digital"), F.length("ocr").alias("ocr")
    )
    documents = meta.select("doc_id", "page_count", "file_name")
    return page_spine(documents).join(lengths, ["doc_id", "page"], "left").select(
        "doc_id",
        "page",
        _shown("file_name").alias("file_name"),
        F.coalesce("digital", F.lit(0)).alias("digital_length"),
        F.coalesce("ocr", F.lit(0)).alias("ocr_length"),
    )


def combined_page_report(meta: DataFrame, channels: DataFrame, preview: int = 200) -> DataFrame:
    """Every page with lengths, flags and a short preview of each channel."""

    def seen(channel: str) -> Column:
        return sanitize(F.substring(channel, 1, preview))

    short = channels.select(
        "doc_id", "page",
        F.length("digital").alias("digital"), F.length("ocr").alias("ocr"),
        seen("digital").alias("digital_preview"), seen("ocr").alias("ocr_preview"),
    )
    lengths = {c: F.coalesce(c, F.lit(0)) for c in ("digital", "ocr")}
    return page_spine(meta.select("doc_id", "page_count", "file_name")).join(
        short, ["doc_id", "page"], "left"
    ).select(
        "doc_id",
        _shown("file_name").alias("file_name"),
        "page",
        lengths["digital"].alias("digital_length"),
        lengths["ocr"].alias("ocr_length"),
        (lengths["digital"] + lengths["ocr"]).alias("total_length"),
        *[F.when(n > 0, "Yes").otherwise("No").alias(f"has_{c}") for c, n in lengths.items()],
        F.coalesce("digital_preview", F.lit("")).alias("digital_preview"),
        F.coalesce("ocr_preview", F.lit("")).alias("ocr_preview"),
    )


def _totals(meta: DataFrame, channels: DataFrame, decimals: int) -> DataFrame:
    """One row: documents, pages, characters per channel and average pages per document."""
    documents = meta.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages")
    )
    lengths = channels.select("doc_id", "page", _length("digital").alias("d"), _length("ocr").alias("o"))
    characters = join_documents(lengths, meta.select("doc_id", "page_count")).agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("digital_characters"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("ocr_characters"),
    )
    average = F.when(
        F.col("documents") > 0, round_even(F.col("pages") / F.col("documents"), decimals)
    ).otherwise(0.0)
    return one_row(documents, characters).withColumns({
        "total_characters": F.col("digital_characters") + F.col("ocr_characters"),
        "average_pages": average,
    })


def corpus_statistics(meta: DataFrame, channels: DataFrame) -> DataFrame:
    """Metric and value, one row each."""
    # The names of the metrics.
    named = {
        "Total Documents": "documents",
        "Total Pages": "pages",
        "Total Digital Text Characters": "digital_characters",
        "Total OCR Text Characters": "ocr_characters",
        "Total Text Characters": "total_characters",
        "Average Pages per Document": "average_pages",
    }
    rows = [
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value"))
        for label, c in named.items()
    ]
    return _totals(meta, channels, 2).select(F.inline(F.array(*rows)))


def quick_statistics(meta: DataFrame, channels: DataFrame) -> DataFrame:
    return _totals(meta, channels, 1).drop("documents")


def quick_overview(meta: DataFrame) -> DataFrame:
    """Short overview with the size in KB."""
    size = F.when(
        F.coalesce("file_size", F.lit(0)) != 0, fixed(F.col("file_size") / 1024, 1)
    ).otherwise(MISSING)
    return meta.select(
        "doc_id",
        _shown("file_name").alias("file_name"),
        _shown("page_count").alias("pages"),
        size.alias("size_kb"),
        _short_hash(12).alias("hash"),
    )


def quick_page_summary(meta: DataFrame, channels: DataFrame) -> DataFrame:
    """Lengths per page under a document id of at most 15 characters."""
    key = F.col("doc_id").cast("string")
    short = F.when(F.length(key) > 15, F.concat(F.substring(key, 1, 15), F.lit("..."))).otherwise(key)
    return page_lengths(meta, channels).select(
        short.alias("doc_id"),
        "page",
        F.col("digital_length").alias("digital"),
        F.col("ocr_length").alias("ocr"),
        (F.col("digital_length") + F.col("ocr_length")).alias("total"),
    )


def report_frames(meta: DataFrame, channels: DataFrame) -> dict[str, DataFrame]:
    """The five report tables by name, as written together."""
    return {
        "document_overview": document_overview(meta),
        "digital_text": channel_text_report(meta, channels, "digital"),
        "ocr_text": channel_text_report(meta, channels, "ocr"),
        "combined_pages": combined_page_report(meta, channels),
        "summary_statistics": corpus_statistics(meta, channels),
    }


def run_comparison(runs: DataFrame) -> DataFrame:
    """Fastest and slowest run, memory and throughput extremes over the successful runs."""

    def lowest(value: str) -> Column:
        return F.min(F.when(F.col("success"), F.struct(F.col(value), F.col("implementation"))))

    def highest(value: str) -> Column:
        # among equals the first implementation by name, as for the lowest
        best = F.struct((-F.col(value)).alias(value), F.col("implementation"))
        return F.min(F.when(F.col("success"), best))

    totals = runs.agg(
        lowest("execution_time_seconds").alias("fast"),
        highest("execution_time_seconds").alias("slow"),
        lowest("memory_peak_mb").alias("lean"),
        highest("memory_peak_mb").alias("heavy"),
        highest("throughput_files_per_second").alias("best"),
        F.count("*").alias("total_benchmarks"),
        F.count_if("success").alias("successful_benchmarks"),
    )
    fastest, slowest = F.col("fast.execution_time_seconds"), -F.col("slow.execution_time_seconds")
    return totals.select(
        F.col("fast.implementation").alias("fastest_implementation"),
        fastest.alias("fastest_time_seconds"),
        F.col("slow.implementation").alias("slowest_implementation"),
        slowest.alias("slowest_time_seconds"),
        F.when(fastest > 0, slowest / fastest).otherwise(0.0).alias("speedup_factor"),
        F.col("lean.implementation").alias("lowest_memory_implementation"),
        F.col("lean.memory_peak_mb").alias("lowest_memory_mb"),
        F.col("heavy.implementation").alias("highest_memory_implementation"),
        (-F.col("heavy.memory_peak_mb")).alias("highest_memory_mb"),
        F.col("best.implementation").alias("highest_throughput_implementation"),
        (-F.col("best.throughput_files_per_second")).alias("highest_throughput_files_per_second"),
        "total_benchmarks",
        "successful_benchmarks",
    )
