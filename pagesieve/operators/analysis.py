"""Statistics over exported detections.

Detections come with the list of their pages or, for documents of any size, without it and beside flat rows of
``pages``: (document_name, table_name, page), a page may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.numbers import mean

GROUP = ["document_name", "table_name"]


def consolidated_pages(detections: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The distinct pages of each (document, table), one row each."""
    if pages is None:
        pages = detections.withColumn("page", F.explode("pages_found"))
    return pages.select(*GROUP, "page").distinct()


def consolidate(detections: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per (document, table): number of distinct pages, mean confidence, first path given.

    The pages are the rows of ``consolidated_pages``, as there may be any number of them.
    """
    path = F.when(F.col("file_path") != "", F.col("file_path"))
    order = F.col("seq") if "seq" in detections.columns else F.col("file_path")
    stats = detections.groupBy(*GROUP).agg(
        mean(F.col("confidence_score")).alias("confidence"),
        F.coalesce(F.min_by(path, F.when(path.isNotNull(), order)), F.lit("")).alias("file_path"),
    )
    counts = consolidated_pages(detections, pages).groupBy(*GROUP).agg(F.count("*").alias("n_pages"))
    return stats.join(counts, GROUP, "left").select(
        *GROUP, F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "confidence", "file_path"
    )


def tables_by_document(consolidated: DataFrame) -> DataFrame:
    return consolidated.select("document_name", "table_name", "n_pages", "confidence", "file_path")


def documents_by_table(consolidated: DataFrame) -> DataFrame:
    return consolidated.select("table_name", "document_name", "n_pages", "confidence", "file_path")


def _per(total: Column, parts: Column) -> Column:
    return F.coalesce(F.try_divide(total, parts), F.lit(0.0))


def analysis_totals(detections: DataFrame) -> DataFrame:
    """Detections, documents, tables, and detections per document and per table."""
    return (
        detections.agg(
            F.count("*").alias("total_detections"),
            F.count_distinct("document_name").alias("unique_documents"),
            F.count_distinct("table_name").alias("unique_tables"),
        )
        .withColumns({
            "average_detections_per_document": _per(F.col("total_detections"), F.col("unique_documents")),
            "average_detections_per_table": _per(F.col("total_detections"), F.col("unique_tables")),
        })
    )


def table_stats(consolidated: DataFrame) -> DataFrame:
    """One row of ``consolidated`` is one document, so documents need no distinct count."""
    return consolidated.groupBy("table_name").agg(
        F.count("*").alias("documents"),
        F.count("*").alias("occurrences"),
        mean(F.col("confidence")).alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )


def document_stats(consolidated: DataFrame) -> DataFrame:
    return consolidated.groupBy("document_name").agg(
        F.count("*").alias("tables"),
        F.count("*").alias("occurrences"),
        mean(F.col("confidence")).alias("avg_confidence"),
    )


def document_table_pages(detections: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per document and table its pages, one row each."""
    return consolidated_pages(detections, pages)


def confidence_bands(consolidated: DataFrame) -> DataFrame:
    """High from 0.7, medium from 0.4, low below."""
    c = F.col("confidence")
    return consolidated.groupBy("table_name").agg(
        mean(c).alias("avg_confidence"),
        F.count_if(c >= 0.7).alias("high"),
        F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"),
        F.count_if(c < 0.4).alias("low"),
    )


def multiple_occurrences(detections: DataFrame) -> DataFrame:
    """(table, document) pairs detected more than once, with the table's total of such detections."""
    pairs = (
        detections.groupBy("table_name", "document_name").agg(F.count("*").alias("occurrences"))
        .filter("occurrences > 1")
    )
    totals = pairs.groupBy("table_name").agg(F.sum("occurrences").alias("total_multiple"))
    return pairs.join(totals, "table_name")


def table_file_paths(consolidated: DataFrame) -> DataFrame:
    """The distinct non-empty paths per table, one row each."""
    return consolidated.filter("file_path <> ''").select("table_name", "file_path").distinct()


def analysis_frames(
    detections: DataFrame, consolidated: DataFrame, pages: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All analysis results by name."""
    return {
        "summary": analysis_totals(detections),
        "tables_by_document": tables_by_document(consolidated),
        "documents_by_table": documents_by_table(consolidated),
        "multiple_occurrences": multiple_occurrences(detections),
        "table_stats": table_stats(consolidated),
        "document_stats": document_stats(consolidated),
        "confidence_stats": confidence_bands(consolidated),
        "file_paths": table_file_paths(consolidated),
        "pages": document_table_pages(detections, pages),
    }
