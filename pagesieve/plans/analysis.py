"""Analysis of exported detections, written as one set of results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagesieve.operators import analysis
from pagesieve.sources.detections import write_frames


def export_analysis(detections: DataFrame, root: str, file_format: str = "json", pages: DataFrame | None = None) -> dict[str, str]:
    """Write all analysis results below ``root``; returns name and path of each.

    The consolidated rows are written first and the other results are taken from what was
    written, so the detections are grouped once. ``pages`` are the flat rows of detections that come without lists.
    """
    spark = detections.sparkSession
    base = write_frames({"consolidated": analysis.consolidate(detections, pages)}, root, "parquet")
    consolidated = spark.read.parquet(base["consolidated"])
    return {**base, **write_frames(analysis.analysis_frames(detections, consolidated, pages), root, file_format)}
