"""The merged page view: one text per page out of the digital and the OCR channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import strip


def combined_text(digital: Column, ocr: Column) -> Column:
    """Both channels, the OCR text only where it adds something; null means the channel is absent."""
    adds = (ocr != "") & ~F.contains(digital, ocr)
    return (
        F.when(digital.isNull(), ocr)
        .when(ocr.isNull(), digital)
        .when(adds, strip(F.concat(digital, F.lit("\n"), ocr)))
        .otherwise(digital)
    )


def preferred_text(digital: Column, ocr: Column, prefer: str = "digital") -> Column:
    """One channel: OCR where preferred and non-empty, otherwise digital even if empty."""
    takes_ocr = digital.isNull()
    if prefer.lower() == "ocr":
        takes_ocr = takes_ocr | (ocr != "")
    return F.when(takes_ocr, ocr).otherwise(digital)


def join_channels(digital: DataFrame, ocr: DataFrame) -> DataFrame:
    """Bring two channel tables (doc_id, page, text) together as columns ``digital`` and ``ocr``.

    The store keeps both channels in one row and needs no such join.
    """
    return digital.withColumnRenamed("text", "digital").join(
        ocr.withColumnRenamed("text", "ocr"), ["doc_id", "page"], "full_outer"
    )


def pages_combined(channels: DataFrame) -> DataFrame:
    return channels.select("doc_id", "page", combined_text(F.col("digital"), F.col("ocr")).alias("text"))


def pages_preferred(channels: DataFrame, prefer: str = "digital") -> DataFrame:
    return channels.select(
        "doc_id", "page", preferred_text(F.col("digital"), F.col("ocr"), prefer).alias("text")
    )


def document_pages(
    channels: DataFrame, prefer: str = "digital", combine: bool = True
) -> DataFrame:
    """Page view as the store hands it out."""
    return pages_combined(channels) if combine else pages_preferred(channels, prefer)
