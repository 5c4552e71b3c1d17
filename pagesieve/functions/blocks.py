"""Page blocks: the exact salt that splits one very large document.

A document may hold a third of all pages. Keys of ``(doc_id, block)`` with
``block = (page - 1) div PAGE_BLOCK`` spread such a document over many tasks, and no
group ever holds more than PAGE_BLOCK pages, because a page number occurs once per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BLOCK = 10_000


def page_block(page: Column, size: int = PAGE_BLOCK) -> Column:
    """Never null, so that a join on it adds no null filter to one of two equal branches."""
    return F.coalesce(F.call_function("div", page - 1, F.lit(size)).cast("int"), F.lit(0))


def document_blocks(meta: DataFrame, size: int = PAGE_BLOCK) -> DataFrame:
    """One row per document and page block it owns; documents without pages give none."""
    return meta.filter(F.col("page_count") >= 1).withColumn(
        "block", F.explode(F.sequence(F.lit(0), page_block(F.col("page_count"), size)))
    )


def join_documents(pages: DataFrame, meta: DataFrame, size: int = PAGE_BLOCK) -> DataFrame:
    """Pages that lie within their document's ``page_count``, with the columns of ``meta``."""
    return (
        pages.withColumn("block", page_block(F.col("page"), size))
        .join(document_blocks(meta, size), ["doc_id", "block"])
        .filter(F.col("page").between(1, F.col("page_count")))
        .drop("block")
    )


def only_documents(pages: DataFrame, documents: DataFrame, size: int = PAGE_BLOCK) -> DataFrame:
    """Pages of the given documents.

    With ``page_count`` among the columns of ``documents`` the join is by page block, which
    splits very large documents; without it, it is by document.
    """
    if "page_count" not in documents.columns:
        return pages.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    blocks = document_blocks(documents.select("doc_id", "page_count"), size).select("doc_id", "block")
    return (
        pages.withColumn("block", page_block(F.col("page"), size))
        .join(blocks, ["doc_id", "block"], "left_semi")
        .drop("block")
    )


def page_spine(meta: DataFrame, size: int = PAGE_BLOCK) -> DataFrame:
    """Every page 1..page_count of every document.

    Blocks are dealt out before they are unrolled, so a document with billions of pages
    is neither one array nor one task. The number of partitions is given, because by their few
    bytes the blocks would be merged into one partition before they grow.
    """
    first = F.col("block") * size + 1
    last = F.least(F.col("page_count"), first + (size - 1))
    partitions = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        document_blocks(meta, size)
        .repartition(partitions, "doc_id", "block")
        .withColumn("page", F.explode(F.sequence(first, last)))
        .drop("block")
    )
