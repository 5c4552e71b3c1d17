"""Batch ingest and corpus detection, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.definitions import TableRule
from pagesieve.functions.blocks import only_documents
from pagesieve.functions.frames import join_checked
from pagesieve.operators import detect, ingest
from pagesieve.sources.store import PageStore


def ingest_batch(
    store: PageStore,
    batch: int,
    manifest: DataFrame,
    channels: DataFrame,
    enable_digital: bool = True,
    enable_ocr: bool = True,
    failures: DataFrame | None = None,
    skip_existing: bool = True,
    writer: str = "batch",
) -> DataFrame:
    """Store the new and changed files of a manifest with their extracted page texts; gives the run's totals.

    ``channels`` holds (doc_id, page, digital, ocr) of the files that were extracted, ``failures`` (file_name, error) of
    those that could not be. Files that the store's own log of runs has as completed are skipped, unless they bring
    a channel that is not there yet; only the texts of files that are stored are moved. All results go to the log.
    """
    enabled = {"digital": enable_digital, "ocr": enable_ocr}
    texts = channels.withColumns({c: F.col(c) if on else F.lit(None).cast("string") for c, on in enabled.items()})
    own = (writer, batch)
    found = texts.groupBy("doc_id").agg(
        F.max("page").alias("page_count"), *[c.alias(n) for n, c in ingest.channel_flags().items()]
    )
    files = manifest.join(found, "doc_id", "left").fillna({"page_count": 0, "has_digital": False, "has_ocr": False})
    if failures is not None:
        files = files.join(failures.select("file_name", "error"), "file_name", "left")
    else:
        files = files.withColumn("error", F.lit(None).cast("string"))
    stored = store.metadata(without=own)
    left = ingest.resume_filter(files, store.run_log(without=own), skip_existing).select("doc_id")
    known = stored.select("doc_id", F.col("has_digital").alias("d"), F.col("has_ocr").alias("o"))
    adding = files.join(known, "doc_id").filter("(has_digital and not d) or (has_ocr and not o)").select("doc_id")
    files = files.join(left.unionByName(adding).distinct(), "doc_id", "left_semi").persist()
    chosen = ingest.to_store(files.filter("error is null").drop("error"), stored).persist()
    try:
        picked = chosen.select("doc_id", F.col("since").isNull().alias("fresh"))
        kept = join_checked(texts, picked, "doc_id").withColumns({
            c: F.when(F.col("fresh") | F.col(c).isNotNull(), ingest.normalize_page_text(F.col(c))) for c in enabled
        })
        # New content has every page from 1 on; what is added to known content are the pages that were extracted.
        fresh = ingest.assemble_pages(
            chosen.filter("since is null"), kept.filter("fresh").drop("fresh"), enable_digital, enable_ocr
        )
        added = kept.filter("not fresh").drop("fresh")
        log = files.select(
            "file_name",
            "file_hash",
            F.col("error").isNull().alias("success"),
            F.when(F.col("error").isNull(), F.col("page_count")).otherwise(0).alias("pages_processed"),
            "error",
        )
        store.write_batch(writer, batch, chosen, fresh.unionByName(added), log)
    finally:
        chosen.unpersist()
        files.unpersist()
    return ingest.ingest_summary(store.run_log())


def _stored_pages(store: PageStore, doc_ids: DataFrame | None) -> DataFrame:
    if doc_ids is None:
        return store.pages()
    return only_documents(store.pages(), store.metadata().join(doc_ids.select("doc_id"), "doc_id", "left_semi"))


def search_store(
    store: PageStore,
    rules: Sequence[TableRule],
    min_confidence: float = 0.0,
    doc_ids: DataFrame | None = None,
) -> DataFrame:
    """Detect tables in all stored documents, or in the given ones, with their file paths.

    The pages of these detections are the rows of ``search_store_pages``.
    """
    pages = _stored_pages(store, doc_ids)
    return detect.with_file_paths(detect.detect_tables(pages, rules, min_confidence), store.metadata())


def search_store_pages(
    store: PageStore,
    rules: Sequence[TableRule],
    min_confidence: float = 0.0,
    doc_ids: DataFrame | None = None,
) -> DataFrame:
    """The pages of the detections in all stored documents, or in the given ones: one row per (document, table, page)."""
    return detect.detected_pages(_stored_pages(store, doc_ids), rules, min_confidence)
