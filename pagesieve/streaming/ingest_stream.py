"""Incremental ingest: a file stream of extracted documents into the page store.

A checkpoint is a writer of its own in the store, and each micro-batch is a batch of that writer under the batch's own number. A
batch that is repeated after a failure replaces itself; a new checkpoint is a new writer and replaces nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagesieve.functions.frames import join_checked
from pagesieve.operators.ingest import channel_flags, normalize_page_text, to_store
from pagesieve.sources.store import PageStore, last_rows


def read_extracts(
    spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 1000
) -> DataFrame:
    """Stream of the Parquet files that appear in a folder, or under a path pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def store_extracts(
    store: PageStore, extracts: DataFrame, writer: str, batch: int,
    enable_digital: bool = True, enable_ocr: bool = True,
) -> None:
    """Store the new and changed documents of one batch of extracts (``schemas.EXTRACT``).

    Which version of a document counts and whether it changed is decided on narrow rows; only the texts of what
    is stored are moved. The comparison leaves out this batch itself: on a repeat it must not find its own rows.
    """
    enabled = {"digital": enable_digital, "ocr": enable_ocr}
    extracts = extracts.withColumns({c: F.col(c) if on else F.lit(None).cast("string") for c, on in enabled.items()})
    version = ["doc_id", "last_modified", "file_hash"]
    versions = extracts.groupBy(*version).agg(
        *[F.first(c).alias(c) for c in ("file_name", "file_path", "file_size")],
        F.coalesce(F.max("page"), F.lit(0)).alias("page_count"),
        *[c.alias(n) for n, c in channel_flags().items()],
    )
    versions = versions.persist()
    chosen = to_store(last_rows(versions, ["doc_id"], version[1:]), store.metadata(without=(writer, batch))).persist()
    try:
        picked = chosen.select(*version, F.col("since").isNull().alias("fresh"))
        texts, known = extracts.filter("page is not null"), " and ".join(f"{c} is not null" for c in version)
        if picked.filter(f"fresh and {known}").count() == versions.filter(known).count():
            # every version is stored as new content, as in a first run: nothing has to be looked up
            texts = texts.filter(known).withColumn("fresh", F.lit(True))
        else:
            texts = join_checked(texts, picked, version)

        def channel(name: str) -> Column:
            # of new content what was not extracted is empty, to known content it adds nothing
            text = normalize_page_text(F.col(name))
            return F.when(F.col("fresh") | F.col(name).isNotNull(), text).alias(name)

        pages = texts.select("doc_id", "page", channel("digital"), channel("ocr"))
        # a file may have been delivered twice
        store.write_batch(writer, batch, chosen, pages, once=True)
    finally:
        chosen.unpersist()
        versions.unpersist()


def checkpoint_writer(spark: SparkSession, checkpoint: str) -> str:
    """The name of a checkpoint as a writer: the id that the stream keeps in it, new for every new checkpoint."""
    kept = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()
    return f"stream-{kept[0]}"


def start_ingest(extracts: DataFrame, store: PageStore, checkpoint: str, **switches) -> StreamingQuery:
    """Ingest what has arrived since the last run, then stop; run it again for later files."""

    def sink(rows: DataFrame, batch: int) -> None:
        store_extracts(store, rows, checkpoint_writer(store.spark, checkpoint), batch, **switches)

    return (
        extracts.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
