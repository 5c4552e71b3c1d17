"""Reading the given tables, written intermediates, and small column helpers of the operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.session import shared_folder, ship


#: Bytes of a batch that goes to a Python worker.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once below ``spark.checkpoint.dir``; its lineage ends there.

    The files outlive any executor, so a lost one costs no earlier step.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def map_arrow(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` with a function of this package, in batches of at most about `BATCH`.

    A batch is held by the JVM, outside its heap, and by the worker at once, for each task. Workers are used again, so memory is given back
    after each batch.
    """
    ship(df.sparkSession)
    _bound_batches(df.sparkSession)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from work(_returned(batches))
        give_back()

    return df.mapInArrow(frugal, schema)


def _bound_batches(spark: SparkSession) -> None:
    """Let the session hand over batches of at most `BATCH` bytes (a longer row alone), fewer if it says so itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name, None)
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", (given or "-1").lower()).groups()
    size = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < size <= BATCH:
        spark.conf.set(name, f"{BATCH}b")


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what the work on one left free goes back before the next is read."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string")) % folds


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: A side of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 50_000


def join_checked(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a written `side`: broadcast if its rows, counted first, are few; else an ordinary join.

    The ordinary join is between plain tables, so Spark can split its hot keys at run time.
    """
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if few else side, on, how)
