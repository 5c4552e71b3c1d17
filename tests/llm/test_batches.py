"""Batches that go to Python workers are bounded in bytes, not only in rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import tables

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(spark):
    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("text "), 20_000).alias("text"))
    return [tuple(r) for r in tables.map_arrow(texts, work, "n long, size long").collect()]


@pytest.mark.parametrize("given, most", [(None, tables.BATCH), ("64m", tables.BATCH), ("1m", 1 << 20)])
def test_batches_of_long_texts_are_small(spark, given, most):
    before = spark.conf.get(NAME)
    try:
        spark.conf.unset(NAME) if given is None else spark.conf.set(NAME, given)
        found = sizes(spark)
    finally:
        spark.conf.set(NAME, before)
    assert sum(n for n, _ in found) == 300
    assert max(size for _, size in found) <= most + 200_000
