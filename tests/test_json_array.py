"""JSON arrays read by splits, and reports in order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagesieve.sources.detections import write_ordered
from pagesieve.sources.json_array import read_array

SCHEMA = "a string, b struct<c: array<struct<d: string>>, e: int>, f int"


def objects(n: int, seed: int) -> list[dict]:
    """Objects whose strings hold brackets, quotes and backslashes, and that nest."""
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices('{}[]",\\:\n é', k=draw.randrange(12)))
    return [
        {"a": text(), "b": {"c": [{"d": text()} for _ in range(draw.randrange(3))], "e": i}, "f": i} for i in range(n)
    ]


@pytest.fixture
def splits(spark):
    """Splits of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("97", "1")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_read_by_many_tasks_and_whole(spark, tmp_path, splits, indent):
    given = [objects(60, 1), objects(40, 2)]
    for i, rows in enumerate(given):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(i)))
    assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = [r.asDict(recursive=True) for r in read_array(spark, str(tmp_path), SCHEMA).orderBy("seq").collect()]
    assert [r.pop("seq") for r in got] == list(range(1, 101))
    assert got == given[0] + given[1]


def test_odd_files(spark, tmp_path, splits):
    texts = ["", "[]", " [1, null, \"{\", {\"f\": 1}, [{\"f\": 9}]]", "[{\"f\": 2}] [{\"f\": 3}]\n[{\"f\": 4}", "[{\"f\": 5}, {\"f\": "]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    assert [r.f for r in read_array(spark, str(tmp_path), SCHEMA, into="n").orderBy("n").collect()] == [1, 2, 3, 4, 5, None]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("")
    assert read_array(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_rows_are_written_in_order_and_numbered(spark, tmp_path):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.4 else f"d{draw.randrange(30)}", i) for i in range(1000)] + [(None, 5)]
    df = spark.createDataFrame(rows, "doc string, page int").repartition(5)
    write_ordered(df, str(tmp_path / "out"), ["doc", "page"], part_rows=128)
    folders = sorted((tmp_path / "out").glob("part=*"), key=lambda p: int(p.name[5:]))
    assert len(folders) == 8 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    read = [r for f in folders for r in spark.read.parquet(str(f)).coalesce(1).select("doc", "page", "row").collect()]
    assert [r.row for r in read] == list(range(1001))
    assert [tuple(r)[:2] for r in read] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    write_ordered(df.limit(0), str(tmp_path / "empty"), ["doc"])
    assert not list((tmp_path / "empty").glob("part=*"))
    write_ordered(df.withColumn("page", F.col("page").cast("string")), str(tmp_path / "csv"), ["doc", "page"], 500, "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1001
