import pytest
from pyspark.sql import functions as F

from pagesieve import Phrase, TableRule
from pagesieve.functions import frames
from pagesieve.operators import ingest
from pagesieve.plans.ingest import ingest_batch, search_store
from pagesieve.schemas import DOCUMENT_LOG
from pagesieve.sources import manifest
from pagesieve.sources.store import PageStore, flatten_metadata, page_texts, put_page_texts

PAGES = "doc_id string, page int, digital string, ocr string"


def write_pdfs(folder, files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name).write_bytes(content)


def channels(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_manifest(spark, tmp_path):
    write_pdfs(tmp_path / "in", {"a.pdf": b"alpha", "b.c.pdf": b"beta", "skip.txt": b"x"})
    write_pdfs(tmp_path / "in" / "deeper", {"z.pdf": b"z"})
    files = manifest.file_manifest(manifest.read_files(spark, str(tmp_path / "in")))
    rows = {r.doc_id: r for r in files.collect()}
    assert set(rows) == {"a", "b.c"}
    assert rows["a"].file_hash == "2c1743a391305fbf367df8e4f069f9f9" and rows["a"].file_size == 5
    assert rows["b.c"].file_name == "b.c.pdf" and rows["b.c"].last_modified > 1e9


@pytest.fixture
def stored(spark, tmp_path):
    write_pdfs(tmp_path / "in", {"a.pdf": b"1", "b.pdf": b"2"})
    store = PageStore(spark, str(tmp_path / "store"))

    def run(batch, rows, **switches):
        files = manifest.file_manifest(manifest.read_files(spark, str(tmp_path / "in")))
        ingest_batch(store, batch, files, channels(spark, rows), **switches)

    return store, run, tmp_path / "in"


FIRST = [("a", 1, " one \n", "ONE"), ("a", 3, None, "three"), ("b", 1, "other", None)]


def texts(store, **how):
    return {(r.doc_id, r.page): r.text for r in store.pages(**how).collect()}


def test_ingest_and_reingest(stored):
    store, run, folder = stored
    run(1, FIRST)
    assert texts(store) == {("a", 1): "one\nONE", ("a", 2): "", ("a", 3): "three", ("b", 1): "other"}
    assert {r.doc_id: r.page_count for r in store.metadata().collect()} == {"a": 3, "b": 1}
    assert sorted((r.file_name, r.success, r.pages_processed) for r in store.run_log().collect()) == [("a.pdf", True, 3), ("b.pdf", True, 1)]
    run(2, FIRST)  # nothing changed
    assert store.document_log().count() == 2 and store.run_log().count() == 2
    (folder / "a.pdf").write_bytes(b"changed")
    run(3, [("a", 1, "new", ""), ("b", 1, "must not be read", None)])
    assert texts(store) == {("a", 1): "new", ("b", 1): "other"}  # all older pages of a are gone
    assert store.get_metadata("a").first().page_count == 1
    assert store.get_page_text("b", 1, "digital").first().text == "other"
    assert store.get_page_text("b", 9, "ocr").collect() == []
    assert [r.doc_id for r in store.list_docs().collect()] == ["a", "b"]


def test_repeated_batch_replaces_itself(stored):
    store, run, _ = stored
    run(1, FIRST)
    before = texts(store)
    run(1, FIRST)
    assert texts(store) == before and store.document_log().count() == 2


def test_ocr_after_digital_keeps_both(spark, stored):
    store, run, folder = stored
    run(1, FIRST, enable_ocr=False)
    assert texts(store)["a", 1] == "one"
    run(2, [("a", 1, None, "ONE"), ("a", 2, None, "two"), ("b", 1, None, None)])
    assert texts(store) == {("a", 1): "one\nONE", ("a", 2): "two", ("a", 3): "", ("b", 1): "other"}
    store.put_page_texts("ocr", 1, channels(spark, [("b", 1, None, "B"), ("b", 2, "second", None), ("z", 1, "unknown", None)]))
    assert texts(store)["b", 1] == "other\nB" and texts(store)["b", 2] == "second" and texts(store)["z", 1] == "unknown"
    (folder / "a.pdf").write_bytes(b"changed")
    run(3, [("a", 1, "new", None)])
    assert {k: v for k, v in texts(store).items() if k[0] == "a"} == {("a", 1): "new"}
    before = texts(store)
    store.compact(1)
    assert texts(store) == before and store.metadata().count() == 3
    newest = store.document_log().agg({"seq": "max"}).first()[0]
    assert f"(seq#" in (plan := store.channels()._jdf.queryExecution().executedPlan().toString()) and f">= {newest})" in plan


def test_failed_files_are_tried_again_and_completed_ones_skipped(spark, stored):
    store, run, _ = stored
    broken = spark.createDataFrame([("b.pdf", "broken")], "file_name string, error string")
    run(1, FIRST[:2], failures=broken)
    assert {k[0] for k in texts(store)} == {"a"}
    run(2, FIRST)
    assert texts(store)["b", 1] == "other" and store.document_log().count() == 2
    log = sorted((r.file_name, r.success) for r in store.run_log().collect())
    assert log == [("a.pdf", True), ("b.pdf", False), ("b.pdf", True)]
    run(3, FIRST, skip_existing=False)
    assert store.document_log().count() == 2


def test_writers_with_equal_numbers_keep_all_documents(spark, stored):
    store, run, _ = stored
    run(1, FIRST[:2], writer="x", failures=spark.createDataFrame([("b.pdf", "?")], "file_name string, error string"))
    run(1, FIRST, writer="y")
    assert {k[0] for k in texts(store)} == {"a", "b"}
    with pytest.raises(ValueError):
        run(1, FIRST, writer="../x")


def test_unasked_texts_are_not_moved(spark, tmp_path):
    rows = channels(spark, FIRST)
    rows.write.parquet(str(tmp_path / "p"))
    asked = spark.createDataFrame([("a", 1)], "doc_id string, page int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = page_texts(spark.read.parquet(str(tmp_path / "p")), asked, "ocr")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan[plan.rindex("Join", 0, plan.index("FileScan")) :]
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in scan[: scan.index("FileScan")]


def test_disabled_channel_is_empty(stored):
    store, run, _ = stored
    run(1, FIRST, enable_digital=False)
    assert texts(store) == {("a", 1): "ONE", ("a", 2): "", ("a", 3): "three", ("b", 1): ""}


def test_search_store(spark, stored):
    store, run, folder = stored
    run(1, FIRST)
    rule = TableRule("t", (Phrase("o"),), "all_elements")
    found = {r.doc_id: r for r in search_store(store, [rule]).collect()}
    assert found["a"].n_pages == 1 and found["a"].file_path.endswith("/in/a.pdf")
    only_b = spark.createDataFrame([("b",)], "doc_id string")
    assert [r.doc_id for r in search_store(store, [rule], doc_ids=only_b).collect()] == ["b"]


def test_put_page_texts(spark):
    schema = PAGES + ", batch int"
    old = spark.createDataFrame([("d", 1, "x", "y", 1), ("d", 2, "", None, 1)], schema)
    new = spark.createDataFrame([("d", 1, None, "", 2), ("d", 2, None, None, 2), ("e", 1, "n", None, 2)], schema)
    rows = {(r.doc_id, r.page): (r.digital, r.ocr) for r in put_page_texts(old, new).collect()}
    assert rows == {("d", 1): ("x", ""), ("d", 2): ("", None), ("e", 1): ("n", None)}


def test_flatten_metadata(spark):
    rows = spark.createDataFrame(
        [("d", "/p", 1, (7, "eng")), ("e", "/q", 2, None)],
        "doc_id string, file_path string, page_count int, metadata struct<page_count: int, lang: string>",
    )
    assert [tuple(r) for r in flatten_metadata(rows).orderBy("doc_id").collect()] == [("d", "/p", 7, "eng"), ("e", "/q", 2, None)]


def test_page_texts(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("z", 1)], "doc_id string, page int")
    got = {(r.doc_id, r.page): r.text for r in page_texts(channels(spark, FIRST), asked, "ocr").collect()}
    assert got == {("a", 1): "ONE", ("a", 2): None, ("z", 1): None}


def test_page_count_zero_gives_no_pages(spark):
    meta = spark.createDataFrame([("a", 0), ("b", None), ("c", 10001)], "doc_id string, page_count int")
    pages = ingest.assemble_pages(meta, channels(spark, [("a", 1, "x", "y"), ("c", 10001, "last", None)]))
    assert pages.agg(F.count("*"), F.count_if(F.col("digital") == "last"), F.min("doc_id")).first()[:] == (10001, 1, "c")


def test_fold_image_text(spark):
    meta = spark.createDataFrame([("d", 2)], "doc_id string, page_count int")
    images = spark.createDataFrame(
        [("d", 1, 2, "two "), ("d", 1, 10, "ten"), ("d", 1, 1, " "), ("d", 1, 0, None)],
        "doc_id string, page int, image_idx int, text string",
    )
    rows = ingest.fold_image_text(meta, images).orderBy("page").collect()
    assert [r.text for r in rows] == ["two ten", ""]


def test_merge_needs_equal_lengths(spark):
    schema = "doc_id string, page int, text string"
    ocr = spark.createDataFrame([("d", 1, "o "), ("d", 2, "")], schema)
    digital = spark.createDataFrame([("d", 1, " x"), ("d", 2, " \n")], schema)
    assert [r.text for r in ingest.merge_ocr_digital(ocr, digital).orderBy("page").collect()] == ["o   x", ""]
    with pytest.raises(Exception, match="same length"):
        ingest.merge_ocr_digital(ocr, digital.filter("page = 1")).collect()


def test_resume_and_log(spark):
    schema = "file_name string, file_hash string, success boolean, pages_processed int, error string"
    log = spark.createDataFrame([("a", "1", True, 4, None), ("b", "2", False, 0, "broken")], schema)
    files = spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "2"), ("c", "3")], "file_name string, file_hash string")

    def left(**how):
        return sorted(map(tuple, ingest.resume_filter(files, log, **how).collect()))

    assert left() == [("a", "9"), ("b", "2"), ("c", "3")]
    assert left(by_name_only=True) == [("b", "2"), ("c", "3")]
    assert len(left(skip_existing=False)) == 4
    twice = ingest.append_log(log, log)
    assert ingest.ingest_summary(twice).first()[:] == (3, 1, 2, 4)
    assert ingest.ingest_summary(log.limit(0)).first()[:] == (0, 0, 0, 0)
    assert [r.error for r in ingest.failed_files(twice).collect()] == ["broken", "broken"]


def test_writers_that_read_the_same_store_never_mix_contents(spark, tmp_path, monkeypatch):
    """Three pages and then new content of one page, claimed and written in any order."""
    def documents(pages, digest):
        return spark.createDataFrame(
            [("d", "d.pdf", "/d.pdf", pages, 1, digest, 0.0, None, True, False)],
            "doc_id string, file_name string, file_path string, page_count int, file_size bigint, file_hash string, last_modified double, "
            "processing_date timestamp, has_digital boolean, has_ocr boolean",
        )

    def texts(mark, n):
        return spark.createDataFrame([("d", i + 1, f"{mark}{i}", None) for i in range(n)], "doc_id string, page int, digital string, ocr string")

    for late in ("three", "one"):
        store = PageStore(spark, str(tmp_path / late))
        first, second = store._claim(), store._claim()
        assert first < second
        numbers = {"three": first, "one": second}
        order = ["one", "three"] if late == "three" else ["three", "one"]
        for name in order:
            monkeypatch.setattr(store, "_claim", lambda name=name: numbers[name])
            store.write_batch(name, 1, documents(3 if name == "three" else 1, name), texts(name, 3 if name == "three" else 1))
        # the content that was claimed last counts, in whatever order both arrive
        assert store.metadata().first()["page_count"] == 1
        assert [(r["page"], r["digital"]) for r in store.channels().orderBy("page").collect()] == [(1, "one0")]
        # what is added to a content that was replaced meanwhile does not count
        stale = documents(3, "three").withColumn("since", F.lit(first).cast("bigint"))
        monkeypatch.setattr(store, "_claim", lambda: second + 1)
        store.write_batch("late", 1, stale, texts("late", 3))
        assert store.metadata().first()["file_hash"] == "one"
        assert [(r["page"], r["digital"]) for r in store.channels().orderBy("page").collect()] == [(1, "one0")]


def test_a_claimed_number_is_not_claimed_again(spark, tmp_path):
    one, two = (PageStore(spark, str(tmp_path / "s")) for _ in range(2))
    assert [one._claim(), two._claim(), one._claim(), two._claim()] == [1, 2, 3, 4]


def test_a_long_side_is_joined_without_sorting_the_texts(spark, monkeypatch):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 1)
    texts = spark.createDataFrame([(i % 5, f"text {i}") for i in range(40)], "doc_id int, text string")
    side = spark.createDataFrame([(i,) for i in range(3)], "doc_id int")
    for how, n in (("inner", 24), ("left_semi", 24), ("left_anti", 16)):
        df = frames.join_checked(texts, side, "doc_id", how)
        assert df.count() == n
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_pages_given_twice_are_written_once(spark, tmp_path):
    target = PageStore(spark, str(tmp_path))
    rows = [("d", p, f"text {p}", None) for p in (1, 2, 3)] * 4
    pages = spark.createDataFrame(rows, "doc_id string, page int, digital string, ocr string").repartition(4)
    target.write_batch("w", 0, spark.createDataFrame([], DOCUMENT_LOG).drop("writer", "batch", "seq", "since"), pages, once=True)
    assert sorted(x.page for x in spark.read.parquet(f"{tmp_path}/pages").collect()) == [1, 2, 3]


def test_texts_are_joined_once(spark, tmp_path, monkeypatch):
    from pagesieve.sources import store as store_module
    from pagesieve.streaming import ingest_stream

    asked = []

    def recorded(df, side, on, how="inner"):
        asked.append(on)
        return frames.join_checked(df, side, on, how)

    monkeypatch.setattr(store_module, "join_checked", recorded)
    monkeypatch.setattr(ingest_stream, "join_checked", recorded)
    columns = "doc_id string, file_name string, file_path string, file_size bigint, file_hash string, last_modified double, page int, digital string, ocr string"

    def extracts(rows):
        return spark.createDataFrame([(d, f"{d}.pdf", f"/{d}.pdf", 1, h, 0.0, p, t, o) for d, h, p, t, o in rows], columns)

    store = PageStore(spark, str(tmp_path / "store"))
    first = [("a", "1", 1, " x ", None), ("a", "1", 2, "y", None), ("b", "1", 1, "z", None), ("c", "1", 1, "v", None), (None, "1", 1, "lost", None), ("e", None, 1, "lost", None)]
    ingest_stream.store_extracts(store, extracts(first), "w", 0)
    assert "file_hash" not in [k for on in asked for k in on]  # all is new: nothing to look up
    ingest_stream.store_extracts(store, extracts([("a", "2", 1, "new", None), ("b", "1", 1, None, "B"), ("c", "1", 1, "v", None)]), "w", 1)
    assert [on for on in asked if "file_hash" in on] == [["doc_id", "last_modified", "file_hash"]]
    for few in (True, False):
        if not few:
            monkeypatch.setattr(frames, "BROADCAST_ROWS", 0)
        asked.clear()
        rows = sorted(map(tuple, store.channels().collect()))
        assert rows == [("a", 1, "new", ""), ("b", 1, "z", "B"), ("c", 1, "v", "")]
        # for the replaced, for the layered and for the other pages there was a join each
        assert len([on for on in asked if "block" in on]) == 1
