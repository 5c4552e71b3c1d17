import json
import os

import pytest

from pagesieve.operators import analysis, detect, inventory
from pagesieve.plans import analysis_queries
from pagesieve.plans.analysis import export_analysis
from pagesieve.sources import detections as io

ROWS = [
    {"table_name": "T", "document_name": "d", "file_path": "", "found": True, "pages_found": [3, 1], "confidence_score": 0.5, "match_details": ""},
    {"table_name": "T", "document_name": "d", "file_path": "/d", "found": True, "pages_found": [2, 3], "confidence_score": 1.0, "match_details": ""},
    {"table_name": "T", "document_name": "e", "found": True, "pages_found": [], "confidence_score": 0.3, "match_details": ""},
    {"table_name": "U", "document_name": "d", "file_path": "/d2", "found": True, "pages_found": [9], "confidence_score": 0.69, "match_details": ""},
]


@pytest.fixture
def found(spark, tmp_path):
    path = tmp_path / "found.json"
    path.write_text(json.dumps(ROWS, indent=2))
    return io.load_detections(spark, str(path), multi_line=True)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_consolidate(found):
    rows = by(analysis.consolidate(found), "document_name", "table_name")
    assert rows["d", "T"][2:] == (3, 0.75, "/d") and rows["e", "T"][2:] == (0, 0.3, "")
    pages = sorted(r.page for r in analysis.document_table_pages(found).filter("document_name = 'd' and table_name = 'T'").collect())
    assert pages == [1, 2, 3]


def test_mean_takes_any_number(spark, found):
    high = found.withColumn("confidence_score", found.confidence_score + 2)
    rows = by(analysis.consolidate(high), "document_name", "table_name")
    assert rows["d", "T"].confidence == 2.75


def test_statistics(found):
    con = analysis.consolidate(found)
    totals = analysis.analysis_totals(found).first()
    assert totals[:] == (4, 2, 2, 2.0, 2.0)
    assert analysis.analysis_totals(found.limit(0)).first()[:] == (0, 0, 0, 0.0, 0.0)
    bands = by(analysis.confidence_bands(con), "table_name")
    assert bands["T",][2:] == (1, 0, 1) and bands["U",][2:] == (0, 1, 0)
    stats = by(analysis.table_stats(con), "table_name")
    assert stats["T",][1:] == (2, 2, pytest.approx(0.525), 0.3, 0.75)
    for name, row in bands.items():
        assert row.high + row.medium + row.low == stats[name].occurrences
    assert by(analysis.document_stats(con), "document_name")["d",].tables == 2
    (twice,) = analysis.multiple_occurrences(found).collect()
    assert twice[:] == ("T", "d", 2, 2)
    assert sorted(map(tuple, analysis.table_file_paths(con).collect())) == [("T", "/d"), ("U", "/d2")]


def test_export_round_trip(spark, found, tmp_path):
    assert io.at_least(found, 0.5).count() == 3
    with pytest.raises(ValueError):
        io.at_least(found, 1.5)
    written = found.withColumnRenamed("document_name", "doc_id")
    io.export_detections(written, str(tmp_path / "out"))
    again = io.load_detections(spark, str(tmp_path / "out"), min_confidence=0.5)
    columns = [c for c in again.columns if c != "seq"]
    key = lambda r: repr(r)
    assert sorted(again.select(columns).collect(), key=key) == sorted(
        found.filter("confidence_score >= 0.5").select(columns).collect(), key=key
    )
    paths = export_analysis(found, str(tmp_path / "analysis"))
    assert spark.read.json(paths["documents_by_table"]).count() == 3
    assert spark.read.json(paths["summary"]).first().total_detections == 4


def test_inventory(spark):
    meta = spark.createDataFrame(
        [("a-very-long-document", "a.pdf", "/a", 3, 1280, "0123456789abcdef0123"), ("b", None, None, None, 0, "")],
        "doc_id string, file_name string, file_path string, page_count int, file_size bigint, file_hash string",
    )
    channels = spark.createDataFrame(
        [("a-very-long-document", 1, "x" * 210 + "é", ""), ("a-very-long-document", 2, None, "é"),
         ("a-very-long-document", 4, "beyond the page count", None), ("b", 1, "no page count", None)],
        "doc_id string, page int, digital string, ocr string",
    )
    overview = by(inventory.document_overview(meta), "doc_id")
    assert overview["b",][1:] == ("N/A", "N/A", "N/A", "0", "N/A")
    assert overview["a-very-long-document",].file_hash == "0123456789abcdef..."
    quick = by(inventory.quick_overview(meta), "doc_id")
    assert quick["a-very-long-document",][2:] == ("3", "1.2", "0123456789ab...") and quick["b",].size_kb == "N/A"
    pages = inventory.combined_page_report(meta, channels).orderBy("page").collect()
    assert [(p.page, p.digital_length, p.ocr_length, p.has_digital, p.has_ocr) for p in pages] == [
        (1, 211, 0, "Yes", "No"), (2, 0, 1, "No", "Yes"), (3, 0, 0, "No", "No")
    ]
    assert pages[0].digital_preview == "x" * 200 and pages[1].ocr_preview == "No text available" and pages[2].ocr_preview == ""
    statistics = {r.metric: r.value for r in inventory.corpus_statistics(meta, channels).collect()}
    assert statistics["Total Documents"] == 2 and statistics["Average Pages per Document"] == 1.5
    assert statistics["Total Text Characters"] == sum(p.total_length for p in pages) == 212
    summary = inventory.quick_page_summary(meta, channels).orderBy("page").first()
    assert summary[:] == ("a-very-long-doc...", 1, 211, 0, 211)
    assert [r.page for r in inventory.channel_text_report(meta, channels, "digital").collect()] == [1]


def test_run_comparison(spark):
    runs = spark.createDataFrame(
        [("b", 2.0, 9.0, 5.0, True), ("a", 2.0, 3.0, 5.0, True), ("c", 8.0, 3.0, 1.0, True), ("bad", 0.1, 0.1, 99.0, False)],
        "implementation string, execution_time_seconds double, memory_peak_mb double, "
        "throughput_files_per_second double, success boolean",
    )
    assert inventory.run_comparison(runs).first()[:] == (
        "a", 2.0, "c", 8.0, 4.0, "a", 3.0, "b", 9.0, "a", 5.0, 4, 3
    )
    nothing = inventory.run_comparison(runs.filter("not success")).first()
    assert nothing.fastest_implementation is None and nothing.successful_benchmarks == 0


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LISTLESS = ["consolidate", "tables_by_document", "documents_by_table", "analysis_totals", "table_stats", "document_stats",
            "document_table_pages", "confidence_bands", "multiple_occurrences", "table_file_paths"]


@pytest.mark.parametrize("name", LISTLESS)
def test_analysis_gathers_no_pages(spark, name):
    plan = analysis_queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_parts_are_bounded_and_give_the_same_analysis(spark, tmp_path):
    hits = spark.createDataFrame(
        [("T", "d", p, p / 20, f"p{p}") for p in range(3, 11)] + [("T", "e", 1, 0.5, "p1")],
        "table_name string, doc_id string, page int, score double, details string",
    )
    parts = detect.listed_parts(hits.selectExpr("*", "0 as seq"), "seq", size=2).selectExpr("*", "'/x' as file_path")
    rows = {(r.doc_id, r.part): r for r in parts.collect()}
    assert sorted(rows) == [("d", 0), ("d", 2), ("d", 3), ("d", 4), ("e", 0)]
    assert all(len(r.pages_found) <= 2 for r in rows.values())
    assert rows["d", 2].pages_found == [5, 6] and rows["d", 2].match_details == "Page 5: p5; Page 6: p6"
    io.export_parts(parts, str(tmp_path / "parts"))
    heads, pages = io.load_parts(spark, str(tmp_path / "parts"))
    whole = io.as_exported(detect.listed(hits).selectExpr("*", "'/x' as file_path", "0L as seq"), "seq")
    for run in (analysis.consolidate, analysis.document_table_pages):
        assert sorted(run(heads, pages).collect()) == sorted(run(whole).collect())
    assert analysis.analysis_totals(heads).first() == analysis.analysis_totals(whole).first()
