"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry_module
import check
from pagesieve.operators import detect
from pagesieve.plans import fixtures as fx

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The optional subpackage has tests of its own.
MODULES = [m for m in entry_module._MODULES if m.__name__.startswith("pagesieve.plans.")]
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", [n for n in QUERIES if SQL[n] is None])
def test_queries_without_sql_run_over_all_pages_and_have_no_cross_join(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    pages = {(r.doc_id, r.page) for r in fx.pages(spark, SF_DIR).select("doc_id", "page").collect()}
    found = {(r.doc_id, r.page) for r in df.select("doc_id", "page").collect()}
    assert found and found <= pages
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize("name", [n for n in QUERIES if SQL[n] is not None])
def test_query_equals_sql_and_has_no_cross_join(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    ok, note = check.compare(df, con.sql(SQL[name]))
    assert ok, note
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEvalPython"):
        assert operator not in plan


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("shape", ["raw", "by document", "joined"])
def test_detection_reads_text_once_and_shuffles_none(spark, shape):
    pages = fx.pages(spark, SF_DIR)
    if shape == "by document":
        pages = pages.repartition("doc_id")
    if shape == "joined":
        pages = pages.join(fx.meta(spark, SF_DIR).select("doc_id"), "doc_id", "left_semi")
    df = detect.detect_tables(pages, fx.RULES)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Generate posexplode") == 1 and plan.count("_counts") > 0
    if shape == "raw":
        assert plan.count("FileScan") == 1 and plan.count("Exchange hash") == 1
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["consolidate", "analysis_totals", "summary_totals"])
def test_nothing_is_kept_between_calls(spark, name):
    plans = [QUERIES[name](spark, SF_DIR) for _ in range(2)]
    given = {f for f in plans[0].inputFiles() if SF_DIR in f}
    assert given and given == {f for f in plans[1].inputFiles() if SF_DIR in f}
    assert not (set(plans[0].inputFiles()) - given) & (set(plans[1].inputFiles()) - given)


def test_scan_gets_the_document_filter(spark):
    pages = fx.pages(spark, SF_DIR).filter("doc_id = 5")
    df = detect.element_results(pages, fx.RULES)
    assert "EqualTo(doc_id,5)" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("counts, pages", [
    ("detect_tables", "detected_pages"),
    ("detect_tables_channels", "detected_pages_channels"),
    ("detect_subset", "detected_pages_subset"),
    ("search_store", "search_store_pages"),
])
def test_every_detection_gives_its_pages_and_details(spark, counts, pages):
    rows = QUERIES[pages](spark, SF_DIR).collect()
    assert all(r.details for r in rows) and len(rows) == len({(r.table_name, r.doc_id, r.page) for r in rows})
    got = Counter((r.table_name, r.doc_id) for r in rows)
    assert got and got == {(r.table_name, r.doc_id): r.n_pages for r in QUERIES[counts](spark, SF_DIR).collect()}
