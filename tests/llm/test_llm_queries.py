"""Registered queries against their SQL, and the pipeline against its stages done by brute force."""

import pytest
from cases import SF
from test_operators import PATH, brute_components

import __spark_entry__ as entry_module
import check
import corpus_pipeline
from pagesieve.llm import byte_bpe, language_id, queries
from pagesieve.llm.tables import fold, table


def test_all_operators_and_the_pipeline_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, name):
    ok, note = check.compare(queries.QUERIES[name](spark, SF), check.duck(SF).sql(queries.SQL[name]))
    assert ok, note


def test_no_python_runs_for_native_operators(spark):
    for name in ("op3_exact_dedup", "op5_secret_scan"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_queries_without_sql_read_all_rows(spark):
    docs = table(spark, SF, "documents").count()
    for name in ("op1_jaccard_join", "op8_byte_bpe", "op9_language_id"):
        assert queries.QUERIES[name](spark, SF).count() == docs


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs.filter(fold(docs["doc_id"], 4) != 2))
    known = [r for r in language_id.predict(docs, model).collect() if not r["rejected"]]
    texts = {}
    for r in sorted(known, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        key = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        texts.setdefault(key, r)
    unique = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in texts.values()]
    root = brute_components(unique)
    kept = {i: (t, s) for i, t, _, s in unique if root[i] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r["doc_id"] for r in out} <= set(kept)
    ranks = byte_bpe.read_ranks(PATH)
    back = {v: k for k, v in ranks.items()}
    words: dict[str, int] = {}
    times: dict[int, int] = {}
    import numpy as np

    for r in out:
        text, source = kept[r["doc_id"]]
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert b"".join(back[i] for i in ids) == (text or "").encode() and r["round_trip"] and r["n_tokens"] == len(ids)
        words[source] = words.get(source, 0) + len((text or "").split())
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    total = sum(len((t or "").split()) for t, _ in kept.values())
    assert abs(sum(words.values()) - 1.5 * total) < 0.03 * 1.5 * total


