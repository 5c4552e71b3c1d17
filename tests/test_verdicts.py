"""The fold of hits to tables and documents in batches, against plain sums."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pagesieve.functions import verdicts

RULE = ["table_id", "table_name", "match_strategy", "min_elements", "min_percentage", "min_score", "total_elements", "total_weight"]


def tables(r):
    rows = []
    for t in range(12):
        strategy, name = r.choice(["all_elements", "min_count", "min_percentage", "weighted_score"]), r.choice([f"t{t % 7}", None])
        weights = [r.choice([0.1, 0.7, 1.0, 1e-17, 1e17]) for _ in range(r.randrange(1, 6))]
        rule = dict(zip(RULE, (t, name, strategy, 1, 0.3, 0.1, len(weights), math.fsum(weights))))
        rows += [{"phrase_id": r.randrange(0, 9) * 10, "max_errors": r.choice([0, 2, None]), "max_error_rate": 0.3, "weight": w, **rule} for w in weights]
    return rows


@pytest.mark.parametrize("seed", range(8))
def test_documents_of_batches(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(verdicts, "ELEMENTS", r.choice([1, 7, 1 << 20]))
    monkeypatch.setattr(verdicts, "SCORES", r.choice([0, 3, 1 << 22]))
    rows = tables(r)
    docs = sorted(r.choices(["a", "b", "c"], k=40)) + ["d"]
    pages = [[{"phrase_id": i * 10, "n_matches": r.choice([1, 2, 9]), "error_rate": r.choice([0.0, 0.5])} for i in range(12) if r.random() < 0.4] for _ in docs]
    kind = pa.list_(pa.struct([("phrase_id", pa.int64()), ("n_matches", pa.int32()), ("error_rate", pa.float64())]))
    docs, pages = [None, None, *docs], [pages[0], [], *pages]
    cuts = sorted({0, len(docs), *r.choices(range(len(docs)), k=4)})
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[a:b], pa.string()), pa.array(pages[a:b], kind)], ["doc_id", "hits"]) for a, b in zip(cuts, cuts[1:])]

    want = {}
    for doc, hits in zip(docs, pages):
        for t in range(12):
            mine = [(x, h) for x in rows if x["table_id"] == t for h in hits if h["phrase_id"] == x["phrase_id"]]
            if not mine:
                continue
            rule = mine[0][0]
            count = sum(x["max_errors"] is not None and h["n_matches"] <= x["max_errors"] + 1 and h["error_rate"] <= 0.3 for x, h in mine)
            share, weighted = count / rule["total_elements"], math.fsum((1 - h["error_rate"]) * x["weight"] for x, h in mine) / rule["total_weight"]
            met = {"all_elements": share == 1, "min_count": count >= 1, "min_percentage": share >= 0.3, "weighted_score": weighted >= 0.1}[rule["match_strategy"]]
            if met:
                want.setdefault((doc, rule["table_name"]), []).append(weighted if rule["match_strategy"] == "weighted_score" else share)
    schema = pa.schema([("phrase_id", pa.int64()), ("max_errors", pa.int32()), ("max_error_rate", pa.float64()), ("weight", pa.float64()), ("table_id", pa.int64()),
                        ("table_name", pa.string()), ("match_strategy", pa.string()), ("min_elements", pa.int32()), ("min_percentage", pa.float64()),
                        ("min_score", pa.float64()), ("total_elements", pa.int32()), ("total_weight", pa.float64())])
    made = verdicts.Tables(pa.Table.from_pylist(rows, schema), RULE)
    got = {}
    for doc, name, n, mean in verdicts.documents(made, iter(batches), 0.0):
        for d, k, c, m in zip(doc.to_pylist(), made.names.take(pa.array(name)).to_pylist(), n.tolist(), mean.tolist()):
            assert (d, k) not in got
            got[d, k] = (c, m)
    assert got == {k: (len(v), math.fsum(v) / len(v)) for k, v in want.items()} and got


def test_sums_are_rounded_once():
    r = random.Random(9)
    groups = [[r.choice([1e16, 1.0, -1e16, 0.1, 3e-17, 2.0**-60]) for _ in range(r.randrange(1, 12))] for _ in range(300)]
    heads = np.cumsum([0, *map(len, groups[:-1])])
    assert verdicts.exact_sums(np.array(sum(groups, [])), heads).tolist() == [math.fsum(g) for g in groups]
