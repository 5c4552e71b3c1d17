"""Ids that repeat with different rows, null ids and clashing columns: no text is lost, no value overwritten."""

import random

from pyspark.sql import functions as F

from pagesieve.llm import embedding_join, exact_dedup, jaccard_join, language_id, mixing, toxicity
from pagesieve.llm.shingles import BYTE, word_spans

A = "one two three four five six seven eight nine ten"
B = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int").repartition(3)


def test_exact_dedup_keeps_one_row_of_every_text(spark):
    rows = [(3, B), (5, A), (5, B), (None, A), (None, A + " "), (None, "x"), (7, "x"), (7, "x"), (8, "y z"), (8, "yz"), (9, None), (None, ""),
            (10, "solo"), (None, "alone"), (None, "alone"), (None, "single")]
    df = frame(spark, [(*r, "en", "a", i) for i, r in enumerate(rows)])
    kept = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.keep_first(df).collect()), key=str)
    want = [(3, B), (5, A), (7, "x"), (8, "y z"), (9, None), (10, "solo"), (None, "alone"), (None, "single")]
    # of equal texts the one with most code points: A with a space after it
    want[1] = (None, A + " ")
    assert kept == sorted(want, key=str)
    assert exact_dedup.keep_first(df).columns == df.columns
    assert exact_dedup.keep_first(df.limit(0)).count() == 0


def test_near_dedup_keeps_one_row_of_every_group(spark):
    near = A + " " + A.replace("ten", "")
    rows = [(3, B), (5, near), (5, B + " "), (6, near + " more"), (None, near), (None, "short text"), (11, "short text"), (12, None), (12, "")]
    df = frame(spark, [(*r, "en", "a", i) for i, r in enumerate(rows)])
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(df).collect()), key=str)
    assert kept == sorted([(3, B), (5, near), (11, "short text"), (12, None), (12, "")], key=str)
    assert jaccard_join.keep_one(df).columns == df.columns


def test_ids_with_several_texts_are_one_document(spark):
    rows = [(3, A), (4, B), (5, A), (5, B), (6, "other words than all of those above"), (6, None), (None, A), (9, A + " x"), (2, "z")]
    found = jaccard_join.groups(frame(spark, [(*r, "en", "a", 1) for r in rows]))
    got = sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str)
    assert got == sorted([(3, 3), (4, 3), (5, 3), (5, 3), (6, 6), (6, 6), (None, None), (9, 3), (2, 2)], key=str)


def test_vectors_that_share_an_id_are_vectors_each(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    found = embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]


def test_rows_of_the_mix_and_known_rows_are_as_given(spark, edges):
    given = {str(tuple(r)) for r in edges.collect()}
    assert {str(tuple(r)) for r in mixing.take(edges).collect()} <= given
    model = language_id.fit(edges)
    assert {str(tuple(r)) for r in language_id.keep_known(edges, model).collect()} <= given
    clash = spark.createDataFrame([(1, A, "en", "a", -1.5, -2.5, "q")], "doc_id long, text string, lang string, source string, size double, Score double, row string")
    assert all(tuple(r) == (1, A, "en", "a", -1.5, -2.5, "q") for r in mixing.take(clash).collect())
    assert [tuple(r) for r in language_id.keep_known(clash, language_id.fit(clash)).collect()] == [tuple(clash.first())]


def test_samples_are_bounded_where_ids_repeat(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(None, " ".join(rnd.choices("ab cd ef gh ij".split(), k=9)), "en", "a", 1) for _ in range(300)] + [(1, A, "de", "a", 1)] * 300
    seen = []
    real = language_id.fit_vectors
    monkeypatch.setattr(language_id, "fit_vectors", lambda counts, names: seen.append(len(counts)) or real(counts, names))
    language_id.fit(frame(spark, rows), sample=20)
    assert 10 < seen[0] <= 80
    labels = spark.createDataFrame([(1, i % 2) for i in range(500)], "doc_id long, toxic int")
    drawn = []
    monkeypatch.setattr(toxicity, "_shortened", lambda chosen, sample: drawn.append(chosen.count()) or chosen.limit(0))
    toxicity.fit(frame(spark, rows), labels, sample=20)
    assert drawn[0] <= 160


def test_hashes_do_not_depend_on_runs(monkeypatch):
    import numpy as np

    from pagesieve.llm import shingles

    text = ("word " * 40 + "x" * 300 + " é😀 " + "tail" * 9).encode()
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, 100, len(text)])
    whole = word_spans(data, offsets, BYTE)
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 16)
    for one, two in zip(whole, word_spans(data, offsets, BYTE)):
        assert (one == two).all()


def test_exact_dedup_in_rounds_shuffles_few_unique_rows_at_any_size(spark):
    draw = random.Random(3)
    for n in (400, 900, 1800):
        texts = [f"text {draw.randrange(10**12)}" for _ in range(n)]
        texts += ["hot copy"] * (n // 3) + [t + " " for t in texts[::10]] + [None, ""]
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        seen = exact_dedup.possible_repeats(exact_dedup.fingerprints(df), most_words=64)  # several rounds of 256 rows at most each
        many = spark.createDataFrame(seen.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("maybe").alias("all")).toPandas())
        assert many.filter("n > 1 and not all").count() == 0
        alone = seen.join(many.filter("n = 1"), "text_sha256")
        assert alone.filter("maybe").count() < 0.03 * n
        groups = {}
        for i, text in rows:
            groups.setdefault("".join((text or "").split()), []).append((-len(text or ""), i))
        want = sorted((i, min(g)[1], len(g)) for g in groups.values() for _, i in g)
        got = exact_dedup.exact_dedup(df, most_words=64).select("doc_id", "keep_id", "group_size").collect()
        assert sorted(map(tuple, got)) == want
