import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesieve.functions.numbers import compensated_sum, fixed, mean
from pagesieve.functions.text import (
    WHITESPACE,
    count_literal,
    literal_pattern,
    sanitize,
    strip,
)

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in sorted(df.select("i", column).collect())]


def test_whitespace_is_complete():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@SLOW
@given(st.lists(st.text(st.sampled_from("a \t\n\x1c\x85 　é😀"), max_size=12), min_size=200, max_size=300))
def test_strip_equals_python(spark, texts):
    assert values(spark, [(t,) for t in texts], "t string", strip(F.col("t"))) == [t.strip() for t in texts]


@SLOW
@given(st.lists(
    st.tuples(st.text(st.sampled_from("ab.😀"), max_size=20), st.text(st.sampled_from("ab.😀"), min_size=1, max_size=3)),
    min_size=200, max_size=300,
))
def test_count_equals_python(spark, pairs):
    counted = values(spark, pairs, "t string, n string", count_literal(F.col("t"), F.col("n")))
    assert counted == [t.count(n) for t, n in pairs]


def test_literal_pattern_quotes_everything(spark):
    phrases = ["a.b", "x\\Ey", "\\E", "(", "a\\Qb", "\\"]
    for phrase in phrases:
        text = f"__{phrase}__{phrase.upper()}"
        expected = [m.start() for m in re.finditer(re.escape(phrase), text, re.IGNORECASE)]
        found = values(spark, [(text,)], "t string", F.regexp_count("t", F.lit(literal_pattern(phrase, False))))
        assert found == [len(expected)]


def test_fixed_rounds_like_python(spark):
    numbers = [6.25, 0.15, 2.675, 1 / 3, 0.0015, 0.6825, 12345.65, 0.05, 99.95, 0.0] + [i / 37 for i in range(200)]
    for decimals in (1, 2, 3):
        expected = [f"{n:.{decimals}f}" for n in numbers]
        assert values(spark, [(n,) for n in numbers], "x double", fixed(F.col("x"), decimals)) == expected


def test_sanitize(spark):
    cases = {
        "a____b": "a_b", "a__b": "a__b", "é": "No text available", "": "", None: "",
        " a \n\n\n b\t": "a b", "x" * 501: "x" * 497 + "...", "y" * 500: "y" * 500, "a\u00e9b": "ab",
    }
    got = values(spark, [(k,) for k in cases], "t string", sanitize(F.col("t")))
    assert got == list(cases.values())


@SLOW
@given(st.lists(st.lists(st.sampled_from([0.1, 0.2, 0.3, 0.7, 1.0, 1 / 3, 2.5, 1e-9]), max_size=12), min_size=50, max_size=80))
def test_sums_equal_python(spark, lists):
    sums = values(spark, [(x,) for x in lists], "x array<double>", compensated_sum(F.col("x")))
    assert sums == [float(sum(x)) for x in lists]


def test_mean_equals_python(spark):
    shares = [0.7, 0.1, 1 / 3, 2 / 3, 0.9 / 2.7, 1.0, 0.0, 0.4, 0.55]
    lists = [[0.7] * 3, [0.1] * 10, [1.0]] + [
        [shares[(i * k + j) % len(shares)] for j in range(i)] for i in range(2, 40) for k in (1, 2, 5)
    ]
    rows = [(i, x) for i, xs in enumerate(lists) for x in [*xs, None]]
    df = spark.createDataFrame(rows, "i int, x double").repartition(4)
    means = [r[1] for r in df.groupBy("i").agg(mean(F.col("x"))).orderBy("i").collect()]
    assert means == [sum(xs) / len(xs) for xs in lists]
    assert df.limit(0).agg(mean(F.col("x"))).first()[0] is None


def test_running_starts(spark):
    from pyspark.sql import functions as F

    from pagesieve.functions.text import running_starts

    rows = [([],), ([5],), (list(range(1000)),)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", running_starts(F.col("v"), 16).alias("s")).collect()
    assert all(r.s == [sum(r.v[:i]) for i in range(len(r.v))] for r in got)
