import random
import re

import pytest

from pagesieve import Phrase, TableRule
from pagesieve.functions.blocks import only_documents
from pagesieve.operators import detect

PAGES = "doc_id string, page int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def listed(pages, rules, *args, **how):
    """Detections with the lists of their pages."""
    return detect.listed(detect.detected_pages(pages, rules, *args, **how))


BALANCE = TableRule(
    "Balance",
    (Phrase("consolidated balance sheets", max_errors=3), Phrase("Current assets", match_case=True), Phrase("Total assets")),
    "min_count", min_elements=2,
)
STATEMENTS = [
    ("d", 1, "CONSOLIDATED BALANCE SHEETS\n(in millions)\nCurrent assets:\nCash 1,234\nTotal assets 12,345"),
    ("d", 2, "Current assets:\nReceivables 2,345\nTotal assets 12,345"),
    ("d", 3, "Notes\nNote 1: accounting policies"),
]


def test_statement_pages(spark):
    (row,) = detect.detect_tables(frame(spark, STATEMENTS), [BALANCE]).collect()
    assert row[:4] == ("Balance", "d", True, 2) and row.confidence_score == pytest.approx(0.8333, abs=1e-4)
    (row,) = listed(frame(spark, STATEMENTS), [BALANCE]).collect()
    assert row.pages_found == [1, 2] and row.found
    assert row.confidence_score == pytest.approx(0.8333, abs=1e-4)
    assert row.match_details == "Page 1: Found 3/3 elements (min: 2); Page 2: Found 2/3 elements (min: 2)"


def test_min_confidence_drops_pages(spark):
    (row,) = listed(frame(spark, STATEMENTS), [BALANCE], min_confidence=0.9).collect()
    assert row.pages_found == [1] and row.confidence_score == 1.0


@pytest.mark.parametrize("strategy, found, score, details", [
    ("all_elements", False, 0.75, "Found 3/4 elements"),
    ("min_count", True, 0.75, "Found 3/4 elements (min: 3)"),
    ("min_percentage", True, 0.75, "Found 3/4 elements (75.0%, min: 60.0%)"),
    ("weighted_score", True, 0.75, "Weighted score: 0.750 (min: 0.700)"),
])
def test_strategies(spark, strategy, found, score, details):
    rule = TableRule("t", tuple(Phrase(f"Element {i}") for i in range(1, 5)), strategy)
    (row,) = detect.table_verdicts(frame(spark, [("d", 1, "element 1, Element 2 and ELEMENT 3")]), [rule]).collect()
    assert (row.found, row.score, row.details) == (found, score, details)


def test_percentage_ties_round_to_even(spark):
    rule = TableRule("t", tuple(Phrase(f"<{i}>") for i in range(16)), "min_percentage", min_percentage=0.0)
    (row,) = detect.table_verdicts(frame(spark, [("d", 1, "<3>")]), [rule]).collect()
    assert row.details == f"Found 1/16 elements ({1 / 16:.1%}, min: 0.0%)" and "6.2%" in row.details


def test_occurrence_cap_and_score(spark):
    rule = TableRule("t", (Phrase("Note", max_errors=1, match_case=True, weight=0.8),), "weighted_score", min_score=0.5)
    (element,) = detect.element_results(frame(spark, [("d", 1, "Note Note Note note")]), [rule]).collect()
    assert (element.n_matches, element.found, element.score, element.error_rate) == (3, False, 0.8, 0.0)
    (verdict,) = detect.page_verdicts(frame(spark, [("d", 1, "Note Note Note")]), [rule]).collect()
    assert verdict.found_count == 0 and verdict.score == 1.0


def test_blank_and_null_pages(spark):
    rows = [("d", 1, ""), ("d", 2, " \n\t "), ("d", 3, None)]
    rule = TableRule("t", (Phrase("a"),), "all_elements")
    found = detect.element_results(frame(spark, rows), [rule]).collect()
    assert [(r.n_matches or 0, bool(r.found)) for r in found] == [(0, False)] * 3
    assert detect.detect_tables(frame(spark, rows), [rule]).collect() == []


def test_rules_met_without_hits(spark):
    rule = TableRule("t", (Phrase("zzz"),), "min_percentage", min_percentage=0.0)
    (row,) = listed(frame(spark, [("d", 7, "text")]), [rule]).collect()
    assert row.pages_found == [7] and row.confidence_score == 0.0


def test_special_letters_match_like_regex(spark):
    texts = ["ſtraße \u212aelvin MASSE", "ΟΔΟΣ οδος οδοσ", "µ Μ μ", "plain s and k", "ISTANBUL ıstanbul"]
    phrases = ["s", "k", "οδοσ", "μ", "µ", "ı", "straße", "Σ"]
    rule = [TableRule(p, (Phrase(p, max_errors=99),), "all_elements") for p in phrases]
    rows = [("d", i, t) for i, t in enumerate(texts)]
    for compiled in (True, False):
        got = {
            (r.table_name, r.page): r.n_matches
            for r in detect.element_results(frame(spark, rows), rule, compiled).collect()
        }
        for p in phrases:
            for _, i, t in rows:
                assert got[p, i] == len(re.findall(re.escape(p), t, re.IGNORECASE)), (p, t)


def random_pages(seed, n=60):
    r = random.Random(seed)
    words = ["the ", "and ", "of ", "Total", "total", "a", "aa", "\n", ".", "é", "😀"]
    return [(f"d{r.randrange(6)}", i, "".join(r.choices(words, k=r.randrange(40)))) for i in range(1, n)]


RULES = [
    TableRule("a", (Phrase("the "), Phrase("AND "), Phrase("aa", max_errors=4)), "min_count", min_elements=2),
    TableRule("b", (Phrase("total", match_case=True), Phrase("of the"), Phrase("é")), "min_percentage", min_percentage=0.3),
    TableRule("c", (Phrase("the ", weight=0.4), Phrase("total", max_errors=0)), "weighted_score", min_score=0.5),
    TableRule("d", (Phrase("."), Phrase("a")), "all_elements"),
]


def expected_detections(rows, rules):
    """Plain Python over a handful of pages."""
    out = {}
    for doc, page, text in sorted(rows, key=lambda x: (x[0], x[1])):
        for rule in rules:
            found = score = 0
            for p in rule.phrases:
                n = len(re.findall(re.escape(p.search_text), text, 0 if p.match_case else re.IGNORECASE))
                found += 1 <= n <= p.max_errors + 1
                score += p.weight if n else 0
            share, total = found / len(rule.phrases), sum(p.weight for p in rule.phrases)
            ok, value = {
                "all_elements": (found == len(rule.phrases), share),
                "min_count": (found >= rule.min_elements, share),
                "min_percentage": (share >= rule.min_percentage, share),
                "weighted_score": (score / total >= rule.min_score, score / total),
            }[rule.match_strategy]
            if ok:
                out.setdefault((doc, rule.name), []).append((page, value))
    return {k: ([p for p, _ in v], pytest.approx(sum(x for _, x in v) / len(v))) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("compiled", [True, False])
def test_detection_equals_plain_python(spark, seed, compiled):
    rows = random_pages(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    got = listed(frame(spark, shuffled).repartition(3), RULES, compiled=compiled).collect()
    assert {(r.doc_id, r.table_name): (r.pages_found, r.confidence_score) for r in got} == expected_detections(rows, RULES)


def test_a_document_of_any_size_gives_one_row(spark):
    rows = [("big", p, "the and ") for p in range(5, 48, 2)] + [("big", 25_001, "the and "), ("small", 10001, "the and ")]
    rule = TableRule("t", (Phrase("the "), Phrase("and ")), "all_elements")
    got = {r.doc_id: r[3:] for r in detect.detect_tables(frame(spark, rows), [rule]).collect()}
    assert got == {"big": (23, 1.0), "small": (1, 1.0)}
    assert len({(r.doc_id, r.page) for r in detect.detected_pages(frame(spark, rows), [rule]).collect()}) == 24


def test_only_empty_results_are_not_found_whatever_the_rule(spark):
    rules = [
        TableRule("pct", (Phrase("zzz"),), "min_percentage", min_percentage=0.0),
        TableRule("cnt", (Phrase("zzz"), Phrase("a")), "min_count", min_elements=2),
    ]
    pages = frame(spark, [("d", 1, "text"), ("d", 2, "text")])
    results = detect.element_results(pages, rules)
    got = {(r.page, r.table_name): r[3:] for r in detect.verdicts_of_results(pages, rules, results.filter("page = 1")).collect()}
    assert got == {
        (1, "pct"): (True, 0.0, "Found 0/1 elements (0.0%, min: 0.0%)"), (2, "pct"): (False, 0.0, "Found 0/1 elements"),
        (1, "cnt"): (False, 0.0, "Found 0/2 elements (min: 2)"), (2, "cnt"): (False, 0.0, "Found 0/2 elements"),
    }
    verdicts = {(r.page, r.table_name): (r.found, r.score, r.details) for r in detect.table_verdicts(pages, rules).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {k: v for k, v in verdicts.items() if k[0] == 1}


def test_positions_count_characters(spark):
    text = "😀ab AB x.y\\Ez ab x.y\\ez aaaa"
    rule = TableRule("t", (Phrase("ab"), Phrase("x.y\\Ez"), Phrase("aa"), Phrase("😀")), "min_count", min_elements=1)
    got = detect.match_positions(frame(spark, [("d", 1, text), ("d", 2, "none")]), [rule]).collect()
    expected = [
        (i, k, m.start(), m.group())
        for i, p in enumerate(rule.phrases)
        for k, m in enumerate(re.finditer(re.escape(p.search_text), text, re.IGNORECASE))
    ]
    assert sorted((r.elem_idx, r.occurrence, r.position, r.matched_text) for r in got) == sorted(expected)


def test_condition_matrix_and_evidence(spark):
    meta = spark.createDataFrame([("d", "d.pdf", "/x/d.pdf", 3)], "doc_id string, file_name string, file_path string, page_count int")
    (one, two) = detect.condition_matrix(frame(spark, STATEMENTS), meta, [BALANCE, RULES[3]]).orderBy("page").collect()
    assert one.Balance and not one.d and two.Balance and one.file_name == "d.pdf"
    evidence = detect.element_evidence(frame(spark, STATEMENTS), [BALANCE]).collect()
    assert sorted((r.page, r.elem_idx, r.found) for r in evidence) == [
        (1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, True), (2, 2, True)
    ]


def test_paths_and_summaries(spark):
    meta = spark.createDataFrame([("d", "C:\\in\\d.pdf")], "doc_id string, file_path string")
    rows = STATEMENTS + [("e", 1, STATEMENTS[0][2])]
    found = detect.detect_tables(frame(spark, rows), [BALANCE])
    paths = {r.doc_id: r.file_path for r in detect.with_file_paths(found, meta).collect()}
    assert paths == {"d": "C:/in/d.pdf", "e": ""}
    totals = detect.summary_totals(found, frame(spark, rows + [("f", 1, "")])).first()
    assert (totals.documents_with_hits, totals.tables_found, totals.documents_searched) == (2, 2, 3)
    assert {r.total_occurrences for r in detect.summary_by_type(found).collect()} == {2}
    only = only_documents(frame(spark, rows), spark.createDataFrame([("e",)], "doc_id string"))
    assert {r.doc_id for r in detect.detect_tables(only, [BALANCE]).collect()} == {"e"}


@pytest.mark.parametrize("compiled", [True, False])
def test_scores_meet_thresholds_like_python_sums(spark, compiled):
    rule = TableRule("t", tuple(Phrase(f"<{i}>", weight=0.1) for i in range(10)), "weighted_score", min_score=1.0)
    text = "".join(f"<{i}>" for i in range(10))
    (row,) = detect.detect_tables(frame(spark, [("d", 1, text)]), [rule], 1.0, compiled=compiled).collect()
    assert row.confidence_score == 1.0
    part = TableRule("p", (Phrase("a", weight=0.1), Phrase("b", weight=0.2), Phrase("c", weight=0.7)), "weighted_score", min_score=0.3)
    score = sum([0.1, 0.2]) / sum([0.1, 0.2, 0.7])
    got = detect.detect_tables(frame(spark, [("d", 1, "a b")]), [part], compiled=compiled).collect()
    assert len(got) == (score >= 0.3) and all(r.confidence_score == score for r in got)


def test_many_phrases(spark):
    rules = [TableRule(f"t{j}", tuple(Phrase(f"w{j}x{i} ") for i in range(20)), "min_count", min_elements=1) for j in range(60)]
    rows = [("d", p, f"w{p}x3 w{p + 1}x0 ") for p in range(1, 30)]
    got = {(r.table_name, tuple(r.pages_found)) for r in listed(frame(spark, rows), rules).collect()}
    assert ("t1", (1,)) in got and ("t5", (4, 5)) in got and len(got) == 30
