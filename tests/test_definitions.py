import json

import pytest

from pagesieve import Phrase, TableRule
from pagesieve.definitions import rules_from_frame, rules_in_parts
from pagesieve.sources import definitions

FILE = {
    "description": "two tables",
    "tables": [
        {"name": "Cover", "match_strategy": "min_count", "min_elements": 2,
         "text_elements": [{"search_text": "Borrower", "max_errors": 0}, {"search_text": "Tax", "match_case": True, "weight": 0.5}]},
        {"name": "Income", "text_elements": [{"search_text": w, "max_error_rate": 0.1} for w in ("Revenue", "Cost", "Net")]},
    ],
}


def test_definition_file(spark, tmp_path):
    path = tmp_path / "tables.json"
    path.write_text(json.dumps(FILE, indent=2))
    frame = definitions.read_definitions(spark, str(path))
    rules = rules_from_frame(definitions.valid_definitions(frame))
    assert [r.name for r in rules] == ["Cover", "Income"]
    assert rules[0].phrases[1] == Phrase("Tax", match_case=True, weight=0.5)
    assert rules[1].match_strategy == "min_count" and rules[1].min_elements == 3 and rules[1].min_score == 0.7
    assert rules == [TableRule.from_dict(t) for t in FILE["tables"]]
    elements = definitions.definition_elements(frame).collect()
    assert [(e.name, e.elem_idx, e.max_errors) for e in elements][:3] == [("Cover", 0, 0), ("Cover", 1, 2), ("Income", 0, 2)]


BROKEN = [
    ({"text_elements": [{"search_text": " \t"}] * 3}, "blank search_text"),
    ({"text_elements": [{"search_text": "a", "max_errors": -1}] * 3}, "negative max_errors"),
    ({"text_elements": [{"search_text": "a", "max_error_rate": 1.1}] * 3}, "max_error_rate out of range"),
    ({"text_elements": [{"search_text": "a", "weight": 0.0}] * 3}, "weight not positive"),
    ({"text_elements": []}, "no elements"),
    ({"text_elements": [{"search_text": "a"}] * 3, "match_strategy": "some"}, "unknown match_strategy"),
    ({"text_elements": [{"search_text": "a"}] * 3, "min_elements": 0}, "min_elements below 1"),
    ({"text_elements": [{"search_text": "a"}] * 2}, "min_elements above number of elements"),
    ({"text_elements": [{"search_text": "a"}] * 3, "min_percentage": -0.1}, "min_percentage out of range"),
    ({"text_elements": [{"search_text": "a"}] * 3, "min_score": 2.0}, "min_score out of range"),
]


@pytest.mark.parametrize("table, violation", BROKEN)
def test_violations(spark, table, violation):
    rows = spark.createDataFrame([(json.dumps({"tables": [{"name": "t", **table}]}),)], "json string")
    frame = definitions.parse_definitions(rows, "json")
    assert definitions.with_violations(frame).first().violations == [violation]
    assert definitions.valid_definitions(frame).count() == 0
    with pytest.raises(ValueError):
        TableRule.from_dict({"name": "t", **table})
    with pytest.raises(Exception, match=violation):
        definitions.require_valid(frame).collect()


def test_unknown_fields_are_ignored():
    table = {"name": "t", "extra": 1, "text_elements": [{"search_text": "a", "note": "x"}], "min_elements": 1}
    assert TableRule.from_dict(table).phrases == (Phrase("a"),)


def test_rules_in_parts_find_what_all_rules_find(spark):
    from pagesieve.operators import detect

    tables = [{"name": f"t{i}", "min_elements": 1, "text_elements": [{"search_text": f"w{i}x"}]} for i in range(30)]
    rows = spark.createDataFrame([(json.dumps({"tables": tables}),)], "json string")
    frame = definitions.parse_definitions(rows, "json")
    pages = spark.createDataFrame([("d", p, f"w{p}x w{2 * p}x") for p in range(1, 20)], "doc_id string, page int, text string")
    parts = list(rules_in_parts(frame, 20))
    assert len(parts) > 1 and sum(map(len, parts)) == 30
    whole = detect.detect_tables(pages, rules_from_frame(frame)).collect()
    assert sorted(map(tuple, detect.detect_in_parts(pages, parts).collect())) == sorted(map(tuple, whole))
