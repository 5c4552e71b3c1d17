"""Table definitions: named sets of phrases plus a match rule.

Definitions are configuration written by people, so they live on the driver and travel
to the tasks as literals of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The four match rules. The defaults of the fields below are fixed values as well.
STRATEGIES = ("all_elements", "min_count", "min_percentage", "weighted_score")


@dataclass(frozen=True)
class Phrase:
    search_text: str
    max_errors: int = 2
    max_error_rate: float = 0.3
    match_case: bool = False
    weight: float = 1.0
    description: str = ""

    def __post_init__(self):
        if not self.search_text.strip():
            raise ValueError("a phrase needs some text to look for")
        if self.max_errors < 0:
            raise ValueError("max_errors must be at least 0")
        if not 0.0 <= self.max_error_rate <= 1.0:
            raise ValueError("max_error_rate must be between 0 and 1")
        if not self.weight > 0:
            raise ValueError("weight must be greater than 0")


@dataclass(frozen=True)
class TableRule:
    name: str
    phrases: tuple[Phrase, ...]
    match_strategy: str = "min_count"
    min_elements: int = 3
    min_percentage: float = 0.6
    min_score: float = 0.7
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "phrases", tuple(self.phrases))
        if not self.phrases:
            raise ValueError("a table needs at least one phrase")
        if self.match_strategy not in STRATEGIES:
            raise ValueError(f"unknown match strategy: {self.match_strategy}")
        if self.min_elements < 1:
            raise ValueError("min_elements must be at least 1")
        if not 0.0 <= self.min_percentage <= 1.0:
            raise ValueError("min_percentage must be between 0 and 1")
        if not 0.0 <= self.min_score <= 1.0:
            raise ValueError("min_score must be between 0 and 1")
        if self.match_strategy == "min_count" and self.min_elements > len(self.phrases):
            raise ValueError("min_elements asks for more phrases than the table has")

    @classmethod
    def from_dict(cls, table: Mapping) -> TableRule:
        """Build a rule from one entry of a definition file; absent fields take their defaults, unknown ones are ignored."""
        phrases = [Phrase(**_given(element, Phrase)) for element in table.get("text_elements") or []]
        return cls(phrases=tuple(phrases), **_given(table, cls))

    def matches_without_hits(self) -> bool:
        """True if a page can qualify although none of the phrases occurs on it."""
        return (self.match_strategy == "min_percentage" and self.min_percentage == 0.0) or (
            self.match_strategy == "weighted_score" and self.min_score == 0.0
        )


def _given(values: Mapping, kind: type) -> dict:
    known = {f.name for f in fields(kind)} - {"phrases"}
    return {k: v for k, v in values.items() if k in known and v is not None}


def defaults(kind: type) -> dict:
    """The default values of a definition's fields."""
    return {f.name: f.default for f in fields(kind) if f.default is not MISSING}


#: Definitions become literals of a plan; more than so many do not go into one.
MOST_RULES = 5_000


def rules_from_frame(definitions: DataFrame) -> list[TableRule]:
    """Rules out of a definition DataFrame as read by ``sources.definitions``, in file order.

    A table of more than ``MOST_RULES`` definitions is taken in parts, see ``rules_in_parts``.
    """
    if definitions.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} definitions: take them by rules_in_parts")
    ordered = definitions.orderBy("table_idx") if "table_idx" in definitions.columns else definitions
    wanted = [
        "name", "text_elements", "match_strategy", "min_elements",
        "min_percentage", "min_score", "description",
    ]
    return [TableRule.from_dict(row.asDict(recursive=True)) for row in ordered.select(wanted).collect()]


def rules_in_parts(definitions: DataFrame, size: int = MOST_RULES) -> Iterator[list[TableRule]]:
    """The rules of a definition table of any length, in parts of about half of ``size`` by a hash of the name.

    Tables are found independently of each other, so the detections of all parts together are those of the
    whole table (``detect.detect_in_parts``), at the price of one pass over the pages for each part.
    """
    parts = 2 * definitions.count() // size + 1
    for part in range(parts):
        chosen = definitions.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        if rules := rules_from_frame(chosen):
            yield rules


def element_rows(rules: Iterable[TableRule]) -> list[dict]:
    """One plain dict per phrase with its table and index."""
    return [
        {"table_name": rule.name, "elem_idx": idx, **phrase.__dict__}
        for rule in rules
        for idx, phrase in enumerate(rule.phrases)
    ]
