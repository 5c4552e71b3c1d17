"""Which pages of which documents carry a declared table.

The text of a page is read in one narrow pass: phrase counts, element results and table
verdicts are array expressions over literals, so nothing is joined or shuffled until the
sums over the qualifying pages are rolled up per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.definitions import TableRule
from pagesieve.functions.blocks import PAGE_BLOCK, document_blocks, page_block
from pagesieve.functions.frames import one_row, with_once
from pagesieve.functions.numbers import compensated_sum, fixed, mean
from pagesieve.functions.text import (
    count_literal,
    has_special_letters,
    is_special_phrase,
    literal_pattern,
    running_starts,
)

# Unless ``compiled`` is given: up to this many distinct phrases each one becomes its own compiled expression;
# beyond it one array function walks the phrase list, so the plan stays small. Rows are the same either way; the
# compiled form drops pages on which no rule can be met before results are built, the walk those without any phrase.
COMPILED_PHRASES = 64


def _distinct_phrases(rules: Sequence[TableRule]) -> list[tuple[str, bool]]:
    return list(dict.fromkeys((p.search_text, p.match_case) for r in rules for p in r.phrases))


def _is_compiled(rules: Sequence[TableRule], wanted: bool | None) -> bool:
    return len(_distinct_phrases(rules)) <= COMPILED_PHRASES if wanted is None else wanted


def _literal_rules(rules: Sequence[TableRule]) -> Column:
    """The rules as one constant array; ``slot`` points into the array of phrase counts."""
    slots = {key: i for i, key in enumerate(_distinct_phrases(rules))}

    def element(idx, p):
        return F.struct(
            F.lit(idx).alias("elem_idx"),
            F.lit(slots[p.search_text, p.match_case]).alias("slot"),
            F.lit(p.max_errors).alias("max_errors"),
            F.lit(float(p.max_error_rate)).alias("max_error_rate"),
            F.lit(float(p.weight)).alias("weight"),
        )

    def table(r):
        return F.struct(
            F.lit(r.name).alias("table_name"),
            F.lit(r.match_strategy).alias("match_strategy"),
            F.lit(r.min_elements).alias("min_elements"),
            F.lit(float(r.min_percentage)).alias("min_percentage"),
            F.lit(float(r.min_score)).alias("min_score"),
            F.lit(float(sum(p.weight for p in r.phrases))).alias("total_weight"),
            F.array(*[element(i, p) for i, p in enumerate(r.phrases)]).alias("elements"),
        )

    return F.array(*[table(r) for r in rules])


def plain_count(phrase: Column, match_case: Column) -> Column:
    return F.when(match_case, count_literal(F.col("text"), phrase)).otherwise(
        count_literal(F.col("_lowered"), F.lower(phrase))
    )


def special_count(phrase: Column, match_case: Column, pattern: Column) -> Column:
    return F.when(match_case, count_literal(F.col("text"), phrase)).otherwise(
        F.regexp_count(F.col("text"), pattern)
    )


def special_error(phrase: Column, match_case: Column, pattern: Column) -> Column:
    """Share of missing letters in the first match; only special letters can make it differ from 0."""
    first = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    lost = 1 - F.length(F.lower(first)) / F.length(F.lower(phrase))
    return F.when(match_case, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), lost))


def with_phrase_counts(
    pages: DataFrame, rules: Sequence[TableRule], compiled: bool | None = None
) -> DataFrame:
    """Add ``_counts`` (occurrences per distinct phrase) and ``_errors`` (null on ordinary pages).

    Only the count on ordinary pages is worth compiling; the rare pages with special letters
    walk the phrase list, which keeps the generated code small enough to be optimized.
    """
    phrases = _distinct_phrases(rules)
    listed = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.lit(literal_pattern(t, c)).alias("p"))
        for t, c in phrases
    ])
    if _is_compiled(rules, compiled):
        plain = F.array(*[plain_count(F.lit(t), F.lit(c)) for t, c in phrases])
    else:
        plain = F.transform(listed, lambda e: plain_count(e["t"], e["c"]))
    special = F.lit(True) if any(is_special_phrase(t) for t, c in phrases if not c) else (
        has_special_letters(F.col("text"))
    )

    def walk(fn):
        return F.when(F.col("_special"), F.transform(listed, lambda e: fn(e["t"], e["c"], e["p"])))

    prepared = pages.withColumns({"_lowered": F.lower("text"), "_special": special})
    counted = with_once(prepared, {
        "_counts": F.coalesce(walk(special_count), plain),
        "_errors": walk(special_error),
    })
    return counted.drop("_lowered", "_special")


def element_result(e: Column) -> Column:
    """Occurrences, error rate, decision and score of one element on one page.

    ``max_errors`` bounds how often the phrase may occur; the score ignores that bound.
    """
    n, rate, found, score = _measures(e)
    return F.struct(
        e["elem_idx"].alias("elem_idx"),
        n.alias("n_matches"),
        found.alias("found"),
        rate.alias("error_rate"),
        score.alias("score"),
    )


def _measures(e: Column | Mapping[str, Column]) -> tuple[Column, Column, Column, Column]:
    n = F.get(F.col("_counts"), e["slot"])
    rate = F.when(n == 0, 1.0).otherwise(F.coalesce(F.get(F.col("_errors"), e["slot"]), F.lit(0.0)))
    found = (n >= 1) & (n <= e["max_errors"] + 1) & (rate <= e["max_error_rate"])
    return n, rate, found, F.when(n == 0, 0.0).otherwise((1 - rate) * e["weight"])


def decide(
    r: Column | Mapping[str, Column], count: Column, total: Column, weight: Column
) -> tuple[Column, Column]:
    """Found flag and score of a table from its found elements and their weighted sum."""
    strategy, share = r["match_strategy"], count / total
    weighted = F.when(r["total_weight"] > 0, weight / r["total_weight"]).otherwise(0.0)
    found = (
        F.when(total == 0, F.lit(False))
        .when(strategy == "all_elements", count == total)
        .when(strategy == "min_count", count >= r["min_elements"])
        .when(strategy == "min_percentage", share >= r["min_percentage"])
        .otherwise(weighted >= r["min_score"])
    )
    return found, F.when(total == 0, 0.0).when(strategy == "weighted_score", weighted).otherwise(share)


def _may_qualify(rules: Sequence[TableRule], min_confidence: float) -> Column:
    """True on pages on which some rule can be met, as one compiled expression over the counts.

    Sums are plain here and get some slack; the verdict itself decides.
    """
    slack = 1e-9
    slots = {key: i for i, key in enumerate(_distinct_phrases(rules))}
    met = []
    for r in rules:
        measures = [
            _measures({
                "slot": F.lit(slots[p.search_text, p.match_case]),
                "max_errors": F.lit(p.max_errors),
                "max_error_rate": F.lit(float(p.max_error_rate)),
                "weight": F.lit(float(p.weight)),
            })
            for p in r.phrases
        ]
        limits = {
            "match_strategy": F.lit(r.match_strategy),
            "min_elements": F.lit(r.min_elements),
            "min_percentage": F.lit(float(r.min_percentage)),
            "min_score": F.lit(r.min_score - slack),
            "total_weight": F.lit(float(sum(p.weight for p in r.phrases))),
        }
        count = reduce(add, [found.cast("int") for _, _, found, _ in measures])
        weight = reduce(add, [score for _, _, _, score in measures], F.lit(0.0))
        found, score = decide(limits, count, F.lit(len(r.phrases)), weight)
        met.append(found & (score >= min_confidence - slack))
    return reduce(or_, met)


def with_element_results(
    pages: DataFrame,
    rules: Sequence[TableRule],
    compiled: bool | None = None,
    qualifying: float | None = None,
) -> DataFrame:
    """Add ``_tables``: per rule its thresholds and the element results of this page.

    With ``qualifying`` given, pages on which no rule is met with that score may be dropped
    before results are built.
    """
    counted = with_phrase_counts(pages, rules, compiled)
    if qualifying is not None:
        if _is_compiled(rules, compiled):
            counted = counted.filter(_may_qualify(rules, qualifying))
        elif not any(r.matches_without_hits() for r in rules):
            counted = counted.filter(F.exists("_counts", lambda n: n > 0))
    tables = F.transform(
        _literal_rules(rules),
        lambda r: r.withField("elements", F.transform(r["elements"], element_result)),
    )
    return with_once(counted, {"_tables": tables}).drop("_counts", "_errors")


def table_verdict(r: Column) -> Column:
    """Apply the match rule of ``r`` to its element results."""
    elements = r["elements"]
    c, total = F.size(F.filter(elements, lambda e: e["found"])), F.size(elements)
    weight = compensated_sum(F.transform(elements, lambda e: e["score"]))
    found, score = decide(r, c, total, weight)
    return F.struct(
        *[r[f].alias(f) for f in ("table_name", "match_strategy", "min_elements", "min_percentage", "min_score")],
        c.alias("found_count"),
        total.alias("total_elements"),
        found.alias("found"),
        score.alias("score"),
        elements.alias("elements"),
    )


def verdict_details() -> Column:
    """The verdict in words, from the columns of a verdict row."""
    strategy, share = F.col("match_strategy"), F.col("found_count") / F.col("total_elements")
    base = F.format_string("Found %d/%d elements", "found_count", "total_elements")
    return (
        F.when((F.col("total_elements") == 0) | (strategy == "all_elements"), base)
        .when(strategy == "min_count", F.concat(base, F.format_string(" (min: %d)", "min_elements")))
        .when(
            strategy == "min_percentage",
            F.concat(
                base, F.lit(" ("), fixed(share * 100, 1), F.lit("%, min: "),
                fixed(F.col("min_percentage") * 100, 1), F.lit("%)"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Weighted score: "), fixed(F.col("score"), 3),
                F.lit(" (min: "), fixed(F.col("min_score"), 3), F.lit(")"),
            )
        )
    )


def _keys(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c != "text"]


def page_element_pairs(pages: DataFrame, rules: Sequence[TableRule]) -> DataFrame:
    """Every page with every element of every table; no text is read for it."""
    elements = F.array(*[
        F.struct(F.lit(r.name).alias("table_name"), F.lit(i).alias("elem_idx"))
        for r in rules
        for i in range(len(r.phrases))
    ])
    return pages.select(*_keys(pages), F.inline(elements))


def element_results(
    pages: DataFrame, rules: Sequence[TableRule], compiled: bool | None = None
) -> DataFrame:
    """One row per page and element: occurrences, error rate, decision, score."""
    keys = _keys(pages)
    return (
        with_element_results(pages, rules, compiled)
        .select(*keys, F.explode_outer("_tables").alias("t"))
        .select(*keys, F.col("t.table_name").alias("table_name"), F.inline("t.elements"))
    )


def table_verdicts(
    pages: DataFrame,
    rules: Sequence[TableRule],
    strategy: str | None = None,
    qualifying: float | None = None,
    compiled: bool | None = None,
) -> DataFrame:
    """One row per page and table with found flag, score and details, qualifying or not.

    Details are put into words after the rows are unrolled, so a filter on them comes first.
    """
    keys = _keys(pages)
    chosen = [r for r in rules if strategy is None or r.match_strategy == strategy]
    if not chosen:
        raise ValueError(f"no table uses {strategy}")
    return (
        with_element_results(pages, chosen, compiled, qualifying)
        .select(*keys, F.explode_outer(F.transform("_tables", table_verdict)).alias("v"))
        .select(*keys, "v.*")
        .withColumn("details", verdict_details())
        .drop("min_elements", "min_percentage", "min_score")
    )


def page_verdicts(
    pages: DataFrame,
    rules: Sequence[TableRule],
    min_confidence: float = 0.0,
    compiled: bool | None = None,
) -> DataFrame:
    """The qualifying (page, table) pairs: found, and score at least ``min_confidence``."""
    return table_verdicts(pages, rules, qualifying=min_confidence, compiled=compiled).filter(
        F.col("found") & (F.col("score") >= min_confidence)
    )


def element_evidence(
    pages: DataFrame, rules: Sequence[TableRule], min_confidence: float = 0.0
) -> DataFrame:
    """Element results of the qualifying pages only, one row each."""
    keys = _keys(pages)
    return page_verdicts(pages, rules, min_confidence).select(*keys, "table_name", F.inline("elements"))


def verdicts_of_results(pages: DataFrame, rules: Sequence[TableRule], results: DataFrame) -> DataFrame:
    """Verdicts from element results that are given, for every page and every table.

    ``results`` are rows of ``element_results``, of any part of the elements. A (page, table) without a single result
    is not found, has score 0 and plain details, whatever its rule; with results the rule decides.
    """
    keys = _keys(pages)
    tables = F.array(*[
        F.struct(
            F.lit(r.name).alias("table_name"),
            F.lit(r.match_strategy).alias("match_strategy"),
            F.lit(r.min_elements).alias("min_elements"),
            F.lit(float(r.min_percentage)).alias("min_percentage"),
            F.lit(float(r.min_score)).alias("min_score"),
            F.lit(len(r.phrases)).alias("total_elements"),
            F.lit(float(sum(p.weight for p in r.phrases))).alias("total_weight"),
        )
        for r in rules
    ])
    summed = results.groupBy(*keys, "table_name").agg(
        F.count("*").alias("n_results"),
        F.count_if("found").cast("int").alias("found_count"),
        # as many as the table has elements, added up in their order as in a page row
        F.array_sort(F.collect_list(F.struct("elem_idx", "score"))).alias("scores"),
    ).withColumn("weight", compensated_sum(F.transform("scores", lambda s: s["score"])))
    every = pages.select(*keys, F.inline(tables)).join(summed, [*keys, "table_name"], "left")
    rule = {c: F.col(c) for c in ("match_strategy", "min_elements", "min_percentage", "min_score", "total_weight")}
    empty = F.col("n_results").isNull()
    found, score = decide(rule, F.col("found_count"), F.col("total_elements"), F.col("weight"))
    judged = every.withColumns({
        "found": F.when(empty, F.lit(False)).otherwise(found),
        "score": F.when(empty, F.lit(0.0)).otherwise(score),
    })
    plain = F.format_string("Found 0/%d elements", "total_elements")
    details = F.when(empty, plain).otherwise(verdict_details())
    return judged.select(*keys, "table_name", "found", "score", details.alias("details"))


def match_positions(pages: DataFrame, rules: Sequence[TableRule]) -> DataFrame:
    """One row per occurrence: 0-based character offset and the text as written.

    The lengths of the text between occurrences are summed up within the page row, so nothing is shuffled.
    """
    keys = _keys(pages)
    phrases = _distinct_phrases(rules)
    pieces = [
        F.struct(
            F.lit(slot).alias("slot"),
            F.transform(F.split("text", literal_pattern(t, c), -1), F.length).alias("gaps"),
            F.regexp_extract_all("text", F.lit(literal_pattern(t, c)), F.lit(0)).alias("texts"),
        )
        for slot, (t, c) in enumerate(phrases)
    ]
    found = [F.when(F.get(F.col("_counts"), F.lit(slot)) > 0, p) for slot, p in enumerate(pieces)]
    texts = F.col("m.texts")
    gaps = F.slice(F.col("m.gaps"), F.lit(1), F.size(texts))
    # before an occurrence lie the earlier ones and all gaps up to it
    starts = running_starts(F.zip_with(gaps, texts, lambda gap, text: gap + F.length(text)))
    placed_rows = (
        with_phrase_counts(pages, rules)
        .select(*keys, F.explode(F.array_compact(F.array(*found))).alias("m"))
        .select(*keys, "m.slot", F.posexplode(F.arrays_zip(starts.alias("start"), gaps.alias("gap"), texts.alias("text"))).alias("occurrence", "o"))
        .select(*keys, "slot", "occurrence", (F.col("o.start") + F.col("o.gap")).alias("position"), F.col("o.text").alias("matched_text"))
    )
    uses = F.array(*[
        F.struct(
            F.lit(r.name).alias("table_name"),
            F.lit(i).alias("elem_idx"),
            F.lit(phrases.index((p.search_text, p.match_case))).alias("slot"),
        )
        for r in rules
        for i, p in enumerate(r.phrases)
    ])
    slot = F.col("slot")
    return placed_rows.select(
        *keys,
        F.inline(F.filter(uses, lambda u: u["slot"] == slot)).alias("table_name", "elem_idx", "_slot"),
        "occurrence",
        "position",
        "matched_text",
    ).drop("_slot")


def detect_tables(
    pages: DataFrame,
    rules: Sequence[TableRule],
    min_confidence: float = 0.0,
    compiled: bool | None = None,
) -> DataFrame:
    """One row per (document, table) with a qualifying page: how many there are, and their mean score.

    The pages themselves are the rows of ``detected_pages``; a document may have any number of them. Only
    sums leave the tasks that read the texts.
    """
    return (
        page_verdicts(pages, rules, min_confidence, compiled)
        .groupBy("table_name", "doc_id")
        .agg(F.count("*").alias("n_pages"), mean(F.col("score")).alias("confidence_score"))
        .select("table_name", "doc_id", F.lit(True).alias("found"), "n_pages", "confidence_score")
    )


def detect_in_parts(
    pages: DataFrame, parts: Iterable[Sequence[TableRule]], min_confidence: float = 0.0
) -> DataFrame:
    """Detections of more rules than fit in one plan: one pass over the pages for each part of them."""
    return reduce(DataFrame.unionByName, [detect_tables(pages, rules, min_confidence) for rules in parts])


def detected_pages(
    pages: DataFrame,
    rules: Sequence[TableRule],
    min_confidence: float = 0.0,
    compiled: bool | None = None,
) -> DataFrame:
    """The pages of all detections, one row per (document, table, page); nothing is shuffled for it."""
    hits = page_verdicts(pages, rules, min_confidence, compiled)
    return hits.select("table_name", "doc_id", "page", "score", "details")


def detections_of(hits: DataFrame, *more: str) -> DataFrame:
    """One row per detection with its mean score, from flat rows of ``detected_pages``: only sums meet in a task.

    ``more`` are columns that tell several searches apart.
    """
    return hits.groupBy("table_name", "doc_id", *more).agg(mean(F.col("score")).alias("confidence_score")).select(
        "table_name", "doc_id", F.lit(True).alias("found"), "confidence_score", *more
    )


_ITEM = ("page", "score", "details")


def _details() -> Column:
    lines = F.transform("items", lambda x: F.concat(F.lit("Page "), x["page"].cast("string"), F.lit(": "), x["details"]))
    return F.array_join(lines, "; ").alias("match_details")


def listed_parts(hits: DataFrame, *more: str, size: int = PAGE_BLOCK) -> DataFrame:
    """Detections in bounded parts: a row holds the pages of one block of ``size`` page numbers and their details.

    Every part has the mean score of the whole detection; ``part`` is 0 for the first one and the number of the block
    for the others. ``more`` are columns that tell several searches apart.
    """
    keys = ["table_name", "doc_id", *more]
    blocks = (
        hits.withColumn("block", page_block(F.col("page"), size))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct(*_ITEM))).alias("items"))
    )
    whole = hits.groupBy(*keys).agg(
        mean(F.col("score")).alias("confidence_score"), F.min(page_block(F.col("page"), size)).alias("first")
    )
    part = F.when(F.col("block") == F.col("first"), 0).otherwise(F.col("block"))
    return blocks.join(whole, keys).select(
        "table_name", "doc_id", F.lit(True).alias("found"), F.col("items.page").alias("pages_found"),
        "confidence_score", _details(), *more, part.alias("part"),
    )


def listed(hits: DataFrame) -> DataFrame:
    """Detections in the reference's exchange format: one row each, with the list of its pages and the details in one text.

    ``hits`` are rows of ``detected_pages``. A row holds all pages of its detection, without a bound; use ``listed_parts``
    or the flat rows for documents with more pages than a row should hold.
    """
    return (
        hits.groupBy("table_name", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct(*_ITEM))).alias("items"), mean(F.col("score")).alias("confidence_score"))
        .select(
            "table_name",
            "doc_id",
            F.lit(True).alias("found"),
            F.col("items.page").alias("pages_found"),
            "confidence_score",
            _details(),
        )
    )


def normalized_path(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def with_file_paths(detections: DataFrame, meta: DataFrame) -> DataFrame:
    """Add the document's path with forward slashes, empty when the document is unknown."""
    paths = meta.select("doc_id", F.col("file_path").alias("file_path"))
    return detections.join(paths, "doc_id", "left").withColumn(
        "file_path", normalized_path(F.col("file_path"))
    )


def summary_totals(detections: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """Documents with a detection and number of detections; optionally the documents searched."""
    totals = detections.agg(
        F.count_distinct("doc_id").alias("documents_with_hits"),
        F.count_if("found").alias("tables_found"),
    )
    if searched is None:
        return totals
    asked = searched.agg(F.count_distinct("doc_id").alias("documents_searched"))
    return one_row(totals, asked)


def summary_by_document(detections: DataFrame) -> DataFrame:
    """Tables found per document, one row per (document, table)."""
    return detections.filter("found").select("doc_id", "table_name", "n_pages", "confidence_score")


def summary_by_type(detections: DataFrame) -> DataFrame:
    """Documents per table, one row each, with the table's number of occurrences.

    A list of documents per table has no bound, so the rows stay flat.
    """
    found = detections.filter("found").select("table_name", "doc_id", "n_pages", "confidence_score")
    counts = found.groupBy("table_name").agg(F.count("*").alias("total_occurrences"))
    return found.join(counts, "table_name")


def condition_matrix(
    pages: DataFrame, meta: DataFrame, rules: Sequence[TableRule], min_confidence: float = 0.0
) -> DataFrame:
    """One row per page that meets a condition, one boolean column per condition."""
    keys = _keys(pages)
    flags = F.transform(
        F.transform("_tables", table_verdict), lambda v: v["found"] & (v["score"] >= min_confidence)
    )
    wide = (
        with_once(with_element_results(pages, rules, qualifying=min_confidence), {"_flags": flags})
        .filter(F.exists("_flags", lambda f: f))
        .select(*keys, *[F.get(F.col("_flags"), F.lit(i)).alias(r.name) for i, r in enumerate(rules)])
    )
    documents = document_blocks(meta.select("doc_id", "file_name", "file_path", "page_count"))
    return (
        wide.withColumn("block", page_block(F.col("page")))
        .join(documents, ["doc_id", "block"], "left")
        .drop("block")
    )
