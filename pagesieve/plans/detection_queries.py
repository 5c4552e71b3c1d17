"""Registered queries for table detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.blocks import only_documents
from pagesieve.operators import definition_search, detect
from pagesieve.operators.page_view import join_channels, pages_combined
from pagesieve.plans import fixtures as fx
from pagesieve.plans.fixtures import RULES


def rounded(detections: DataFrame) -> DataFrame:
    """Scores rounded, for comparison by value."""
    return detections.withColumn("confidence_score", F.round("confidence_score", 6))


def _verdicts(strategy):
    def run(spark, sf_dir):
        return detect.table_verdicts(fx.pages(spark, sf_dir), RULES, strategy).select(
            "doc_id", "page", "table_name", "found_count", "total_elements", "found",
            F.round("score", 6).alias("score"),
        )

    return run


def _verdicts_sql(strategy):
    return fx.sql(["fx_verdicts"], f"""
        select doc_id, page, table_name, cast(c as integer) as found_count,
               cast(t as integer) as total_elements, found, round(score, 6) as score
        from fx_verdicts where strategy = '{strategy}'""")


def searched(spark, sf_dir, min_confidence=0.0) -> DataFrame:
    return detect.detect_tables(fx.pages(spark, sf_dir), RULES, min_confidence)


# page verdicts rolled up per document, shared by the SQL of several queries
DETECTIONS_SQL = """
    select table_name, doc_id, true as found, string_agg(cast(page as varchar), ',' order by page) as pages_found,
           round(avg(score), 6) as confidence_score,
           string_agg('Page ' || page || ': ' || details, '; ' order by page) as match_details,
           count(*) as n_pages
    from fx_verdicts where found and score >= {minimum} group by table_name, doc_id"""


def detections_sql(body: str, minimum: float = 0.0, views: list[str] | None = None) -> str:
    return fx.sql(["fx_verdicts", *(views or [])], body, {"det": DETECTIONS_SQL.format(minimum=minimum)})


def page_element_pairs(spark, sf_dir):
    return detect.page_element_pairs(fx.pages(spark, sf_dir), RULES)


def element_counts(spark, sf_dir):
    return detect.element_results(fx.pages(spark, sf_dir), RULES).select(
        "doc_id", "page", "table_name", "elem_idx", "n_matches"
    )


def match_positions(spark, sf_dir):
    return detect.match_positions(fx.pages(spark, sf_dir), RULES)


def element_decision(spark, sf_dir):
    return detect.element_results(fx.pages(spark, sf_dir), RULES)


def element_decision_listed(spark, sf_dir):
    """The same results with the phrase list walked by one array function."""
    return detect.element_results(fx.pages(spark, sf_dir), RULES, compiled=False)


def empty_results_guard(spark, sf_dir):
    """Verdicts from results of which every other element and, on every third page, all are missing."""
    pages = fx.pages(spark, sf_dir)
    results = detect.element_results(pages, RULES)
    kept = results.filter(((F.col("doc_id") + F.col("page")) % 3 != 0) & (F.col("elem_idx") % 2 == 0))
    judged = detect.verdicts_of_results(pages, RULES, kept)
    return judged.withColumn("score", F.round("score", 6))


def match_details(spark, sf_dir):
    return detect.table_verdicts(fx.pages(spark, sf_dir), RULES).select(
        "doc_id", "page", "table_name", "details"
    )


def page_verdicts(spark, sf_dir):
    return detect.page_verdicts(fx.pages(spark, sf_dir), RULES, min_confidence=0.6).select(
        "doc_id", "page", "table_name", F.round("score", 6).alias("score"), "details"
    )


def detect_tables(spark, sf_dir):
    return rounded(detect.detect_tables(fx.pages(spark, sf_dir), RULES))


def definition_counts(spark, sf_dir):
    """Which phrases of a definition table as long as the corpus occur on which pages, and how often."""
    hits = definition_search.element_hits(fx.pages(spark, sf_dir), fx.doc_definitions(spark, sf_dir))
    return hits.select("doc_id", "page", "table_name", "elem_idx", "n_matches", "found")


def definition_pages(spark, sf_dir):
    """The pages and details of ``detect_definitions``."""
    hits = definition_search.definition_verdicts(fx.pages(spark, sf_dir), fx.doc_definitions(spark, sf_dir))
    return hits.select("table_name", "doc_id", "page", F.round("score", 6).alias("score"), "details")


def detect_definitions(spark, sf_dir):
    """Detection of a definition table as long as the corpus, in one pass over the texts."""
    return rounded(definition_search.detect_definitions(fx.pages(spark, sf_dir), fx.doc_definitions(spark, sf_dir)))


def _merged(spark, sf_dir) -> DataFrame:
    return pages_combined(join_channels(fx.digital(spark, sf_dir), fx.ocr(spark, sf_dir)))


def detect_tables_channels(spark, sf_dir):
    """Detection over two separate channel tables, merged by a join first."""
    return rounded(detect.detect_tables(_merged(spark, sf_dir), RULES))


def _found_pages(pages: DataFrame) -> DataFrame:
    return detect.detected_pages(pages, RULES).withColumn("score", F.round("score", 6))


def detected_pages(spark, sf_dir):
    return _found_pages(fx.pages(spark, sf_dir))


def detected_pages_channels(spark, sf_dir):
    """The pages and details of ``detect_tables_channels``."""
    return _found_pages(_merged(spark, sf_dir))


def element_evidence(spark, sf_dir):
    return detect.element_evidence(fx.pages(spark, sf_dir), RULES, min_confidence=0.6)


def _subset(spark, sf_dir) -> DataFrame:
    labelled = fx.table(spark, sf_dir, "labels").select("doc_id")
    wanted = fx.meta(spark, sf_dir).join(labelled, "doc_id", "left_semi")
    return only_documents(fx.pages(spark, sf_dir), wanted)


def detect_subset(spark, sf_dir):
    return rounded(detect.detect_tables(_subset(spark, sf_dir), RULES))


def detected_pages_subset(spark, sf_dir):
    """The pages and details of ``detect_subset``."""
    return _found_pages(_subset(spark, sf_dir))


def normalize_path(spark, sf_dir):
    """Every third document has no metadata here."""
    meta = fx.meta(spark, sf_dir).filter("doc_id % 3 <> 0")
    return detect.with_file_paths(searched(spark, sf_dir), meta).select(
        "doc_id", "table_name", "file_path"
    )


def summary_totals(spark, sf_dir):
    return detect.summary_totals(searched(spark, sf_dir), fx.table(spark, sf_dir, "documents"))


def summary_by_document(spark, sf_dir):
    return rounded(detect.summary_by_document(searched(spark, sf_dir)))


def summary_by_type(spark, sf_dir):
    return rounded(detect.summary_by_type(searched(spark, sf_dir)))


def condition_matrix(spark, sf_dir):
    return detect.condition_matrix(fx.pages(spark, sf_dir), fx.meta(spark, sf_dir), RULES)


QUERIES = {
    "page_element_pairs": page_element_pairs,
    "element_counts": element_counts,
    "match_positions": match_positions,
    "element_decision": element_decision,
    "element_decision_listed": element_decision_listed,
    "strategy_all_elements": _verdicts("all_elements"),
    "strategy_min_count": _verdicts("min_count"),
    "strategy_min_percentage": _verdicts("min_percentage"),
    "strategy_weighted_score": _verdicts("weighted_score"),
    "empty_results_guard": empty_results_guard,
    "match_details": match_details,
    "page_verdicts": page_verdicts,
    "definition_counts": definition_counts,
    "definition_pages": definition_pages,
    "detect_definitions": detect_definitions,
    "detect_tables": detect_tables,
    "detected_pages": detected_pages,
    "detect_tables_channels": detect_tables_channels,
    "detected_pages_channels": detected_pages_channels,
    "detected_pages_subset": detected_pages_subset,
    "element_evidence": element_evidence,
    "detect_subset": detect_subset,
    "normalize_path": normalize_path,
    "summary_totals": summary_totals,
    "summary_by_document": summary_by_document,
    "summary_by_type": summary_by_type,
    "condition_matrix": condition_matrix,
}

_HEADER = "select table_name, doc_id, found, n_pages, confidence_score from det"
_PAGES = "select table_name, doc_id, page, round(score, 6) as score, details from fx_verdicts where found"
_ELEMENTS = "select doc_id, page, table_name, elem_idx, n_matches, found, error_rate, score from fx_elements"

SQL = {
    "page_element_pairs": fx.sql(
        ["fx_pages", "fx_defs"],
        "select p.doc_id, p.page, e.table_name, e.elem_idx from fx_pages p cross join fx_defs e",
    ),
    "element_counts": fx.sql(
        ["fx_counts"], "select doc_id, page, table_name, elem_idx, n_matches from fx_counts"
    ),
    "match_positions": fx.sql(["fx_counts"], """
        select doc_id, page, table_name, elem_idx, cast(i - 1 as integer) as occurrence,
               cast(before as integer) as position,
               substring(text, cast(before + 1 as bigint), length(search_text)) as matched_text
        from (
          select *, sum(length(piece) + length(search_text)) over (
                      partition by doc_id, page, table_name, elem_idx order by i) - length(search_text) as before
          from (
            select c.doc_id, c.page, c.table_name, c.elem_idx, c.search_text, c.n_matches, p.text,
                   unnest(string_split(case when match_case then p.text else lower(p.text) end,
                                       case when match_case then search_text else lower(search_text) end)) as piece,
                   generate_subscripts(string_split(case when match_case then p.text else lower(p.text) end,
                                       case when match_case then search_text else lower(search_text) end), 1) as i
            from fx_counts c join fx_pages p on c.doc_id = p.doc_id and c.page = p.page
            where n_matches > 0))
        where i <= n_matches"""),
    "element_decision": fx.sql(["fx_elements"], _ELEMENTS),
    "element_decision_listed": fx.sql(["fx_elements"], _ELEMENTS),
    "strategy_all_elements": _verdicts_sql("all_elements"),
    "strategy_min_count": _verdicts_sql("min_count"),
    "strategy_min_percentage": _verdicts_sql("min_percentage"),
    "strategy_weighted_score": _verdicts_sql("weighted_score"),
    "empty_results_guard": fx.sql(["fx_elements", "fx_verdicts"], """
        select v.doc_id, v.page, v.table_name,
               case when e.n is null then false
                    when v.strategy = 'all_elements' then e.c = v.t
                    when v.strategy = 'min_count' then e.c >= d.min_elements
                    when v.strategy = 'min_percentage' then e.c / v.t >= d.min_percentage
                    else e.weighted / d.total_weight >= d.min_score end as found,
               case when e.n is null then 0.0 when v.strategy = 'weighted_score'
                    then round(e.weighted / d.total_weight, 6) else round(e.c / v.t, 6) end as score,
               case when e.n is null then printf('Found 0/%d elements', v.t)
                    when v.strategy = 'all_elements' then printf('Found %d/%d elements', e.c, v.t)
                    when v.strategy = 'min_count' then printf('Found %d/%d elements (min: %d)', e.c, v.t, d.min_elements)
                    when v.strategy = 'min_percentage' then printf('Found %d/%d elements (%.1f%%, min: %.1f%%)',
                      e.c, v.t, 100.0 * e.c / v.t, 100.0 * d.min_percentage)
                    else printf('Weighted score: %.3f (min: %.3f)', e.weighted / d.total_weight, d.min_score) end as details
        from fx_verdicts v
        join (select table_name, any_value(min_elements) as min_elements, any_value(min_percentage) as min_percentage,
                     any_value(min_score) as min_score, sum(weight) as total_weight
              from fx_defs group by table_name) d on v.table_name = d.table_name
        left join (select doc_id, page, table_name, count(*) as n, count(*) filter (found) as c, sum(score) as weighted
                   from fx_elements where (doc_id + page) % 3 <> 0 and elem_idx % 2 = 0
                   group by doc_id, page, table_name) e
          on v.doc_id = e.doc_id and v.page = e.page and v.table_name = e.table_name"""),
    "match_details": fx.sql(["fx_verdicts"], "select doc_id, page, table_name, details from fx_verdicts"),
    "page_verdicts": fx.sql(["fx_verdicts"], """
        select doc_id, page, table_name, round(score, 6) as score, details
        from fx_verdicts where found and score >= 0.6"""),
    "definition_counts": fx.sql(["fx_doc_counts"], """
        select doc_id, page, table_name, cast(elem_idx as integer) as elem_idx, n_matches, n_matches <= 3 as found
        from fx_doc_counts"""),
    "definition_pages": fx.sql(["fx_doc_verdicts"], """
        select table_name, doc_id, page, round(score, 6) as score, details from fx_doc_verdicts"""),
    "detect_definitions": fx.sql(["fx_doc_verdicts"], """
        select table_name, doc_id, true as found, count(*) as n_pages, round(avg(score), 6) as confidence_score
        from fx_doc_verdicts group by table_name, doc_id"""),
    "detect_tables": detections_sql(_HEADER),
    "detected_pages": fx.sql(["fx_verdicts"], """
        select table_name, doc_id, page, round(score, 6) as score, details from fx_verdicts where found"""),
    "detect_tables_channels": detections_sql(_HEADER),
    "detected_pages_channels": fx.sql(["fx_verdicts"], _PAGES),
    "detected_pages_subset": fx.sql(["fx_verdicts"], f"{_PAGES} and doc_id in (select doc_id from labels)"),
    "element_evidence": fx.sql(["fx_verdicts"], """
        select e.doc_id, e.page, e.table_name, e.elem_idx, e.n_matches, e.found, e.error_rate, e.score
        from fx_elements e join fx_verdicts v
          on e.doc_id = v.doc_id and e.page = v.page and e.table_name = v.table_name
        where v.found and v.score >= 0.6"""),
    "detect_subset": detections_sql(f"{_HEADER} where doc_id in (select doc_id from labels)"),
    "normalize_path": detections_sql(
        """select d.doc_id, d.table_name, replace(coalesce(m.file_path, ''), '\\', '/') as file_path
           from det d left join (select * from fx_meta where doc_id % 3 <> 0) m on d.doc_id = m.doc_id""",
        views=["fx_meta"],
    ),
    "summary_totals": detections_sql("""
        select count(distinct doc_id) as documents_with_hits, count(*) as tables_found,
               (select count(distinct doc_id) from documents) as documents_searched from det"""),
    "summary_by_document": detections_sql("select doc_id, table_name, n_pages, confidence_score from det"),
    "summary_by_type": detections_sql("""
        select table_name, doc_id, n_pages, confidence_score,
               count(*) over (partition by table_name) as total_occurrences from det"""),
    "condition_matrix": fx.sql(["fx_verdicts", "fx_meta"], """
        select v.doc_id, v.page, any_value(m.file_name) as file_name, any_value(m.file_path) as file_path,
               any_value(m.page_count) as page_count,
               bool_or(found and table_name = 'T_all') as "T_all", bool_or(found and table_name = 'T_min') as "T_min",
               bool_or(found and table_name = 'T_pct') as "T_pct", bool_or(found and table_name = 'T_wt') as "T_wt"
        from fx_verdicts v join fx_meta m on v.doc_id = m.doc_id
        group by v.doc_id, v.page having bool_or(found)"""),
}
