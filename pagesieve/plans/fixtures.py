"""Input views over the driver's tables, for the registered queries and their SQL.

A line of a document is a page. Each view exists as Spark DataFrame and as DuckDB text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.definitions import STRATEGIES, Phrase, TableRule, element_rows
from pagesieve.functions.text import strip
from pagesieve.operators.page_view import pages_combined

RULES = [
    TableRule("T_all", (Phrase("the "), Phrase("and ")), "all_elements"),
    TableRule(
        "T_min",
        (
            Phrase("The ", max_errors=0, match_case=True),
            Phrase("tion.", match_case=True),
            Phrase("than ", max_errors=1),
            Phrase("license"),
        ),
        "min_count",
        min_elements=2,
    ),
    TableRule(
        "T_pct",
        (Phrase("of the"), Phrase("in the"), Phrase("the and"), Phrase("er the")),
        "min_percentage",
        min_percentage=0.5,
    ),
    TableRule(
        "T_wt",
        (Phrase("the "), Phrase("and ", max_errors=0, weight=0.8), Phrase("of the", weight=0.9)),
        "weighted_score",
        min_score=0.7,
    ),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")
    ).select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels side by side, as the store keeps them; no join."""
    doc, page, text = F.col("doc_id"), F.col("page"), F.col("text")
    no_digital = (doc * 31 + page) % 5 == 0
    noisy = F.when((doc + page) % 2 == 0, F.translate(text, "elo", "cI0")).otherwise(text)
    return lines(spark, sf_dir).select(
        "doc_id",
        "page",
        F.when(~no_digital, text).alias("digital"),
        F.when(((doc + page) % 3 == 0) | no_digital, noisy).alias("ocr"),
    )


def digital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).filter("digital is not null").selectExpr("doc_id", "page", "digital as text")


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels(spark, sf_dir).filter("ocr is not null").selectExpr("doc_id", "page", "ocr as text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_combined(channels(spark, sf_dir))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document metadata; the backslash in the path is there on purpose."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.format_string("doc_%d.pdf", "doc_id").alias("file_name"),
        F.format_string("/data/%s\\doc_%d.pdf", "source", "doc_id").alias("file_path"),
        (breaks + 1).cast("int").alias("page_count"),
        F.col("n_chars").alias("file_size"),
        F.md5("text").alias("file_hash"),
    )


def previous_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of an earlier run: new, changed, without hash and unchanged documents."""
    kind = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").filter(kind != 0).select(
        "doc_id",
        F.when(kind == 1, F.md5(F.concat("text", F.lit("x"))))
        .when(kind == 3, F.md5("text"))
        .alias("file_hash"),
    )


def doc_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition table as long as the corpus: for each document one table of up to three phrases of its first words."""
    words, doc = F.split("text", " "), F.col("doc_id")
    phrases = [F.concat_ws(" ", F.slice(words, 1 + 4 * i, 3)).alias("search_text") for i in range(3)]
    elements = [
        F.struct(
            p, F.lit(2).alias("max_errors"), F.lit(0.3).alias("max_error_rate"), (doc % 3 == 0).alias("match_case"),
            F.lit(1.0 - 0.25 * i).alias("weight"), F.lit("").alias("description"),
        )
        for i, p in enumerate(phrases)
    ]
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), (doc % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").filter("text is not null").select(
        F.concat(F.lit("doc_"), doc.cast("string")).alias("name"),
        strategy.alias("match_strategy"),
        F.lit(2).alias("min_elements"), F.lit(0.5).alias("min_percentage"), F.lit(0.5).alias("min_score"), F.lit("").alias("description"),
        F.filter(F.array(*elements), lambda e: strip(e["search_text"]) != "").alias("text_elements"),
    )


# --- the same views for DuckDB -------------------------------------------------------------

_SQL_VIEWS = {
    "fx_lines": """
        select doc_id, cast(page as integer) as page, text from (
          select doc_id, unnest(string_split(text, chr(10))) as text,
                 generate_subscripts(string_split(text, chr(10)), 1) as page from documents)""",
    "fx_digital": "select * from fx_lines where (doc_id * 31 + page) % 5 <> 0",
    "fx_ocr": """
        select doc_id, page,
               case when (doc_id + page) % 2 = 0 then translate(text, 'elo', 'cI0') else text end as text
        from fx_lines where (doc_id + page) % 3 = 0 or (doc_id * 31 + page) % 5 = 0""",
    "fx_pages": """
        select doc_id, page,
               case when d.text is null then o.text
                    when o.text is null then d.text
                    when o.text <> '' and not contains(d.text, o.text)
                      then trim(d.text || chr(10) || o.text, ' ' || chr(9) || chr(10) || chr(13))
                    else d.text end as text
        from fx_digital d full outer join fx_ocr o using (doc_id, page)""",
    "fx_meta": """
        select d.doc_id, concat('doc_', d.doc_id, '.pdf') as file_name,
               concat('/data/', source, '\\doc_', d.doc_id, '.pdf') as file_path,
               n.page_count, n_chars as file_size, md5(text) as file_hash
        from documents d
        join (select doc_id, cast(max(page) as integer) as page_count from fx_lines group by doc_id) n
          on d.doc_id = n.doc_id""",
    "fx_prev": """
        select doc_id, case when doc_id % 4 = 1 then md5(concat(text, 'x'))
                            when doc_id % 4 = 2 then null else md5(text) end as file_hash
        from documents where doc_id % 4 <> 0""",
    "fx_counts": """
        select p.doc_id, p.page, e.*,
               cast(case when e.match_case
                    then (length(p.text) - length(replace(p.text, e.search_text, ''))) // length(e.search_text)
                    else (length(lower(p.text)) - length(replace(lower(p.text), lower(e.search_text), '')))
                         // length(e.search_text) end as integer) as n_matches
        from fx_pages p cross join fx_defs e""",
    "fx_elements": """
        select *, n_matches between 1 and max_errors + 1 as found,
               case when n_matches > 0 then 0.0::double else 1.0::double end as error_rate,
               case when n_matches > 0 then weight else 0.0::double end as score
        from fx_counts""",
    # Equal texts are searched once; a phrase can only be where its first characters are.
    "fx_texts": "select distinct text from fx_pages",
    "fx_doc_elements": """
        select name, strategy, row_number() over (partition by name order by i) - 1 as elem_idx, i, search_text, match_case, weight,
               count(*) over (partition by name) as t, sum(weight) over (partition by name) as total_weight
        from (
          select 'doc_' || doc_id as name, ['all_elements', 'min_count', 'min_percentage', 'weighted_score'][doc_id % 4 + 1] as strategy,
                 i, array_to_string(string_split(text, ' ')[1 + 4 * i:3 + 4 * i], ' ') as search_text,
                 doc_id % 3 = 0 as match_case, 1.0::double - 0.25::double * i as weight
          from (select doc_id, text, unnest([0, 1, 2]) as i from documents where text is not null))
        where trim(search_text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''""",
    "fx_doc_hits": """
        with phrases as (
          select distinct search_text, match_case, case when match_case then search_text else lower(search_text) end as s
          from fx_doc_elements),
        starts as (select distinct text, lower(substring(text, p, 5)) as k from (
          select text, unnest(range(1, length(text) - 3)) as p from fx_texts)),
        pairs as (
          select x.text, f.* from starts x join phrases f on x.k = lower(substring(s, 1, 5)) where length(s) >= 5
          union all select x.text, f.* from fx_texts x join phrases f on contains(lower(x.text), lower(s)) where length(s) < 5)
        select text, search_text, match_case,
               cast((length(t) - length(replace(t, s, ''))) // length(s) as integer) as n_matches
        from (select *, case when match_case then text else lower(text) end as t from pairs) where contains(t, s)""",
    "fx_doc_counts": """
        select p.doc_id, p.page, e.name as table_name, e.elem_idx, e.strategy, e.t, e.total_weight, e.weight, h.n_matches
        from fx_doc_hits h join fx_pages p on p.text = h.text
        join fx_doc_elements e on e.search_text = h.search_text and e.match_case = h.match_case""",
    "fx_doc_verdicts": """
        select doc_id, page, table_name, strategy, c, t, weighted,
               case when strategy = 'weighted_score' then weighted else c / t end as score,
               case strategy
                 when 'all_elements' then printf('Found %d/%d elements', c, t)
                 when 'min_count' then printf('Found %d/%d elements (min: 2)', c, t)
                 when 'min_percentage' then printf('Found %d/%d elements (%.1f%%, min: 50.0%%)', c, t, 100.0 * c / t)
                 else printf('Weighted score: %.3f (min: 0.500)', weighted) end as details
        from (
          select doc_id, page, table_name, any_value(strategy) as strategy, any_value(t) as t,
                 count(*) filter (n_matches <= 3) as c, sum(weight) / any_value(total_weight) as weighted
          from fx_doc_counts group by doc_id, page, table_name)
        where case strategy when 'all_elements' then c = t when 'min_count' then c >= 2
                            when 'min_percentage' then c / t >= 0.5 else weighted >= 0.5 end""",
    "fx_ratios": """
        select doc_id, page, table_name, any_value(strategy) as strategy,
               any_value(min_elements) as min_elements, any_value(min_percentage) as min_percentage,
               any_value(min_score) as min_score,
               count(*) filter (found) as c, count(*) as t, count(*) filter (n_matches > 0) as hit,
               sum(score) / sum(weight) as weighted
        from fx_elements group by doc_id, page, table_name""",
    "fx_verdicts": """
        select doc_id, page, table_name, strategy, c, t, hit,
               case strategy when 'all_elements' then c = t when 'min_count' then c >= min_elements
                    when 'min_percentage' then c / t >= min_percentage else weighted >= min_score end as found,
               case strategy when 'weighted_score' then weighted else c / t end as score,
               case strategy
                 when 'all_elements' then printf('Found %d/%d elements', c, t)
                 when 'min_count' then printf('Found %d/%d elements (min: %d)', c, t, min_elements)
                 when 'min_percentage' then printf('Found %d/%d elements (%.1f%%, min: %.1f%%)',
                                                   c, t, 100.0 * c / t, 100.0 * min_percentage)
                 else printf('Weighted score: %.3f (min: %.3f)', weighted, min_score) end as details
        from fx_ratios""",
}


def _defs_sql() -> str:
    strategies = {r.name: r for r in RULES}
    rows = []
    for e in element_rows(RULES):
        r = strategies[e["table_name"]]
        rows.append(
            f"('{r.name}', '{r.match_strategy}', {r.min_elements}, {r.min_percentage}::double, "
            f"{r.min_score}::double, {e['elem_idx']}, '{e['search_text']}', {e['max_errors']}, "
            f"{e['match_case']}, {e['weight']}::double)"
        )
    return (
        "select * from (values " + ", ".join(rows) + ") v(table_name, strategy, min_elements, "
        "min_percentage, min_score, elem_idx, search_text, max_errors, match_case, weight)"
    )


_DEPENDS = {
    "fx_digital": ["fx_lines"],
    "fx_ocr": ["fx_lines"],
    "fx_pages": ["fx_digital", "fx_ocr"],
    "fx_meta": ["fx_lines"],
    "fx_counts": ["fx_pages", "fx_defs"],
    "fx_elements": ["fx_counts"],
    "fx_ratios": ["fx_elements"],
    "fx_texts": ["fx_pages"],
    "fx_doc_hits": ["fx_texts", "fx_doc_elements"],
    "fx_doc_counts": ["fx_doc_hits"],
    "fx_doc_verdicts": ["fx_doc_counts"],
    "fx_verdicts": ["fx_ratios"],
}


def sql(views: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views (and what they need) as common table expressions in front."""
    ordered: list[str] = []

    def need(name):
        for other in _DEPENDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    texts = {**_SQL_VIEWS, "fx_defs": _defs_sql()}
    parts = [f"{name} as ({texts[name].strip()})" for name in ordered]
    parts += [f"{name} as ({text.strip()})" for name, text in (extra or {}).items()]
    return f"with {', '.join(parts)} {body.strip()}" if parts else body.strip()
