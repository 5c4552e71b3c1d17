"""Registered queries for exported detections and their analysis, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.blocks import PAGE_BLOCK
from pagesieve.operators import analysis, detect
from pagesieve.plans import analysis as plan
from pagesieve.plans import fixtures as fx
from pagesieve.plans.detection_queries import DETECTIONS_SQL
from pagesieve.session import work_folder
from pagesieve.sources import detections as io


def found_pages(spark, sf_dir) -> DataFrame:
    """The pages of two searches, at confidence 0 and 0.6, as flat rows.

    Both start from the pages found at 0, which are written once for this call.
    """
    path = work_folder(spark, "found")
    detect.detected_pages(fx.pages(spark, sf_dir), fx.RULES).write.parquet(path)
    hits = spark.read.parquet(path)
    return hits.withColumn("seq", F.lit(0)).unionByName(hits.filter("score >= 0.6").withColumn("seq", F.lit(1)))


def described(spark, sf_dir, found: DataFrame) -> DataFrame:
    """Detections with their paths; the first search knows the path of odd documents only."""
    found = detect.with_file_paths(found, fx.meta(spark, sf_dir))
    unknown = (F.col("seq") == 0) & (F.col("doc_id") % 2 == 0)
    return found.withColumns({
        "file_path": F.when(unknown, "").otherwise(F.col("file_path")),
        "confidence_score": F.round("confidence_score", 6),
    })


def exported(spark, sf_dir, size: int = PAGE_BLOCK) -> DataFrame:
    """Both searches in the exchange format, in parts of at most a page block."""
    return described(spark, sf_dir, detect.listed_parts(found_pages(spark, sf_dir), "seq", size=size))


def flat(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The detections of both searches without lists, and the rows of their pages: nothing here grows with a document."""
    hits = found_pages(spark, sf_dir)
    name = F.col("doc_id").cast("string").alias("document_name")
    found = described(spark, sf_dir, detect.detections_of(hits, "seq"))
    return found.select(name, "table_name", "file_path", "found", "confidence_score", "seq"), hits.select(
        name, "table_name", "page"
    )


def joined(pages: str) -> Column:
    return F.array_join(F.col(pages).cast("array<string>"), ",").alias(pages)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("pages_found", joined("pages_found"))


def _consolidated(spark, sf_dir) -> DataFrame:
    return analysis.consolidate(*flat(spark, sf_dir))


PART = f"{io.DETECTION}, seq int, part int"


def export_detections(spark, sf_dir):
    path = f"{work_folder(spark, 'detections')}/json"
    io.export_parts(exported(spark, sf_dir), path)
    return _flat(spark.read.schema(PART).json(path))


def export_detection_parts(spark, sf_dir):
    """The exchange format with 3 pages to a block, so that most detections have several parts."""
    path = f"{work_folder(spark, 'detections')}/json"
    io.export_parts(exported(spark, sf_dir, 3), path)
    return _flat(spark.read.schema(PART).json(path))


def consolidate_parts(spark, sf_dir):
    """The consolidation of parts that were written and read again."""
    path = f"{work_folder(spark, 'detections')}/json"
    io.export_parts(exported(spark, sf_dir, 3), path)
    return rounded(analysis.consolidate(*io.load_parts(spark, path)), "confidence")


def load_detections(spark, sf_dir):
    path = f"{work_folder(spark, 'detections')}/json"
    io.export_parts(exported(spark, sf_dir), path)
    return _flat(io.at_least(spark.read.schema(PART).json(path), 0.8))


def load_detection_arrays(spark, sf_dir):
    """Parts written as JSON arrays without line ends, and read back by splits of the files."""
    path = f"{work_folder(spark, 'detections')}/arrays"
    io.export_part_arrays(exported(spark, sf_dir, 3), path)
    return _flat(io.read_array(spark, path, PART, into="place").drop("place"))


# What is compared of each written set: two keys, a text and two numbers.
_FRAMES = {
    "tables_by_document": ("document_name", "table_name", "file_path", "confidence", "n_pages"),
    "documents_by_table": ("table_name", "document_name", "file_path", "confidence", "n_pages"),
    "multiple_occurrences": ("table_name", "document_name", None, "occurrences", "total_multiple"),
    "table_stats": ("table_name", None, None, "avg_confidence", "documents"),
    "document_stats": ("document_name", None, None, "avg_confidence", "tables"),
    "confidence_stats": ("table_name", None, None, "high", "low"),
    "file_paths": ("table_name", None, "file_path", None, None),
    "pages": ("document_name", "table_name", None, "page", None),
    "summary": (None, None, None, "total_detections", "average_detections_per_table"),
}


def written(spark, paths: dict[str, str], frames: dict[str, tuple], file_format: str) -> DataFrame:
    """The values of the written sets in one shape."""
    names, kinds = ("key", "second_key", "text", "number", "second_number"), ("string",) * 3 + ("double",) * 2

    def one(name: str) -> DataFrame:
        schema = ", ".join(f"{c} {k}" for c, k in zip(frames[name], kinds) if c)
        reader = spark.read if file_format == "parquet" else spark.read.schema(schema)
        rows = reader.format(file_format).load(paths[name])
        values = [
            (F.round(F.col(c).cast(k), 9) if k == "double" else F.col(c).cast(k)) if c else F.lit(None).cast(k)
            for c, k in zip(frames[name], kinds)
        ]
        return rows.select(F.lit(name).alias("frame"), *[v.alias(n) for v, n in zip(values, names)])

    return reduce(DataFrame.unionByName, map(one, frames))


def export_analysis(spark, sf_dir):
    found, pages = flat(spark, sf_dir)
    paths = plan.export_analysis(found, work_folder(spark, "analysis"), pages=pages)
    return written(spark, paths, _FRAMES, "json")


def consolidate(spark, sf_dir):
    return rounded(_consolidated(spark, sf_dir), "confidence")


def tables_by_document(spark, sf_dir):
    return rounded(analysis.tables_by_document(_consolidated(spark, sf_dir)), "confidence")


def documents_by_table(spark, sf_dir):
    return rounded(analysis.documents_by_table(_consolidated(spark, sf_dir)), "confidence")


def analysis_totals(spark, sf_dir):
    return rounded(
        analysis.analysis_totals(flat(spark, sf_dir)[0]),
        "average_detections_per_document", "average_detections_per_table",
    )


def table_stats(spark, sf_dir):
    return rounded(
        analysis.table_stats(_consolidated(spark, sf_dir)), "avg_confidence", "min_confidence", "max_confidence"
    )


def document_stats(spark, sf_dir):
    return rounded(analysis.document_stats(_consolidated(spark, sf_dir)), "avg_confidence")


def document_table_pages(spark, sf_dir):
    return analysis.document_table_pages(*flat(spark, sf_dir))


def confidence_bands(spark, sf_dir):
    return rounded(analysis.confidence_bands(_consolidated(spark, sf_dir)), "avg_confidence")


def multiple_occurrences(spark, sf_dir):
    return analysis.multiple_occurrences(flat(spark, sf_dir)[0])


def table_file_paths(spark, sf_dir):
    return analysis.table_file_paths(_consolidated(spark, sf_dir))


def confidence_filter(spark, sf_dir):
    return _flat(io.at_least(io.as_exported(exported(spark, sf_dir), "seq", "part"), 0.75))


QUERIES = {
    f.__name__: f
    for f in (
        export_detections, load_detections, export_analysis, consolidate, tables_by_document,
        documents_by_table, analysis_totals, table_stats, document_stats, document_table_pages,
        confidence_bands, multiple_occurrences, table_file_paths, confidence_filter,
        export_detection_parts, consolidate_parts, load_detection_arrays,
    )
}

_EXTRA = {
    "low": DETECTIONS_SQL.format(minimum=0.0),
    "high": DETECTIONS_SQL.format(minimum=0.6),
    "det": """
        select d.table_name, cast(d.doc_id as varchar) as document_name, d.found, d.pages_found,
               d.confidence_score, d.match_details, seq,
               case when seq = 0 and d.doc_id % 2 = 0 then ''
                    else replace(coalesce(m.file_path, ''), '\\', '/') end as file_path
        from (select *, 0 as seq from low union all select *, 1 as seq from high) d
        left join fx_meta m on d.doc_id = m.doc_id""",
    "con_pages": """
        select distinct document_name, table_name, cast(unnest(string_split(pages_found, ',')) as integer) as page from det""",
    "con": """
        select d.document_name, d.table_name, n.n_pages, d.confidence, d.file_path
        from (
          select document_name, table_name, avg(confidence_score) as confidence,
                 coalesce(arg_min(file_path, seq) filter (file_path <> ''), '') as file_path
          from det group by document_name, table_name) d
        join (select document_name, table_name, count(*) as n_pages from con_pages group by document_name, table_name) n
          on d.document_name = n.document_name and d.table_name = n.table_name""",
}


def _sql(body: str) -> str:
    return fx.sql(["fx_verdicts", "fx_meta"], body, _EXTRA)


def _parts(size: int, minimum: float = 0.0) -> str:
    """Detections from ``minimum`` on in parts of ``size`` page numbers."""
    return _sql(f"""
        select d.table_name, d.document_name, d.file_path, d.found, p.pages_found, d.confidence_score, p.match_details, d.seq,
               cast(case when p.block = min(p.block) over (partition by d.seq, d.table_name, d.document_name)
                    then 0 else p.block end as integer) as part
        from det d join (
          select s.seq, table_name, cast(doc_id as varchar) as document_name, (page - 1) // {size} as block,
                 string_agg(cast(page as varchar), ',' order by page) as pages_found,
                 string_agg('Page ' || page || ': ' || details, '; ' order by page) as match_details
          from fx_verdicts v join (values (0, 0.0), (1, 0.6)) s(seq, minimum) on v.found and v.score >= s.minimum
          group by s.seq, table_name, doc_id, (page - 1) // {size}) p
          on d.seq = p.seq and d.table_name = p.table_name and d.document_name = p.document_name
        where d.confidence_score >= {minimum}""")


_CON = "select document_name, table_name, n_pages, round(confidence, 9) as confidence, file_path from con"

SQL = {
    "export_detections": _parts(PAGE_BLOCK),
    "load_detections": _parts(PAGE_BLOCK, 0.8),
    "export_analysis": _sql("""
        select 'tables_by_document' as frame, document_name as key, table_name as second_key, file_path as text,
               round(confidence, 9) as number, n_pages::double as second_number from con
        union all select 'documents_by_table', table_name, document_name, file_path, round(confidence, 9), n_pages from con
        union all select 'multiple_occurrences', table_name, document_name, null, n, sum(n) over (partition by table_name)
          from (select table_name, document_name, count(*) as n from det
                group by table_name, document_name having count(*) > 1)
        union all select 'table_stats', table_name, null, null, round(avg(confidence), 9), count(*) from con group by table_name
        union all select 'document_stats', document_name, null, null, round(avg(confidence), 9), count(*)
          from con group by document_name
        union all select 'confidence_stats', table_name, null, null, count(*) filter (confidence >= 0.7),
          count(*) filter (confidence < 0.4) from con group by table_name
        union all select distinct 'file_paths', table_name, null, file_path, null::double, null::double
          from con where file_path <> ''
        union all select 'pages', document_name, table_name, null, page, null from con_pages
        union all select 'summary', null, null, null, count(*), round(count(*) / count(distinct table_name), 9) from det"""),
    "consolidate": _sql(_CON),
    "tables_by_document": _sql(_CON),
    "documents_by_table": _sql(_CON),
    "analysis_totals": _sql("""
        select count(*) as total_detections, count(distinct document_name) as unique_documents,
               count(distinct table_name) as unique_tables,
               round(count(*) / count(distinct document_name), 9) as average_detections_per_document,
               round(count(*) / count(distinct table_name), 9) as average_detections_per_table
        from det"""),
    "table_stats": _sql("""
        select table_name, count(distinct document_name) as documents, count(*) as occurrences,
               round(avg(confidence), 9) as avg_confidence, round(min(confidence), 9) as min_confidence,
               round(max(confidence), 9) as max_confidence
        from con group by table_name"""),
    "document_stats": _sql("""
        select document_name, count(distinct table_name) as tables, count(*) as occurrences,
               round(avg(confidence), 9) as avg_confidence
        from con group by document_name"""),
    "document_table_pages": _sql("select document_name, table_name, page from con_pages"),
    "confidence_bands": _sql("""
        select table_name, round(avg(confidence), 9) as avg_confidence,
               count(*) filter (confidence >= 0.7) as high,
               count(*) filter (confidence >= 0.4 and confidence < 0.7) as medium,
               count(*) filter (confidence < 0.4) as low
        from con group by table_name"""),
    "multiple_occurrences": _sql("""
        select table_name, document_name, n as occurrences,
               cast(sum(n) over (partition by table_name) as bigint) as total_multiple
        from (select table_name, document_name, count(*) as n from det
              group by table_name, document_name having count(*) > 1)"""),
    "table_file_paths": _sql("select distinct table_name, file_path from con where file_path <> ''"),
    "confidence_filter": _parts(PAGE_BLOCK, 0.75),
    "export_detection_parts": _parts(3),
    "load_detection_arrays": _parts(3),
    "consolidate_parts": _sql(_CON),
}
