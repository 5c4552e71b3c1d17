"""Registered queries for the inventory reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions.text import sanitize
from pagesieve.operators import inventory
from pagesieve.plans import fixtures as fx
from pagesieve.plans.analysis_queries import written
from pagesieve.session import work_folder
from pagesieve.sources.detections import write_frames, write_ordered


def _store(spark, sf_dir):
    return fx.meta(spark, sf_dir), fx.channels(spark, sf_dir)


def _gaps(spark, sf_dir):
    """Metadata with missing paths, sizes and hashes."""
    key = F.col("doc_id")
    return fx.meta(spark, sf_dir).withColumns({
        "file_path": F.when(key % 3 != 0, F.col("file_path")),
        "file_size": F.when(key % 5 != 0, F.col("file_size")),
        "file_hash": F.when(key % 7 == 0, "").when(key % 7 != 1, F.col("file_hash")),
    })


def sanitize_text(spark, sf_dir):
    """Whole documents; underscores in some of them."""
    marked = F.when(
        F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("the"), F.lit("_____"))
    ).otherwise(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", sanitize(marked).alias("text"))


def document_overview(spark, sf_dir):
    return inventory.document_overview(_gaps(spark, sf_dir))


def digital_text_report(spark, sf_dir):
    return inventory.channel_text_report(*_store(spark, sf_dir), "digital")


def ocr_text_report(spark, sf_dir):
    return inventory.channel_text_report(*_store(spark, sf_dir), "ocr")


def combined_page_report(spark, sf_dir):
    return inventory.combined_page_report(*_store(spark, sf_dir))


def corpus_statistics(spark, sf_dir):
    return inventory.corpus_statistics(*_store(spark, sf_dir))


def quick_overview(spark, sf_dir):
    return inventory.quick_overview(_gaps(spark, sf_dir))


def quick_page_summary(spark, sf_dir):
    """Under a longer document id, so that it is cut."""
    long_id = F.format_string("scanned-file-%d", "doc_id")
    meta, channels = _store(spark, sf_dir)
    return inventory.quick_page_summary(
        meta.withColumn("doc_id", long_id), channels.withColumn("doc_id", long_id)
    )


def quick_statistics(spark, sf_dir):
    return inventory.quick_statistics(*_store(spark, sf_dir))


def page_lengths_fallback(spark, sf_dir):
    return inventory.page_lengths(*_store(spark, sf_dir))


# What is compared of each report: two keys, a text and two numbers.
_REPORTS = {
    "document_overview": ("file_name", "page_count", "file_path", None, None),
    "digital_text": ("file_name", None, "text", "page", "text_length"),
    "ocr_text": ("file_name", None, "text", "page", "text_length"),
    "combined_pages": ("file_name", "has_ocr", "digital_preview", "page", "total_length"),
    "summary_statistics": ("metric", None, None, "value", None),
}


def write_reports(spark, sf_dir):
    paths = write_frames(inventory.report_frames(*_store(spark, sf_dir)), work_folder(spark, "reports"))
    return written(spark, paths, _REPORTS, "parquet")


def ordered_reports(spark, sf_dir):
    """The combined page report, written in the order of documents and pages in numbered parts of 1,000 rows."""
    path = f"{work_folder(spark, 'reports')}/combined"
    report = inventory.combined_page_report(*_store(spark, sf_dir))
    write_ordered(report, path, ["doc_id", "page"], part_rows=1000)
    return spark.read.schema("doc_id bigint, page int, total_length int, row bigint, part bigint").parquet(path)


def run_comparison(spark, sf_dir):
    """One run per user of the event table."""
    runs = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.sum("value"), 3).alias("execution_time_seconds"),
        F.max("value").alias("memory_peak_mb"),
        (F.count("*") / (F.col("user_id") % 5 + 1)).alias("throughput_files_per_second"),
        (F.count_if(F.col("event_type") == "error") % 2 == 0).alias("success"),
    ).withColumn("implementation", F.format_string("user %d", "user_id"))
    return inventory.run_comparison(runs).withColumn("speedup_factor", F.round("speedup_factor", 6))


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_text, document_overview, digital_text_report, ocr_text_report, combined_page_report,
        corpus_statistics, quick_overview, quick_page_summary, quick_statistics, page_lengths_fallback,
        write_reports, ordered_reports, run_comparison,
    )
}


def _sanitized(text: str) -> str:
    clean = (
        f"regexp_replace(regexp_replace(regexp_replace({text}, '_{{3,}}', '_', 'g'), "
        r"'[^\x20-\x7E\n\r\t]', '', 'g'), '\s+', ' ', 'g')"
    )
    cut = f"(case when length({clean}) > 500 then {clean}[1:497] || '...' else {clean} end)"
    return (
        f"case when coalesce({text}, '') = '' then '' when trim({cut}) = '' then 'No text available' "
        f"else trim({cut}) end"
    )


_GAPS = """
    select doc_id, file_name, page_count, case when doc_id % 3 <> 0 then file_path end as file_path,
           case when doc_id % 5 <> 0 then file_size end as file_size,
           case when doc_id % 7 = 0 then '' when doc_id % 7 <> 1 then file_hash end as file_hash
    from fx_meta"""

_SPINE = """
    select l.doc_id, l.page, 'doc_' || l.doc_id || '.pdf' as file_name, d.text as digital, o.text as ocr,
           cast(coalesce(length(d.text), 0) as integer) as dl, cast(coalesce(length(o.text), 0) as integer) as ol
    from fx_lines l left join fx_digital d on l.doc_id = d.doc_id and l.page = d.page
                    left join fx_ocr o on l.doc_id = o.doc_id and l.page = o.page"""


def _sql(body: str) -> str:
    return fx.sql(["fx_meta", "fx_digital", "fx_ocr"], body, {"gaps": _GAPS, "spine": _SPINE})


def _report(channel: str) -> str:
    return _sql(f"""
        select doc_id, page, {_sanitized(channel)} as text, cast(length({channel}) as integer) as text_length, file_name
        from spine where {channel} <> ''""")


# Fixed values in the texts below: the names of the metrics, N/A, Yes, No and the text of an empty cell.
_HASH = "case when coalesce(file_hash, '') <> '' then file_hash[1:{}] || '...' else 'N/A' end"

SQL = {
    "sanitize_text": fx.sql([], f"select doc_id, {_sanitized('text')} as text from marked", {
        "marked": """select doc_id, case when doc_id % 2 = 0 then replace(text, 'the', '_____')
                     else text end as text from documents""",
    }),
    "document_overview": _sql(f"""
        select doc_id, file_name, coalesce(file_path, 'N/A') as file_path,
               cast(page_count as varchar) as page_count, coalesce(cast(file_size as varchar), 'N/A') as file_size,
               {_HASH.format(16)} as file_hash
        from gaps"""),
    "digital_text_report": _report("digital"),
    "ocr_text_report": _report("ocr"),
    "combined_page_report": _sql(f"""
        select doc_id, file_name, page, dl as digital_length, ol as ocr_length,
               cast(dl + ol as integer) as total_length, case when dl > 0 then 'Yes' else 'No' end as has_digital,
               case when ol > 0 then 'Yes' else 'No' end as has_ocr,
               {_sanitized('dp')} as digital_preview, {_sanitized('op')} as ocr_preview
        from (select *, digital[1:200] as dp, ocr[1:200] as op from spine)"""),
    "corpus_statistics": _sql("""
        select unnest(['Total Documents', 'Total Pages', 'Total Digital Text Characters',
                       'Total OCR Text Characters', 'Total Text Characters', 'Average Pages per Document']) as metric,
               unnest([docs::double, pages::double, d::double, o::double, (d + o)::double,
                       cast(printf('%.2f', pages / docs) as double)]) as value
        from (select (select count(*) from fx_meta) as docs, count(*) as pages, sum(dl) as d, sum(ol) as o from spine)"""),
    "quick_overview": _sql(f"""
        select doc_id, file_name, cast(page_count as varchar) as pages,
               case when coalesce(file_size, 0) <> 0 then printf('%.1f', file_size / 1024) else 'N/A' end as size_kb,
               {_HASH.format(12)} as hash
        from gaps"""),
    "quick_page_summary": _sql("""
        select case when length('scanned-file-' || doc_id) > 15 then ('scanned-file-' || doc_id)[1:15] || '...'
                    else 'scanned-file-' || doc_id end as doc_id, page, dl as digital, ol as ocr,
               cast(dl + ol as integer) as total
        from spine"""),
    "quick_statistics": _sql("""
        select pages, d as digital_characters, o as ocr_characters, d + o as total_characters,
               cast(printf('%.1f', pages / docs) as double) as average_pages
        from (select (select count(*) from fx_meta) as docs, count(*) as pages, cast(sum(dl) as bigint) as d,
                     cast(sum(ol) as bigint) as o from spine)"""),
    "page_lengths_fallback": _sql(
        "select doc_id, page, file_name, dl as digital_length, ol as ocr_length from spine"
    ),
    "write_reports": _sql(f"""
        select 'document_overview' as frame, file_name as key, cast(page_count as varchar) as second_key,
               coalesce(file_path, 'N/A') as text, null::double as number, null::double as second_number from fx_meta
        union all select 'digital_text', file_name, null, {_sanitized('digital')}, page, length(digital)
          from spine where digital <> ''
        union all select 'ocr_text', file_name, null, {_sanitized('ocr')}, page, length(ocr) from spine where ocr <> ''
        union all select 'combined_pages', file_name, case when ol > 0 then 'Yes' else 'No' end, {_sanitized('dp')}, page, dl + ol
          from (select *, digital[1:200] as dp from spine)
        union all select 'summary_statistics', unnest(['Total Documents', 'Total Pages', 'Total Digital Text Characters',
                 'Total OCR Text Characters', 'Total Text Characters', 'Average Pages per Document']), null, null,
               unnest([docs::double, pages::double, d::double, o::double, (d + o)::double,
                       cast(printf('%.2f', pages / docs) as double)]), null
          from (select (select count(*) from fx_meta) as docs, count(*) as pages, sum(dl) as d, sum(ol) as o from spine)"""),
    "ordered_reports": _sql("""
        select doc_id, page, cast(dl + ol as integer) as total_length, n as row, n // 1000 as part
        from (select *, row_number() over (order by doc_id, page) - 1 as n from spine)"""),
    "run_comparison": """
        with runs as (
          select 'user ' || user_id as implementation, round(sum(value), 3) as secs, max(value) as mem,
                 count(*) / (user_id % 5 + 1) as rate,
                 count(*) filter (event_type = 'error') % 2 = 0 as success
          from events group by user_id),
        good as (select * from runs where success)
        select (select implementation from good order by secs, implementation limit 1) as fastest_implementation,
               (select min(secs) from good) as fastest_time_seconds,
               (select implementation from good order by secs desc, implementation limit 1) as slowest_implementation,
               (select max(secs) from good) as slowest_time_seconds,
               (select round(max(secs) / min(secs), 6) from good) as speedup_factor,
               (select implementation from good order by mem, implementation limit 1) as lowest_memory_implementation,
               (select min(mem) from good) as lowest_memory_mb,
               (select implementation from good order by mem desc, implementation limit 1) as highest_memory_implementation,
               (select max(mem) from good) as highest_memory_mb,
               (select implementation from good order by rate desc, implementation limit 1)
                 as highest_throughput_implementation,
               (select max(rate) from good) as highest_throughput_files_per_second,
               (select count(*) from runs) as total_benchmarks,
               (select count(*) from good) as successful_benchmarks""",
}
