"""Registered queries for sources, store and ingest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators import ingest, page_view
from pagesieve.plans import fixtures as fx
from pagesieve.plans.ingest import ingest_batch as ingest_batch_run
from pagesieve.plans.ingest import search_store as search_stored
from pagesieve.plans.ingest import search_store_pages as search_stored_pages
from pagesieve.session import work_folder
from pagesieve.sources import definitions, manifest, store
from pagesieve.streaming import ingest_stream


# --- inputs derived from the given tables ---------------------------------------------------


def files(spark, sf_dir) -> DataFrame:
    """Documents in the shape of a binaryFile read."""
    return fx.table(spark, sf_dir, "documents").select(
        F.format_string("/data/%s/doc_%d.pdf", "source", "doc_id").alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modificationTime"),
        F.length(F.encode("text", "UTF-8")).cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


def definition_files(spark, sf_dir) -> DataFrame:
    """One JSON definition file per part; some fields are absent, some values invalid."""
    key, size = F.col("p_partkey"), F.col("p_size")
    words = F.concat(F.split("p_name", " "), F.array("p_type"))

    def element(w):
        return F.struct(
            F.when(key % 13 == 0, F.lit("  ")).otherwise(w).alias("search_text"),
            F.when(size % 7 != 0, size % 6 - 1).alias("max_errors"),
            F.when(key % 3 != 0, size / 45).alias("max_error_rate"),
            (key % 2 == 0).alias("match_case"),
            F.when(key % 4 != 0, (size % 5) / 2).alias("weight"),
        )

    rules = F.array(*map(F.lit, ("all_elements", "min_count", "min_percentage", "weighted_score", "fuzzy")))
    entry = F.struct(
        F.format_string("%s#%d", "p_name", "p_partkey").alias("name"),
        F.when(key % 11 != 0, F.get(rules, (key % 5).cast("int"))).alias("match_strategy"),
        F.when(size % 7 != 0, size % 5).alias("min_elements"),
        F.when(key % 3 != 0, size / 40).alias("min_percentage"),
        F.when(key % 17 != 0, F.transform(words, element)).otherwise(F.array()).alias("text_elements"),
    )
    document = F.to_json(F.struct(F.lit("parts").alias("description"), F.array(entry).alias("tables")))
    return fx.table(spark, sf_dir, "part").select(document.alias("json"))


def metadata_history(spark, sf_dir) -> DataFrame:
    """Stored metadata and two later batches that touch some documents again."""
    first = fx.meta(spark, sf_dir).withColumn("batch", F.lit(1).cast("bigint"))
    second = first.filter("doc_id % 3 = 0").withColumns({
        "batch": F.lit(2).cast("bigint"), "file_size": F.col("file_size") + 1,
    })
    third = first.filter("doc_id % 5 = 0").withColumns({
        "batch": F.lit(3).cast("bigint"), "file_path": F.lit(None).cast("string"),
    })
    return first, second.unionByName(third)


def ingest_log(spark, sf_dir) -> DataFrame:
    ok = F.col("doc_id") % 7 != 0
    return fx.meta(spark, sf_dir).select(
        "file_name", "file_hash",
        ok.alias("success"),
        F.when(ok, F.col("page_count")).otherwise(0).alias("pages_processed"),
        F.when(~ok, F.concat(F.lit("cannot open "), "file_name")).alias("error"),
    )


def images(spark, sf_dir) -> DataFrame:
    """Lines as image texts, three per page."""
    return fx.lines(spark, sf_dir).select(
        "doc_id",
        (F.floor(F.col("page") / 3) + 1).cast("int").alias("page"),
        (F.col("page") % 3).alias("image_idx"),
        F.concat(F.lit("\t"), "text", F.lit(" \n")).alias("text"),
    )


# --- queries ------------------------------------------------------------------------------


def file_manifest(spark, sf_dir):
    return manifest.file_manifest(files(spark, sf_dir))


def put_metadata(spark, sf_dir):
    return store.put_metadata(*metadata_history(spark, sf_dir))


def put_page_texts(spark, sf_dir):
    """Second batch: every other page gets a new digital text, every third a new OCR text."""
    stored = fx.channels(spark, sf_dir).withColumn("batch", F.lit(1))
    at = F.col("doc_id") + F.col("page")
    updates = fx.lines(spark, sf_dir).select(
        "doc_id", "page",
        F.when(at % 2 == 0, F.concat(F.lit("new "), "text")).alias("digital"),
        F.when(at % 3 == 0, F.lit("")).alias("ocr"),
        F.lit(2).alias("batch"),
    )
    return store.put_page_texts(stored, updates)


def unroll_pages(spark, sf_dir):
    """Lists of page texts per document, stored as pages from 1."""
    pairs = F.transform(
        F.split("text", "\n"),
        lambda t: F.struct(t.alias("digital"), F.when(F.length(t) % 2 == 0, F.concat(F.lit("ocr "), t)).alias("ocr")),
    )
    return store.unroll_pages(fx.table(spark, sf_dir, "documents").select("doc_id", pairs.alias("pages")))


def get_metadata(spark, sf_dir):
    """Half of the documents are kept in the older nested shape."""
    old = F.col("doc_id") % 2 == 0
    nested = F.struct("page_count", "file_size", "file_hash")
    mixed = fx.meta(spark, sf_dir).withColumn("metadata", F.when(old, nested)).withColumns({
        c: F.when(~old, F.col(c)) for c in ("page_count", "file_size", "file_hash")
    })
    return store.flatten_metadata(mixed)


def get_page_text(spark, sf_dir):
    """One page per labelled document, present in the OCR channel or not."""
    asked = fx.table(spark, sf_dir, "labels").select(
        "doc_id", (F.lit(1) + F.col("quality")).alias("page")
    ).distinct()
    return store.page_texts(fx.channels(spark, sf_dir), asked, "ocr")


def list_docs(spark, sf_dir):
    return store.list_docs(fx.meta(spark, sf_dir))


def load_table_defs(spark, sf_dir):
    rows = definitions.parse_definitions(definition_files(spark, sf_dir), "json")
    return definitions.definition_elements(rows)


def validate_table_defs(spark, sf_dir):
    rows = definitions.parse_definitions(definition_files(spark, sf_dir), "json")
    return definitions.with_violations(rows).select("name", F.array_join("violations", "; ").alias("violations"))


def normalize_page_text(spark, sf_dir):
    """Every third text is wrapped in whitespace, every eleventh is a page that could not be read."""
    at = F.col("doc_id") + F.col("page")
    raw = F.when(at % 11 == 0, None).when(
        at % 3 == 0, F.concat(F.lit(" \t"), "text", F.lit("\r\n "))
    ).otherwise(F.col("text"))
    return fx.lines(spark, sf_dir).select("doc_id", "page", ingest.normalize_page_text(raw).alias("text"))


def fold_image_text(spark, sf_dir):
    return ingest.fold_image_text(fx.meta(spark, sf_dir), images(spark, sf_dir))


def assembled(spark, sf_dir, **switches):
    return ingest.assemble_pages(fx.meta(spark, sf_dir), fx.channels(spark, sf_dir), **switches)


def merge_ocr_digital(spark, sf_dir):
    pages = assembled(spark, sf_dir)
    return ingest.merge_ocr_digital(
        pages.selectExpr("doc_id", "page", "ocr as text"), pages.selectExpr("doc_id", "page", "digital as text")
    )


def merge_ocr_digital_rows(spark, sf_dir):
    """The same on rows that hold both channels: no join."""
    return assembled(spark, sf_dir).select(
        "doc_id", "page", ingest.merged_text(F.col("ocr"), F.col("digital")).alias("text")
    )


def assemble_pages(spark, sf_dir):
    return assembled(spark, sf_dir)


def assemble_pages_without_ocr(spark, sf_dir):
    return assembled(spark, sf_dir, enable_ocr=False)


def build_metadata(spark, sf_dir):
    files = fx.meta(spark, sf_dir).drop("page_count")
    return ingest.build_metadata(files, fx.lines(spark, sf_dir)).drop("processing_date")


def change_detection(spark, sf_dir):
    files = fx.meta(spark, sf_dir).select("doc_id", "file_name", "file_hash")
    return ingest.change_status(files, fx.previous_hashes(spark, sf_dir))


def resume_filter(spark, sf_dir):
    """The log knows the present content of every second document only."""
    log = ingest_log(spark, sf_dir)
    stale = log.withColumn("file_hash", F.when(F.col("pages_processed") % 2 == 0, F.col("file_hash")).otherwise("old"))
    return ingest.resume_filter(fx.meta(spark, sf_dir), stale).select("doc_id", "file_name")


def resume_filter_by_name(spark, sf_dir):
    rows = ingest.resume_filter(fx.meta(spark, sf_dir), ingest_log(spark, sf_dir), by_name_only=True)
    return rows.select("doc_id", "file_name")


def append_log(spark, sf_dir):
    """The log of a run appended to itself: completed files once, failures twice."""
    log = ingest_log(spark, sf_dir)
    return ingest.append_log(log, log)


def ingest_summary(spark, sf_dir):
    return ingest.ingest_summary(ingest_log(spark, sf_dir))


def failed_files(spark, sf_dir):
    return ingest.failed_files(ingest_log(spark, sf_dir))


def _extracts(documents: DataFrame) -> DataFrame:
    """Page rows as an extraction delivers them (``schemas.EXTRACT``); every other line was read by OCR as well."""
    pages = documents.select("*", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return pages.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.format_string("doc_%d.pdf", "doc_id").alias("file_name"),
        F.format_string("/data/%s/doc_%d.pdf", "source", "doc_id").alias("file_path"),
        F.col("n_chars").alias("file_size"),
        F.md5("text").alias("file_hash"),
        F.lit(0.0).alias("last_modified"),
        (F.col("at") + 1).alias("page"),
        F.col("line").alias("digital"),
        F.when(F.length("line") % 2 == 0, F.concat(F.lit("ocr "), "line")).alias("ocr"),
    )


def _stream_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, because the table may be one file or a folder of files
    return _extracts(ingest_stream.read_extracts(
        spark, f"{sf_dir}/documents.parque[t]", "doc_id bigint, text string, source string, n_chars bigint"
    ))


def _stored_pages(target: store.PageStore) -> DataFrame:
    return target.channels().withColumn("doc_id", F.col("doc_id").cast("bigint"))


def incremental_stream(spark, sf_dir):
    """Stream the documents into a store, run the stream again, and read the stored pages."""
    folder = work_folder(spark, "stream")
    target = store.PageStore(spark, f"{folder}/store")
    for _ in range(2):
        run = ingest_stream.start_ingest(_stream_input(spark, sf_dir), target, f"{folder}/checkpoint")
        run.awaitTermination()
    return _stored_pages(target)


def store_reingest(spark, sf_dir):
    """Two writers that number their batches alike: all documents, then changed, unchanged and new ones, one batch twice,
    then OCR for documents that have none yet, and a compaction."""
    target = store.PageStore(spark, f"{work_folder(spark, 'reingest')}/store")
    first = _extracts(fx.table(spark, sf_dir, "documents")).withColumn("ocr", F.lit(None).cast("string"))
    key = F.col("doc_id").cast("bigint")
    newer = first.filter(key % 3 == 0).withColumns({
        "digital": F.concat(F.lit("new "), "digital"), "file_hash": F.concat(F.lit("new"), "file_hash"),
    })
    added = first.filter(key % 10 == 0).withColumn("doc_id", (key + 1_000_000).cast("string"))
    second = newer.unionByName(first.filter(key % 3 == 1)).unionByName(added)
    third = first.filter((key % 3 != 0) & (key % 4 == 1)).withColumns({
        "ocr": F.concat(F.lit("ocr "), "digital"), "digital": F.lit(None).cast("string"),
    })
    for rows, writer, batch in ((first, "a", 0), (second, "b", 0), (second, "b", 0), (third, "a", 1)):
        ingest_stream.store_extracts(target, rows, writer, batch)
    target.compact(0)
    return _stored_pages(target)


def _ingested(spark, sf_dir) -> store.PageStore:
    """Two runs over all files: the first fails for some, the second tries what is left and still fails for a few."""
    target = store.PageStore(spark, f"{work_folder(spark, 'ingest')}/store")
    text_id = F.col("doc_id").cast("string")
    listed = fx.meta(spark, sf_dir).drop("page_count").withColumns({"doc_id": text_id, "last_modified": F.lit(0.0)})
    pages = fx.channels(spark, sf_dir).withColumn("doc_id", text_id)
    for batch, step in enumerate((7, 14)):
        broken = listed.filter(F.col("doc_id").cast("bigint") % step == step - 7).select(
            "file_name", F.concat(F.lit("cannot open "), "file_name").alias("error")
        )
        ingest_batch_run(target, batch, listed, pages, failures=broken)
    return target


def ingest_batch(spark, sf_dir):
    """The log of the runs."""
    return _ingested(spark, sf_dir).run_log()


def search_store(spark, sf_dir):
    """Tables in all stored documents; those whose files could not be opened are not there."""
    found = search_stored(_ingested(spark, sf_dir), fx.RULES)
    return found.withColumns({
        "doc_id": F.col("doc_id").cast("bigint"), "confidence_score": F.round("confidence_score", 6),
    })


def search_store_pages(spark, sf_dir):
    """The pages and details of ``search_store``."""
    found = search_stored_pages(_ingested(spark, sf_dir), fx.RULES)
    return found.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "score": F.round("score", 6)})


def pages_combined(spark, sf_dir):
    return page_view.pages_combined(
        page_view.join_channels(fx.digital(spark, sf_dir), fx.ocr(spark, sf_dir))
    )


def pages_combined_rows(spark, sf_dir):
    """The merged view over rows that hold both channels, as in the store: no join."""
    return fx.pages(spark, sf_dir)


def pages_preferred(spark, sf_dir):
    return page_view.pages_preferred(
        page_view.join_channels(fx.digital(spark, sf_dir), fx.ocr(spark, sf_dir)), prefer="OCR"
    )


def pages_preferred_digital(spark, sf_dir):
    return page_view.pages_preferred(fx.channels(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        file_manifest, put_metadata, put_page_texts, unroll_pages, get_metadata, get_page_text, list_docs,
        load_table_defs, validate_table_defs, normalize_page_text, fold_image_text, merge_ocr_digital,
        merge_ocr_digital_rows, assemble_pages, assemble_pages_without_ocr, build_metadata,
        change_detection, resume_filter, resume_filter_by_name, append_log, ingest_summary, failed_files,
        incremental_stream, store_reingest, ingest_batch, search_store, search_store_pages, pages_combined, pages_combined_rows, pages_preferred, pages_preferred_digital,
    )
}

_LOG = """
    select file_name, file_hash, doc_id % 7 <> 0 as success,
           cast(case when doc_id % 7 <> 0 then page_count else 0 end as integer) as pages_processed,
           case when doc_id % 7 = 0 then 'cannot open ' || file_name end as error, doc_id
    from fx_meta"""

_DEFINITIONS = """
    select *, ['all_elements', 'min_count', 'min_percentage', 'weighted_score', 'fuzzy'] as rules,
           p_name || '#' || p_partkey as name,
           case when p_partkey % 17 = 0 then [] else list_concat(string_split(p_name, ' '), [p_type]) end as words,
           coalesce(case when p_partkey % 11 <> 0 then rules[p_partkey % 5 + 1] end, 'min_count') as match_strategy,
           cast(case when p_size % 7 <> 0 then p_size % 5 else 3 end as integer) as min_elements,
           case when p_partkey % 3 <> 0 then p_size / 40 else 0.6::double end as min_percentage,
           cast(case when p_size % 7 <> 0 then p_size % 6 - 1 else 2 end as integer) as max_errors,
           case when p_partkey % 3 <> 0 then p_size / 45 else 0.3::double end as max_error_rate,
           case when p_partkey % 4 <> 0 then (p_size % 5) / 2 else 1.0::double end as weight
    from part"""

_PADDED = """
    select l.doc_id, l.page, coalesce(d.text, '') as digital, coalesce(o.text, '') as ocr
    from fx_lines l left join fx_digital d on l.doc_id = d.doc_id and l.page = d.page
                    left join fx_ocr o on l.doc_id = o.doc_id and l.page = o.page"""

_STRIPPED = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_CHANNELS = ["fx_digital", "fx_ocr"]
_MERGED = fx.sql(_CHANNELS, f"""
    select doc_id, page, {_STRIPPED.format("ocr || ' ' || digital")} as text from padded""", {"padded": _PADDED})
_PAIRS = """
    select doc_id, page, {} as digital, {} as ocr from fx_lines"""
_EVEN = "case when length(text) % 2 = 0 then 'ocr ' || text end"

SQL = {
    "file_manifest": """
        select 'doc_' || doc_id as doc_id, 'doc_' || doc_id || '.pdf' as file_name,
               '/data/' || source || '/doc_' || doc_id || '.pdf' as file_path,
               cast(strlen(text) as bigint) as file_size,
               cast(1700000000 + doc_id as double) as last_modified, md5(text) as file_hash
        from documents""",
    "put_metadata": fx.sql(["fx_meta"], """
        select doc_id, file_name, case when doc_id % 5 = 0 then null else file_path end as file_path, page_count,
               case when doc_id % 5 <> 0 and doc_id % 3 = 0 then file_size + 1 else file_size end as file_size,
               file_hash,
               cast(case when doc_id % 5 = 0 then 3 when doc_id % 3 = 0 then 2 else 1 end as bigint) as batch
        from fx_meta"""),
    "put_page_texts": fx.sql(_CHANNELS, """
        select l.doc_id, l.page,
               case when (l.doc_id + l.page) % 2 = 0 then 'new ' || l.text else d.text end as digital,
               case when (l.doc_id + l.page) % 3 = 0 then '' else o.text end as ocr
        from fx_lines l left join fx_digital d on l.doc_id = d.doc_id and l.page = d.page
                        left join fx_ocr o on l.doc_id = o.doc_id and l.page = o.page"""),
    "unroll_pages": fx.sql(["fx_lines"], _PAIRS.format("text", _EVEN)),
    "get_metadata": fx.sql(["fx_meta"], "select * from fx_meta"),
    "get_page_text": fx.sql(["fx_ocr"], """
        select a.doc_id, a.page, o.text
        from (select distinct doc_id, 1 + quality as page from labels) a
        left join fx_ocr o on a.doc_id = o.doc_id and a.page = o.page"""),
    "list_docs": "select doc_id from documents order by cast(doc_id as varchar)",
    "load_table_defs": fx.sql([], """
        select name, match_strategy, min_elements, min_percentage, 0.7::double as min_score,
               cast(generate_subscripts(words, 1) - 1 as integer) as elem_idx,
               case when p_partkey % 13 = 0 then '  ' else unnest(words) end as search_text,
               max_errors, max_error_rate, p_partkey % 2 = 0 as match_case, weight, '' as description
        from defs""", {"defs": _DEFINITIONS}),
    "validate_table_defs": fx.sql([], """
        select name, array_to_string(list_filter([
            case when len(words) > 0 and p_partkey % 13 = 0 then 'blank search_text' end,
            case when len(words) > 0 and max_errors < 0 then 'negative max_errors' end,
            case when len(words) > 0 and max_error_rate > 1 then 'max_error_rate out of range' end,
            case when len(words) > 0 and weight <= 0 then 'weight not positive' end,
            case when len(words) = 0 then 'no elements' end,
            case when match_strategy = 'fuzzy' then 'unknown match_strategy' end,
            case when min_elements < 1 then 'min_elements below 1' end,
            case when match_strategy = 'min_count' and len(words) > 0 and min_elements > len(words)
                 then 'min_elements above number of elements' end,
            case when min_percentage > 1 then 'min_percentage out of range' end
          ], lambda x: x is not null), '; ') as violations
        from defs""", {"defs": _DEFINITIONS}),
    "normalize_page_text": fx.sql(["fx_lines"], f"""
        select doc_id, page,
               case when (doc_id + page) % 11 = 0 then '' else {_STRIPPED.format('text')} end as text
        from fx_lines"""),
    "fold_image_text": fx.sql(["fx_lines", "fx_meta"], f"""
        select l.doc_id, l.page, coalesce(i.text, '') as text
        from fx_lines l left join (
          select doc_id, page // 3 + 1 as page, string_agg(text, ' ' order by page % 3) as text
          from (select doc_id, page, {_STRIPPED.format('text')} as text from fx_lines) where text <> ''
          group by doc_id, page // 3 + 1) i on l.doc_id = i.doc_id and l.page = i.page"""),
    "merge_ocr_digital": _MERGED,
    "merge_ocr_digital_rows": _MERGED,
    "assemble_pages": fx.sql(_CHANNELS, "select * from padded", {"padded": _PADDED}),
    "assemble_pages_without_ocr": fx.sql(
        _CHANNELS, "select doc_id, page, digital, '' as ocr from padded", {"padded": _PADDED}
    ),
    "build_metadata": fx.sql(["fx_meta"], "select * from fx_meta"),
    "change_detection": fx.sql(["fx_meta", "fx_prev"], """
        select m.doc_id, m.file_name, m.file_hash,
               case when p.doc_id is null then 'new' when p.file_hash is null then 'no_stored_hash'
                    when p.file_hash = m.file_hash then 'unchanged' else 'changed' end as status
        from fx_meta m left join fx_prev p on m.doc_id = p.doc_id"""),
    "resume_filter": fx.sql(["fx_meta"], """
        select doc_id, file_name from log where not (success and pages_processed % 2 = 0)""", {"log": _LOG}),
    "resume_filter_by_name": fx.sql(
        ["fx_meta"], "select doc_id, file_name from log where not success", {"log": _LOG}
    ),
    "append_log": fx.sql(["fx_meta"], """
        select file_name, file_hash, success, pages_processed, error
        from log, unnest(case when success then [1] else [1, 2] end)""", {"log": _LOG}),
    "ingest_summary": fx.sql(["fx_meta"], """
        select count(*) as total_files, count(*) filter (success) as successful,
               count(*) filter (not success) as failed,
               cast(coalesce(sum(pages_processed) filter (success), 0) as bigint) as total_pages
        from log""", {"log": _LOG}),
    "failed_files": fx.sql(
        ["fx_meta"], "select file_name, error from log where not success", {"log": _LOG}
    ),
    "incremental_stream": fx.sql(["fx_lines"], _PAIRS.format(
        _STRIPPED.format("text"), _STRIPPED.format(f"coalesce({_EVEN}, '')")
    )),
    "store_reingest": fx.sql(["fx_lines"], f"""
        select doc_id, page, case when doc_id % 3 = 0 then {_STRIPPED.format("'new ' || text")} else {_STRIPPED.format('text')} end
                 as digital,
               case when doc_id % 3 <> 0 and doc_id % 4 = 1 then {_STRIPPED.format("'ocr ' || text")} else '' end as ocr
        from fx_lines
        union all select doc_id + 1000000, page, {_STRIPPED.format('text')}, '' from fx_lines where doc_id % 10 = 0"""),
    "ingest_batch": fx.sql(["fx_meta"], """
        select file_name, file_hash, true as success, page_count as pages_processed, null as error
        from fx_meta where doc_id % 14 <> 7
        union all
        select file_name, file_hash, false, 0, 'cannot open ' || file_name
        from fx_meta, unnest(case when doc_id % 14 = 7 then [1, 2] else [1] end) where doc_id % 7 = 0"""),
    "search_store": fx.sql(["fx_verdicts", "fx_meta"], """
        select v.table_name, v.doc_id, true as found, count(*) as n_pages, round(avg(score), 6) as confidence_score,
               any_value(replace(m.file_path, '\\', '/')) as file_path
        from fx_verdicts v join fx_meta m on v.doc_id = m.doc_id
        where found and v.doc_id % 14 <> 7 group by v.table_name, v.doc_id"""),
    "search_store_pages": fx.sql(["fx_verdicts"], """
        select table_name, doc_id, page, round(score, 6) as score, details
        from fx_verdicts where found and doc_id % 14 <> 7"""),
    "pages_combined": fx.sql(["fx_pages"], "select doc_id, page, text from fx_pages"),
    "pages_combined_rows": fx.sql(["fx_pages"], "select doc_id, page, text from fx_pages"),
    "pages_preferred": fx.sql(_CHANNELS, """
        select doc_id, page, case when d.text is null or o.text <> '' then o.text else d.text end as text
        from fx_digital d full outer join fx_ocr o using (doc_id, page)"""),
    "pages_preferred_digital": fx.sql(_CHANNELS, """
        select doc_id, page, case when d.text is null then o.text else d.text end as text
        from fx_digital d full outer join fx_ocr o using (doc_id, page)"""),
}
