"""The registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm import (
    byte_bpe,
    embedding_join,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    periodic_runs,
    prefix_trie,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
    vocabularies,
)
from pagesieve.llm.tables import fold, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Context limits and shares of documents asked for besides the lengths that occur.
LIMITS = [256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 131072]
SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return token_counts.limits(token_counts.length_histogram(docs, vocabularies.path(RANKS, spark)), LIMITS, SHARES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    network = toxicity.fit(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "html"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, vocabularies.path(RANKS, spark)).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    judged = language_id.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.find_runs(docs, F.crc32(F.col("doc_id").cast("string"))))


# The declared rules.
URL_RULES = [
    url_filter.Rule.of(verdict, text)
    for verdict, text in (
        ("allow", "com/"),
        ("block", "example.com/en/"),
        ("allow", "www.example.com/en/"),
        ("block", "net/es/"),
        ("block", "net/fr/"),
    )
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "labelled", "bad")


QUERIES = {
    q.__name__: q
    for q in (
        op1_jaccard_join,
        op2_mixing,
        op3_exact_dedup,
        op4_token_counts,
        op5_secret_scan,
        op6_toxicity,
        op7_html_text,
        op8_byte_bpe,
        op9_language_id,
        op10_embedding_join,
        op11_prefix_trie,
        op12_periodic_runs,
        op13_url_filter,
    )
}

SQL = {
    "op3_exact_dedup": """
        with hashed as (
            select doc_id, length(coalesce(text, '')) as n,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256
            from documents
        )
        select doc_id,
               first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as kept,
               text_sha256
        from hashed
    """,
    "op11_prefix_trie": """
        with crc_table as (
            select list(v order by i) as tab from (
                select i, list_reduce(list_prepend(i::ubigint, [0::ubigint for x in range(8)]), lambda a, b:
                           case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) as v
                from (select unnest(range(256)) as i))
        ),
        turns as (
            select conv_id as c, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) as v,
                   row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p
            from conversations where conv_id is not null
        ),
        given as (select c, list(v order by p) as l from turns group by c),
        named as (
            select c, l, c - c % 5 as base,
                   xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(d)::ubigint for d in string_split(c::varchar, '')]),
                       lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint % 9 as h
            from given, crc_table
        ),
        convs as (
            select n.c, list_concat(coalesce(b.l[1:n.h], []), n.l[n.h + 1:]) as l
            from named n left join given b on b.c = n.base
        ),
        paths as (select c, l, unnest(range(0, len(l) + 1)) as d from convs),
        nodes as (
            select d, l[1:d] as k, min(c) as conv_id, count(*) as n_convs,
                   coalesce(string_agg(c::varchar, ',' order by c) filter (len(l) = d), '') as ends
            from paths group by all
        ),
        counted as (
            select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * coalesce(strlen(k[d].x), 0) as saved
            from nodes n left join (
                select d - 1 as d, k[1:d - 1] as k, count(*) as n_children from nodes where d > 0 group by all) using (d, k)
        ),
        above as (select unnest(range(0, d + 1)) as a, k, saved, n_children from counted),
        sums as (
            select a as d, k[1:a] as k, sum(saved)::bigint as saved_tokens, sum((n_children = 0)::int)::bigint as n_leaves
            from above group by all
        )
        select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
               sha256(n.ends) as ends_sha256
        from counted n join sums s using (d, k) left join nodes p on p.d = n.d - 1 and p.k = n.k[1:n.d - 1]
    """,
    "op13_url_filter": f"""
        with cut_up as (
            select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ),
        parted as (
            select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut_up
        ),
        rows as (
            select page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from parted
        ),
        rules as (
            select * from (values {", ".join(f"('{r.text}', '{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)})
                as v(rule, verdict, r_host, r_path)
        ),
        ruled as (
            select w.host, w.path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
            from (select distinct host, path from rows) w join rules r
              on (w.host = r_host or ends_with(w.host, '.' || r_host)) and starts_with(w.path, r_path)
            group by all
        ),
        marks as (
            select doc_id as page_id, max((coalesce(toxic = 1, false) or coalesce(quality = 0, false))::int) as bad
            from labels where doc_id is not null and (toxic is not null or quality is not null) group by doc_id
        ),
        hosts as (
            select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad,
                   regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') as name
            from rows left join marks using (page_id) group by host
        ),
        parts as (select *, string_split(name, '.') as p, name similar to '[0-9.]+' or starts_with(name, '[') as address from hosts),
        ends as (
            select *, case when array_to_string(p[-2:], '.') in ({", ".join(f"'{x}'" for x in url_filter.SUFFIXES)}) then 2 else 1 end as e
            from parts
        ),
        known as (
            select host, n, bad, name, case when address then name else array_to_string(p[-1 - e:], '.') end as domain,
                   case when address then '' else array_to_string(p[-e:], '.') end as suffix
            from ends
        ),
        total as (select sum(bad) / greatest(sum(n), 1) as m from known),
        s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(m) as m from known, total group by suffix),
        r0 as (select {{rho}} as s from s0),
        s1 as (select s0.*, (s * m + bad) / (s + n) as mean from s0, r0),
        d0 as (
            select domain, suffix, sum(k.n) as n, sum(k.bad) as bad, any_value(mean) as m
            from known k join s1 using (suffix) group by domain, suffix
        ),
        r1 as (select {{rho}} as s from d0),
        d1 as (select d0.*, (s * m + bad) / (s + n) as mean from d0, r1),
        h0 as (
            select name, domain, suffix, sum(k.n) as n, sum(k.bad) as bad, any_value(mean) as m
            from known k join d1 using (domain, suffix) group by name, domain, suffix
        ),
        r2 as (select {{rho}} as s from h0),
        h1 as (select h0.*, (s * m + bad) / (s + n) as mean, s + n as weight from h0, r2),
        judged as (
            select k.host, k.n, k.bad, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (weight + 1)) > {url_filter.LIMIT} as blocked
            from known k join h1 using (name, domain, suffix)
        )
        select page_id, host, path, rule, coalesce(verdict, case when blocked then 'block' else 'allow' end) as verdict,
               n as labelled, bad
        from (select page_id, coalesce(host, '') as host, coalesce(path, '') as path from rows)
        join judged using (host) left join ruled using (host, path)
    """.replace(
        "{rho}",
        f"1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), "
        f"{url_filter.LEAST_RHO}), {url_filter.MOST_RHO}) - 1",
    ),
}
