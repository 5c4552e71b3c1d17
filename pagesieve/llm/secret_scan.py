"""Secret scans: declared patterns, and long tokens that look more random than like an identifier.

Patterns (fixed values; letters of the words in `assign` in either case):
assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+), group 2 of 6 characters or more
access  AKIA[A-Z0-9]+, 20 characters or more
hex     [0-9a-f]+, 24 characters or more

The method adds kind `random`: runs of 16 characters or more of [A-Za-z0-9+/_=-] that overlap no pattern's span and
whose log-likelihood under a Markov model of random strings exceeds that under one of ordinary identifiers by
`THRESHOLD` per character. Both models are first-order over characters, trained on labelled samples: what the
patterns matched in all documents (values, keys, hex runs) against the other tokens of a hash sample of documents.

Everything here is SQL functions. Positions are found without a match-position function: matches are wrapped in marks that
the text cannot hold, the text is split at the marks, and lengths add up to positions. Only texts with a match go that way.

Defined cases: a null text counts as empty; a text without spans has counts 0, empty `spans` and the digest of the empty
string; characters are code points, ends are exclusive; rows repeat if they repeat in the input; without
training samples the model adds nothing. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import bound, running_starts

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is taken whole, so asking for its length is dropping shorter ones
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
PLAIN = r"[A-Za-z0-9+/_=-]{4,}"
KINDS = ("assign", "access", "hex", "random")

#: The mark around a match, and what stands for it where a text already has it.
_MARK, _MARK_AS = "\ue000", "\ue001"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio in nats for each character above which a run is reported.
THRESHOLD = 0.3
#: About so many documents with ordinary tokens train their model; they are chosen by a hash of the id. What the
#: patterns match trains from all documents, however rare it is.
SAMPLE = 20_000


def _matches(text: Column, pattern: str) -> Column:
    """Matches in order as structs (start, stop, value); the pattern must not match an empty string."""
    marked = F.regexp_replace(F.translate(text, _MARK, _MARK_AS), f"({pattern})", f"{_MARK}$1{_MARK}")

    def placed(pieces: Column) -> Column:
        starts = running_starts(F.transform(pieces, F.length))
        spans = F.zip_with(
            starts,
            pieces,
            lambda at, piece: F.struct(at.alias("start"), (at + F.length(piece)).alias("stop"), piece.alias("value")),
        )
        # Pieces at odd places are matches.
        return F.filter(spans, lambda span, i: i % 2 == 1)

    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    return F.when(text.rlike(pattern), bound(F.split(marked, _MARK, -1), placed)).otherwise(none)


def _value(match: Column) -> Column:
    """Group 2 of an assignment: the run of value characters at the end of the match."""
    return F.regexp_extract(match, ASSIGN, 1)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each declared kind."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_matches(text, ASSIGN.replace("([", "(?:[")), lambda m: F.length(_value(m["value"])) >= 6)
    return {"assign": assign, "access": _matches(text, ACCESS), "hex": _matches(text, HEX)}


def _with_base(docs: DataFrame) -> DataFrame:
    spans = base_spans(F.col("text"))
    row = F.struct(*[c.alias(k) for k, c in spans.items()])
    # What a generator puts out is computed once, however often it is used.
    return docs.select("doc_id", "text", F.inline_outer(F.array(row)))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all pairs of characters, by row of the first.

    Rows and columns are the characters of the alphabet and, last, the edge of a token.
    """
    text = F.coalesce("text", F.lit(""))
    rest = F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    total = docs.count()
    if total > sample:
        total = docs.filter(rest.rlike(PLAIN)).count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    chosen = place < (min(1.0, sample / total) if total else 1.0)
    hits = F.concat(
        F.transform("assign", lambda m: _value(m["value"])),
        F.transform("access", lambda m: m["value"]),
        F.transform("hex", lambda m: m["value"]),
    )
    plain = F.when(chosen, F.regexp_extract_all(rest, F.lit(PLAIN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    tokens = _with_base(docs).select(
        F.explode(
            F.concat(
                F.transform(F.filter(hits, lambda t: F.length(t) >= 12), lambda t: F.struct(F.lit(1).alias("label"), t.alias("token"))),
                F.transform(F.array_distinct(plain), lambda t: F.struct(F.lit(0).alias("label"), t.alias("token"))),
            )
        ).alias("t")
    ).select("t.label", "t.token")
    counted = (
        tokens.select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
        .groupBy("label", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most two counts for each pair of characters come back, however many documents there are.
    return ratios({(r["label"], r["pair"]): r["n"] for r in counted.collect()})


def ratios(counts: dict[tuple[int, int], int]) -> list[float]:
    """Smoothed log ratios from counts by (label, pair)."""
    size = len(ALPHABET) + 1
    out = []
    totals = [[sum(counts.get((label, a * size + b), 0) for b in range(size)) for a in range(size)] for label in (0, 1)]
    if not sum(totals[0]) or not sum(totals[1]):
        return [-1.0] * (size * size)
    for a in range(size):
        for b in range(size):
            random, plain = ((counts.get((k, a * size + b), 0) + 0.5) / (totals[k][a] + 0.5 * size) for k in (1, 0))
            out.append(round(math.log(random / plain), 6))
    return out


def _pairs(token: Column) -> Column:
    """The numbers of all pairs of neighbours in a token, edges included."""
    edge = len(ALPHABET)
    code = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)) - 1, F.lit(edge))
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), code)
    ends = F.array(F.lit(edge))
    return F.zip_with(F.concat(ends, codes), F.concat(codes, ends), lambda a, b: a * (edge + 1) + b)


def _listed(kind: str) -> Column:
    """The spans of a kind as structs that sort by start and then by kind."""
    place = F.lit(KINDS.index(kind))
    return F.transform(
        kind, lambda m: F.struct(m["start"], place.alias("place"), F.concat_ws(":", F.lit(kind), m["start"], m["stop"]).alias("span"))
    )


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (as `kind:start:end`, joined by commas)."""
    model = train(docs) if model is None else model
    weights = F.expr(f"array({','.join(f'{x}D' for x in model)})")
    based = _with_base(docs)
    per_character = lambda t: F.aggregate(
        _pairs(t), F.lit(0.0), lambda total, pair: total + F.get(weights, pair)
    ) / F.length(t)
    base = F.concat("assign", "access", "hex")
    runs = F.filter(
        _matches(F.coalesce("text", F.lit("")), RUN),
        lambda m: ~F.exists(base, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
        & (per_character(m["value"]) > THRESHOLD),
    )
    found = based.withColumn("random", runs).select("doc_id", F.inline_outer(F.array(F.struct(*KINDS))))
    listed = [_listed(kind) for kind in KINDS]
    joined = lambda lists: F.concat_ws(",", F.transform(F.array_sort(F.concat(*lists)), lambda x: x["span"]))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(listed[:3]).cast("binary"), 256).alias("base_sha256"),
        joined(listed).alias("spans"),
    )
