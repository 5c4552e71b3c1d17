"""Periodic runs: stretches of words that repeat with a short period, found scale by scale and stitched from tiles.

A run is a longest stretch of consecutive words whose smallest period is q and that holds at least `REPEATS` periods and
`SHORTEST` words. Periods are taken by octaves [s, 2s). For each octave a document is cut into overlapping tiles about
boundaries that stand 2s words apart; a run of four periods has a boundary with two whole periods behind it. A tile is solved by itself:

1. The square at the boundary: periods q of the octave at which the words repeat twice, told by names of windows of s words (names
   of one octave are made of pairs of the one before), and not with a divisor of q as period as well.
2. For these q the two Z-functions of the boundary, taken word by word within the tile: how far the words behind it repeat q words
   on, and how far those before it do. Together they give a fragment of a stretch with period q.

Fragments of neighbouring tiles overlap. They are shuffled by document and period and stitched: those whose repeated words touch are one
stretch. Only documents with a fragment move, in a narrow row beside their text; all others are done where they are read.

Word hashes are 64 bits, names too; what names find is checked by the Z-functions, which compare the words themselves.

`rewrite` may change documents before the search, see `tail_rewrite`.

Defined cases: a null, an empty and a white text has no words and no run; a document is a row, so rows that repeat an
id, and rows with a null id, are each judged by themselves; memory is a few dozen bytes for each word of the text in work; runs may overlap, and a word is
dropped if any run holds it after that run's first period; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.llm.shingles import BYTE, mix, text_chunks, word_spans
from pagesieve.llm.tables import cut, map_arrow

SHORTEST, REPEATS = 6, 4
#: Pairs that are compared, and words that are joined, in one go.
PAIRS, JOINED = 1 << 18, 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)


def tail_rewrite(h: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, the hash `h` of an id rewrites a text of `n` words; None if not."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def fragments(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, period, start and end of the fragments that the tiles of all octaves give; `words` of all texts, one after the other."""
    found = [(np.zeros(0, dtype=np.int64),) * 4]
    owner = np.arange(len(counts))
    low = np.cumsum(counts) - counts
    names, size = mix(words), 1
    while len(counts):
        some = counts >= max(SHORTEST, REPEATS * size)
        if 2 * counts[some].sum() < len(words):  # go on with the longer texts alone
            keep = np.repeat(some, counts)
            words, names, owner, counts = words[keep], names[keep], owner[some], counts[some]
            low, some = np.cumsum(counts) - counts, np.ones(len(counts), dtype=bool)
        if not some.any():
            break
        for text, q, start, end in _octave(words, names, low[some], counts[some], size):
            found.append((owner[some][text], q, start, end))
        pairs = names[: len(names) - size] * _BASE + names[size:]
        names = np.append(mix(pairs), names[len(names) - size :])
        size *= 2
    return tuple(np.concatenate(column) for column in zip(*found))


def _octave(
    words: np.ndarray, names: np.ndarray, low: np.ndarray, counts: np.ndarray, size: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Fragments with periods from `size` to 2 * `size` - 1 of texts of at least four times that size."""
    step, periods = 2 * size, np.arange(size, 2 * size)
    tiles = (counts - step) // step + 1
    text = np.repeat(np.arange(len(counts)), tiles)
    number = np.arange(len(text)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    at, high = low[text] + number * step, (low + counts)[text]
    some = max(1, PAIRS // size)
    for first in range(0, len(at), some):
        part = slice(first, first + some)
        b, h = at[part, None], high[part, None]
        fits = b + 2 * periods <= h
        row, col = np.nonzero(fits & (names[b] == names[np.minimum(b + periods, len(names) - 1)]))
        row += first
        b, q, t = at[row], periods[col], text[row]
        keep = names[b + q - size] == names[b + 2 * q - size]
        keep[keep] = _primitive(names, b[keep], q[keep], size)
        b, q, t = b[keep], q[keep], t[keep]
        if not len(b):
            continue
        ahead = _reach(words, b, q, low[t] + counts[t], 1, 2 * step)
        back = _reach(words, b - 1, q, low[t], -1, 2 * step)
        # What lies whole within the tile and is too short is part of no run.
        cut_off = (ahead == 2 * step) | (back == 2 * step)
        sure = (ahead >= q) & (cut_off | (q + ahead + back >= np.maximum(SHORTEST, REPEATS * q)))
        b, q, t, ahead, back = (x[sure] for x in (b, q, t, ahead, back))
        yield t, q, b - back - low[t], b + q + ahead - low[t]


def _primitive(names: np.ndarray, b: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Whether the first of two equal stretches of q words at b is no repetition of a shorter one."""
    alive = np.arange(len(b))
    whole = np.ones(len(b), dtype=bool)
    for t in range(1, int(np.sqrt(2 * size)) + 2):
        for large in (False, True):
            x, y = b[alive], q[alive]
            m = y // t if large else np.full(len(y), t)
            ok = (y % t == 0) & (m < y) & (m > 0)
            x, y, m, who = x[ok], y[ok], m[ok], alive[ok]
            last = np.maximum(y - m - size, 0)
            same = (names[x] == names[x + m]) & (names[x + last] == names[x + last + m])
            whole[who[same]] = False
            alive = alive[whole[alive]]
            if not len(alive):
                return whole
    return whole


def _reach(words: np.ndarray, b: np.ndarray, q: np.ndarray, edge: np.ndarray, way: int, most: int) -> np.ndarray:
    """How many words from b on, in the direction `way`, equal those q words later, up to `most` and the text's `edge`."""
    reach = np.zeros(len(b), dtype=np.int64)
    alive, done, width = np.arange(len(b)), 0, 16
    while len(alive) and done < most:
        width = min(width, most - done)
        for first in range(0, len(alive), max(1, PAIRS // width)):
            who = alive[first : first + max(1, PAIRS // width)]
            one = b[who, None] + way * (done + np.arange(width))
            two = one + q[who, None]
            inside = (two < edge[who, None]) if way > 0 else (one >= edge[who, None])
            same = inside & (words[np.where(inside, one, 0)] == words[np.where(inside, two, 0)])
            reach[who] += np.where(same.all(axis=1), width, same.argmin(axis=1))
        done += width
        alive = alive[reach[alive] == done]
        width *= 4
    return reach


def _texts(batch: pa.RecordBatch, rewrite: bool) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None], np.ndarray]]:
    """By chunk: first row, bytes of its texts, word hashes as rewritten, counts, spans, and for rewritten texts the word numbers in order."""
    hashes = batch.column("h").to_pylist()
    for first, data, offsets in text_chunks(batch.column("text")):
        words, starts, ends, counts = word_spans(data, offsets, BYTE)
        low = np.cumsum(counts) - counts
        order: list[np.ndarray | None] = [None] * len(counts)
        source = words
        for i, n in enumerate(counts.tolist()):
            if rewrite and (at := tail_rewrite(hashes[first + i], n)):
                if source is words:
                    words = words.copy()
                a, p = at
                order[i] = np.append(np.arange(a), a + np.arange(n - a) % p)
                words[low[i] : low[i] + n] = source[low[i] + order[i]]
        texts = [data[offsets[i] : offsets[i + 1]] for i in range(len(counts))]
        spans = np.stack([starts, ends], axis=1)
        for i in range(len(counts)):
            spans[low[i] : low[i] + counts[i]] -= offsets[i]
        yield first, texts, words, counts, spans, order, low


def _joined(text: np.ndarray, spans: np.ndarray, chosen: np.ndarray | None) -> str:
    """SHA-256 of the chosen words (all without a choice), joined by one space, a block of words at a time."""
    digest = hashlib.sha256()
    raw = text.tobytes()
    size = len(spans) if chosen is None else len(chosen)
    for at in range(0, size, JOINED):
        block = spans[at : at + JOINED] if chosen is None else spans[chosen[at : at + JOINED]]
        if chosen is None:
            piece = b" ".join(raw[block[0, 0] : block[-1, 1]].split())
        else:
            piece = b" ".join([raw[a:b] for a, b in block.tolist()])
        digest.update(b" " + piece if at else piece)
    return digest.hexdigest()


def _solve(rewrite: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, texts, words, counts, spans, order, low in _texts(batch, rewrite):
                owner, q, start, end = fragments(words, counts)
                place = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[place], np.arange(len(counts) + 1))
                rows = pa.StructArray.from_arrays([pa.array(c[place]) for c in (q, start, end)], names=["period", "start", "end"])
                part = batch.slice(first, len(counts))
                some = np.diff(bounds) > 0
                plain = [
                    None if some[i] else _joined(texts[i], spans[low[i] : low[i] + counts[i]], order[i])
                    for i in range(len(counts))
                ]
                kept = [t if ok else None for t, ok in zip(part.column("text").to_pylist(), some)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("h"), pa.array(kept, pa.string()), pa.array(plain, pa.string()),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows).cast(kind),
                    ],
                    names=["doc_id", "h", "text", "plain", "fragments"],
                )

    return work


def _collapse(rewrite: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, out = batch.column("runs"), []
            for first, texts, _, counts, spans, order, low in _texts(batch, rewrite):
                for i, n in enumerate(counts.tolist()):
                    edges = np.zeros(n + 1, dtype=np.int64)
                    for r in runs[first + i].as_py() or []:
                        edges[r["start"] + r["period"]] += 1
                        edges[r["start"] + r["length"]] -= 1
                    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                    chosen = kept if order[i] is None else order[i][kept]
                    out.append(_joined(texts[i], spans[low[i] : low[i] + n], chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), runs, pa.array(out, pa.string())],
                names=["row", "doc_id", "runs", "collapsed_sha256"],
            )

    return work


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def stitch(pieces: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """row, period, start and length of the runs that the fragments (row, period, start, end) are parts of.

    A fragment repeats the words from its start to a period before its end; fragments are one stretch where these touch.
    """
    upto = F.col("end") - F.col("period")
    before = Window.partitionBy("row", "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    sums = Window.partitionBy("row", "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = (F.col("start") > F.coalesce(F.max(upto).over(before), F.lit(-1))).cast("long")
    islands = pieces.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(sums))
    whole = islands.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    enough = (length >= shortest) & (length >= repeats * F.col("period"))
    return whole.filter(enough).select("row", "period", "start", length.alias("length"))


def find_runs(docs: DataFrame, h: Column | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, runs (start, length, period; in this order) and collapsed_sha256.

    `h` is a number by which texts are rewritten first; without it they are taken as they are.
    """
    rewrite = h is not None
    narrow = docs.select("doc_id", (h if rewrite else F.lit(None)).cast("long").alias("h"), "text")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    solved = map_arrow(
        narrow, _solve(rewrite),
        f"doc_id {id_type}, h long, text string, plain string, fragments array<struct<period: bigint, start: bigint, end: bigint>>",
    )
    # The rows are written, so their numbers stay.
    solved = cut(solved.withColumn("row", F.monotonically_increasing_id()))
    done = solved.filter("text is null").select("doc_id", F.array().cast(RUNS).alias("runs"), F.col("plain").alias("collapsed_sha256"))
    open_ = solved.filter("text is not null")
    runs = stitch(open_.select("row", F.inline("fragments")))
    # No more runs than words: the list of a document is no longer than its text.
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    asked = open_.select("row", "doc_id", "h", "text").join(listed, "row", "left")
    collapsed = map_arrow(asked, _collapse(rewrite), f"row long, doc_id {id_type}, runs {RUNS}, collapsed_sha256 string")
    collapsed = collapsed.select("doc_id", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "collapsed_sha256")
    return done.unionByName(collapsed)


def digests(found: DataFrame) -> DataFrame:
    """Rows of `find_runs` as doc_id, n_runs, start, length, period and exponent_milli of the longest run, and the two digests."""
    by_length = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform("runs", by_length))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.call_function("div", -1000 * F.col("best.l"), F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
