"""Byte-level BPE: texts to token ids and back, as the tiktoken library would, without special tokens.

Texts are cut into matches by `pretokens`; the byte slices of the matches are encoded by merging the
pair of lowest rank again and again, through a bounded cache of slices seen before. The end of each token
in the bytes of the text is kept beside the ids, so a part of a text can be found and decoded.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; ids and ends are
binary columns of little-endian unsigned 32-bit numbers. All other columns stay; an input column
with the name of an added one (whatever its case) is replaced. A null in `ids` decodes to no bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagesieve.llm import pretokens
from pagesieve.llm.shingles import BYTE, slice_hashes, text_chunks
from pagesieve.llm.tables import map_arrow

#: Slices kept by a task at a time; when they are more, the cache starts anew.
CACHE_SLICES = 400_000
#: Bytes of text in work at a time, and so the size of the arrays; a longer text is worked on alone.
CHUNK_BYTES = 1 << 18


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Encodes slices of bytes. Equal slices are merged once; lately seen ones are kept in a bounded cache.

    A slice is told from others by a hash, and checked by its length and first eight bytes.
    The cache is a sorted array of hashes with places in one array of ids; all tokens are in it from the start.
    """

    #: Longer slices are merged one by one with a heap, as each round merges one pair of a slice.
    LONG = 48
    #: Slices that go through the rounds side by side.
    SIDE_BY_SIDE = 20_000

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_SLICES) -> None:
        self.ranks, self.limit, self.far = ranks, limit, max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # The rank of a pair of tokens is the rank of their bytes together; a pair is one number.
        pairs = sorted(
            (ranks[piece[:i]] * self.far + ranks[piece[i:]], rank)
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        )
        self.keys, self.values = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.seed = 0
        self.restart()

    def restart(self) -> None:
        """Forget all slices but the tokens themselves."""
        data = np.frombuffer(b"".join(self.ranks), dtype=np.uint8)
        ends = np.cumsum([len(piece) for piece in self.ranks])
        starts = np.append(0, ends[:-1])
        self.held, self.heads, self.places, self.counts = (np.zeros(0, dtype=k) for k in ("u8", "u8", "i8", "i8"))
        self.flat = np.zeros(0, dtype=np.uint32)
        ids = np.fromiter(self.ranks.values(), dtype=np.uint32, count=len(self.ranks))
        self.keep(*self.hashes(data, starts, ends), np.ones(len(ids), dtype=np.int64), ids)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each slice a hash, and its first eight bytes mixed with its length."""
        values = BYTE[data] + np.uint64(self.seed)
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))[starts]
        size = np.minimum(ends - starts, 8).astype(np.uint64) * np.uint64(8)
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
        head = (eight & masks[(size >> np.uint64(3)).astype(np.int64)]) ^ ((ends - starts).astype(np.uint64) << np.uint64(56))
        return slice_hashes(values, starts, ends), head

    def keep(self, held: np.ndarray, heads: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        places = len(self.flat) + np.cumsum(counts) - counts
        all_held = np.concatenate([self.held, held])
        order = np.argsort(all_held)
        self.held = all_held[order]
        self.heads = np.concatenate([self.heads, heads])[order]
        self.places = np.concatenate([self.places, places])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each slice, and all ids."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        hashes, heads = self.hashes(data, starts, ends)
        kinds, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.held, kinds), len(self.held) - 1)
        known = self.held[at] == kinds
        if (heads != heads[first][kind]).any() or (self.heads[at[known]] != heads[first[known]]).any():
            self.seed += 2  # two slices share a hash: take other hashes
            self.restart()
            return self.encode(data, starts, ends)
        fresh = first[~known]
        if len(fresh):
            if len(self.held) + len(fresh) > max(self.limit, len(self.ranks) + len(fresh)):
                self.restart()
                return self.encode(data, starts, ends)
            self.keep(hashes[fresh], heads[fresh], *self.merge_all(data, starts[fresh], ends[fresh]))
            at = np.searchsorted(self.held, kinds)
        places, counts = self.places[at][kind], self.counts[at][kind]
        upto = np.cumsum(counts)
        return counts, self.flat[np.repeat(places - (upto - counts), counts) + np.arange(upto[-1])]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.far + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], self.far)

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each slice, and all ids, slices in the order given."""
        sizes = ends - starts
        counts = np.zeros(len(starts), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # slices, and their ids in rows filled up with -1
        order = np.argsort(sizes, kind="stable")
        short = order[sizes[order] <= self.LONG]
        for i in range(0, len(short), self.SIDE_BY_SIDE):
            some = short[i : i + self.SIDE_BY_SIDE]
            found += self._merge_rounds(data, starts[some], sizes[some], some)
        for k in order[len(short) :].tolist():
            ids = self.merge_long(data[starts[k] : ends[k]].tobytes())
            found.append((np.array([k]), np.array([ids], dtype=np.int64)))
        for some, ids in found:
            counts[some] = (ids >= 0).sum(axis=1)
        places = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.uint32)
        for some, ids in found:
            used = ids >= 0
            flat[(places[some][:, None] + np.arange(ids.shape[1]))[used]] = ids[used]
        return counts, flat

    def _merge_rounds(
        self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        # One row for each slice: its tokens, and the ranks of the pairs they begin.
        out, width = [], int(sizes.max())
        places = np.arange(width)
        inside = places < sizes[:, None]
        parts = np.where(inside, self.single[data[np.minimum(starts[:, None] + places, len(data) - 1)]], -1)
        pairs = np.full(parts.shape, self.far, dtype=np.int64)
        pairs[:, :-1] = np.where(inside[:, 1:], self.rank_of(parts[:, :-1], parts[:, 1:]), self.far)
        while len(rows):
            at = pairs.argmin(axis=1)
            least = pairs[np.arange(len(rows)), at]
            done = least == self.far
            if done.any():
                out.append((rows[done], parts[done]))
                rows, parts, pairs, at, least = (x[~done] for x in (rows, parts, pairs, at, least))
            lines = np.arange(len(rows))
            # Put the merged token in its place, and move what is behind it one place to the left.
            behind = places[None, :-1] > at[:, None]
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            pairs[:, :-1] = np.where(behind, pairs[:, 1:], pairs[:, :-1])
            parts[:, -1], pairs[:, -1] = -1, self.far
            parts[lines, at] = least
            right = parts[lines, np.minimum(at + 1, len(places) - 1)]
            pairs[lines, at] = np.where(right >= 0, self.rank_of(least, right), self.far)
            some = np.flatnonzero(at > 0)
            pairs[some, at[some] - 1] = self.rank_of(parts[some, at[some] - 1], least[some])
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, in order of rank and then of place."""
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end of the part that begins at i; 0 when it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if i and (r := get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)


def encode_chunk(data: np.ndarray, offsets: np.ndarray, merger: Merger) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk, and the number of ids of each text."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = place[pretokens.match_starts(points, np.searchsorted(place, filled))]
    counts, ids = merger.encode(data, starts, np.append(starts[1:], len(data)))
    upto = np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]
    return ids, np.diff(upto)


def _chunked(column: pa.Array, merger: Merger) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, ids of all its texts together, ids by text, and bytes by text of each chunk."""
    for row, data, offsets in text_chunks(column, CHUNK_BYTES):
        yield row, *encode_chunk(data, offsets, merger), np.diff(offsets)


ADDED = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())]


def _rest(df: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of `df` but those of these names, whatever their case."""
    gone = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in gone]


def _encoded(batch: pa.RecordBatch, held: list[str], rank_path: str, column: str) -> Iterator[pa.RecordBatch]:
    merger, widths = _merger(rank_path), _widths(rank_path)
    for row, ids, counts, sizes in _chunked(batch.column(column), merger):
        ends = np.cumsum(widths[ids])
        ends = (ends - np.repeat(np.cumsum(sizes) - sizes, counts)).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        part = batch.slice(row, len(counts)).select(held)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(counts), _slices(ids, bounds), _slices(ends, bounds)], names=[*held, "n_tokens", "ids", "ends"]
        )


def _decoded(batch: pa.RecordBatch, held: list[str], rank_path: str, column: str, into: str) -> pa.RecordBatch:
    joined, widths = _joined(rank_path), _widths(rank_path)
    places = np.cumsum(widths) - widths
    texts = []
    for one in batch.column(column):
        ids = np.frombuffer(one.as_buffer(), dtype="<u4") if one.is_valid else np.zeros(0, dtype=np.uint32)
        sizes = widths[ids]
        upto = np.cumsum(sizes)
        n = int(upto[-1]) if len(upto) else 0
        texts.append(joined[np.repeat(places[ids] - (upto - sizes), sizes) + np.arange(n)].tobytes())
    return pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.array(texts, pa.binary())], names=[*held, into])


def encode(docs: DataFrame, rank_path: str, column: str = "text") -> DataFrame:
    """The rows of `docs` with n_tokens, ids and ends (byte offset behind each token)."""
    rest = _rest(docs, "n_tokens", "ids", "ends")
    held = [f.name for f in rest]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _encoded(batch, held, rank_path, column)

    return map_arrow(docs, work, T.StructType(rest + ADDED))


def decode(df: DataFrame, rank_path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows of `df` with the bytes that the ids stand for."""
    rest = _rest(df, into)
    held = [f.name for f in rest]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, held, rank_path, column, into)

    return map_arrow(df, work, T.StructType([*rest, T.StructField(into, T.BinaryType())]))


def round_trip(docs: DataFrame, rank_path: str, column: str = "text", into: str = "decoded") -> DataFrame:
    """Encoded and decoded again in one pass: what `encode` gives, without `ends`, and the bytes in `into`."""
    rest = _rest(docs, "n_tokens", "ids", "ends", into)
    held = [f.name for f in rest]
    kept = [*held, "n_tokens", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _encoded(batch, held, rank_path, column):
                yield _decoded(part, kept, rank_path, "ids", into)

    return map_arrow(docs, work, T.StructType([*rest, *ADDED[:2], T.StructField(into, T.BinaryType())]))


def count_tokens(docs: DataFrame, rank_path: str, column: str = "text", into: str = "n_tokens") -> DataFrame:
    """The rows of `docs`, without the text, with the number of their tokens."""
    held = [f.name for f in docs.schema.fields if f.name.lower() not in {into.lower(), column.lower()}]
    schema = T.StructType([*(docs.schema[c] for c in held), T.StructField(into, T.LongType())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [counts for _, _, counts, _ in _chunked(batch.column(column), _merger(rank_path))]
        counts = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.array(counts)], names=[*held, into])

    return map_arrow(docs, lambda batches: chain.from_iterable(map(work, batches)), schema)


def _slices(values: np.ndarray, bounds: list[int]) -> pa.Array:
    raw = values.astype("<u4").tobytes()
    return pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary())


@functools.cache
def _merger(path: str) -> Merger:
    return Merger(read_ranks(path))


@functools.cache
def _bytes_of(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


@functools.cache
def _joined(path: str) -> np.ndarray:
    return np.frombuffer(b"".join(_bytes_of(path)), dtype=np.uint8)


@functools.cache
def _widths(path: str) -> np.ndarray:
    return np.array([len(p) for p in _bytes_of(path)], dtype=np.int64)
