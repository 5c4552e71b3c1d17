"""Sets of hashed word shingles, built in numpy from the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are hashed in one go; bounds the size of the temporary arrays.
CHUNK_BYTES = 1 << 19
#: Rows of a column that are copied in one go.
ROWS = 512

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# One random number for each byte, and for each lower-cased one.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE = BYTE[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept for the longest chunk so far."""

    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def text_chunks(
    column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES, most_rows: int = 1 << 30, rows: int = ROWS
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of at most `most_rows` rows and about `chunk_bytes`; a longer text is a run of its own.

    Yields the first row, the bytes of the run, and the offsets of its texts; a null has no bytes.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    # The copies below are of some rows at a time, not of the whole batch.
    for first in range(0, len(column), rows):
        part = column.slice(first, rows).cast(pa.large_string()).fill_null("")
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        row = 0
        while row < len(part):
            last = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
            last = min(max(last, row + 1), row + most_rows, len(part))
            yield first + row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, byte: np.ndarray = _BYTE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their starts and ends, and the number of words of each text.

    `byte` has a random number for each byte; by default the same one for a letter of A-Z and its lower case.
    """
    n = len(data)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:] = _SPACE[data] if n else edge[1:]  # edge[i]: the byte before i is no part of a word
    inner = ~edge[1:]
    edge[offsets] = True
    starts = np.flatnonzero(inner & edge[:-1])
    # A word ends where the next byte is a space or belongs to the next text.
    after = np.ones(n, dtype=bool)
    if n:
        after[:-1] = ~inner[1:]
    ends_of_text = offsets[1:] - 1
    after[ends_of_text[ends_of_text >= 0]] = True
    ends = np.flatnonzero(inner & after) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return word_hashes(data, starts, ends, byte), starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of ascending slices of `data`, taken in runs of about `CHUNK_BYTES`, however long the text or a word is."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        last = int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right"))
        if last > at:
            first = starts[at]
            values = byte[data[first : ends[last - 1]]]
            out[at:last] = slice_hashes(values, starts[at:last] - first, ends[at:last] - first)
        else:
            last = at + 1
            out[at] = _long_hash(data[starts[at] : ends[at]], byte)
        at = last
    return out


def _long_hash(word: np.ndarray, byte: np.ndarray) -> np.uint64:
    """The hash of one slice longer than a run, piece by piece; equal to that of `slice_hashes`."""
    up, _ = _Powers.upto(CHUNK_BYTES)
    total, shift, step = np.zeros(1, dtype=np.uint64), 1, pow(_BASE, CHUNK_BYTES, 1 << 64)
    for at in range(0, len(word), CHUNK_BYTES):
        piece = byte[word[at : at + CHUNK_BYTES]]
        total += (piece * up[: len(piece)]).sum(dtype=np.uint64, keepdims=True) * np.uint64(shift)
        shift = shift * step & _MASK
    return mix(total + np.uint64(len(word)))[0]


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice of `values`, which has a random number for each byte."""
    up, down = _Powers.upto(len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[np.minimum(starts, len(down) - 1)] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of `width` words of each text, ascending, and their number by text.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    words, _, _, counts = word_spans(data, offsets)
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(counts)), counts)
    mixed = words.copy()
    whole = len(words) - width + 1
    if whole > 0:
        for k in range(1, width):
            mixed[:whole] = mix(mixed[:whole] * np.uint64(_BASE) + words[k : k + whole])
    starts = np.arange(len(words)) - first[rows]
    keep = starts <= counts[rows] - width
    short = np.flatnonzero((counts > 0) & (counts < width))
    for row in short:
        value = words[first[row] : first[row] + 1].copy()
        for k in range(1, counts[row]):
            value = mix(value * np.uint64(_BASE) + words[first[row] + k])
        mixed[first[row]] = value[0] ^ np.uint64(counts[row])
        keep[first[row]] = True
    mixed, rows = mixed[keep], rows[keep]
    sizes = np.bincount(rows, minlength=len(counts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    fresh = np.ones(len(mixed), dtype=bool)
    for row in np.flatnonzero(sizes > 1):
        part = mixed[bounds[row] : bounds[row + 1]]
        part.sort()
        np.not_equal(part[1:], part[:-1], out=fresh[bounds[row] + 1 : bounds[row + 1]])
    return mixed[fresh], np.bincount(rows[fresh], minlength=len(counts))
