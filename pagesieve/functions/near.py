"""Edit distances of a phrase to the stretches of a batch of texts, for the search with errors: numpy inside a task.

A scan with bit vectors (Myers) finds the starts from which the phrase can be reached within its limit, in many pieces of the texts at
once, and only these are measured: one row of the distance table after the other, for all of them at once. For phrases longer than a
machine word, the starts at about the place of a piece are measured. Texts are handled a bounded number of characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many characters of texts are laid out at a time (a longer text alone), and so many starts measured.
CHARACTERS, STARTS = 1 << 20, 1 << 15

#: The scan reads so many characters at a time, in lanes of this length side by side.
SCANNED, LANE = 1 << 20, 128

#: (pattern, match_case, limit of errors, pieces as (offset, piece), shortest and longest candidate, least length of a text)
Asked = tuple[str, bool, int, Sequence[tuple[int, str]], int, int, int]


def near_matches(
    text: pa.Array, lowered: pa.Array, asked: Sequence[Asked], best: int | None, characters: int = CHARACTERS,
    left_out: Sequence[np.ndarray] | None = None,
) -> pa.Array:
    """Per text and phrase the candidates within the limit, or the ``best`` ones: rank (errors, start, length) and text, in order.

    ``left_out`` says of each phrase for which texts none are wanted.
    """
    found, rows = [], len(text)
    for column, cased in ((text, True), (lowered, False)):
        phrases = [(number, phrase) for number, phrase in enumerate(asked) if phrase[1] == cased]
        for first, joined, sizes in _chunks(column, characters) if phrases else ():
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            for number, phrase in phrases:
                wanted = sizes >= phrase[6]
                if left_out is not None:
                    wanted &= ~left_out[number][first : first + len(sizes)]
                row, errors, start, length, place = _candidates(points, sizes, phrase, wanted)
                order = np.lexsort((length, start, errors, row))
                if best is not None and len(order):
                    head = np.searchsorted(row[order], row[order])
                    order = order[np.arange(len(order)) - head < best]
                words = [joined[a : a + n] for a, n in zip(place[order].tolist(), length[order].tolist())]
                found.append(((row[order] + first) * len(asked) + number, errors[order], start[order], length[order], words))
    slot = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(slot, kind="stable")
    numbers = [np.concatenate([f[i] for f in found])[order] if found else np.zeros(0, np.int64) for i in (1, 2, 3)]
    words = [w for f in found for w in f[4]]
    rank = pa.StructArray.from_arrays(
        [pa.array(numbers[0], pa.int32()), pa.array(numbers[1], pa.int64()), pa.array(numbers[2], pa.int32())], ["errors", "start", "length"]
    )
    flat = pa.StructArray.from_arrays([rank, pa.array([words[i] for i in order.tolist()], pa.string())], ["rank", "text"])
    ends = np.searchsorted(slot[order], np.arange(rows * len(asked) + 1))
    by_phrase = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(asked), pa.int32()), by_phrase)


def _chunks(column: pa.Array, characters: int) -> Iterator[tuple[int, str, np.ndarray]]:
    """(number of the first text, texts one after the other, length of each) of bounded length together; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + characters, side="right")))
        joined, sizes = _joined(column.slice(first, after - first))
        yield first, joined, sizes
        first = after


def _joined(column: pa.Array) -> tuple[str, np.ndarray]:
    """The texts one after the other, and the length of each; bytes that are no character count as one each that is none of a phrase."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    try:
        joined = str(data[int(offsets[0]) : int(offsets[-1])], "utf-8") if data is not None else ""
        return joined, pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    except UnicodeDecodeError:
        texts = [value.as_buffer().to_pybytes().decode("utf-8", "replace") for value in column]
        return "".join(texts), np.array([len(t) for t in texts], np.int64)


def _candidates(points: np.ndarray, sizes: np.ndarray, phrase: Asked, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, errors, start and length of all candidates in wanted texts, and where they begin in `points`, the texts one after the other."""
    pattern, _, limit, pieces, shortest, longest, _ = phrase
    spelled = [ord(c) for c in pattern]
    begins = np.cumsum(sizes) - sizes
    if limit < 1 or not wanted.any():
        starts = np.zeros(0, np.int64)
    elif not pieces:
        starts = np.arange(len(points))
    elif len(spelled) <= 64 or 4 * limit <= 64:
        starts = _near_starts(points, spelled, limit, longest)
    else:
        starts = _piece_starts(points, spelled, limit, pieces)
    row = np.searchsorted(begins, starts, side="right") - 1
    left = begins[row] + sizes[row] - starts if len(starts) else starts
    fits = (left >= shortest) & wanted[row] if len(starts) else np.zeros(0, bool)
    starts, row, left = starts[fits], row[fits], left[fits]
    found = [(np.zeros(0, np.int64),) * 4]
    for a in range(0, len(starts), STARTS):
        for length, errors in _distances(points, starts[a : a + STARTS], spelled, shortest, longest):
            kept = np.flatnonzero((errors <= limit) & (left[a : a + STARTS] >= length))
            found.append((a + kept, errors[kept].astype(np.int64), np.full(len(kept), length), starts[a + kept]))
    which, errors, length, place = (np.concatenate(x) for x in zip(*found))
    return row[which], errors, place - begins[row[which]] if len(which) else place, length, place


def _near_starts(points: np.ndarray, spelled: list[int], limit: int, longest: int) -> np.ndarray:
    """The starts from which some stretch of up to the longest length may be within the limit; no such start is missing.

    The texts are read backwards against the phrase backwards, so the distance at a character is the least of all stretches that
    begin there. A bit of a word says whether a cell of the table's column is one more (`up`) or one less (`down`) than the cell
    above. The phrase lies in the upper bits; those below stay `up` without effect. Of a phrase with few errors for its length the
    first letters are enough: what is within the limit of the phrase begins with something within the limit of these.
    """
    words = ((np.uint16, np.int16), (np.uint32, np.int32), (np.uint64, np.int64))
    kind, signed = next(k for k in words if max(4 * limit, 1) <= k[0]().itemsize * 8 or len(spelled) <= k[0]().itemsize * 8)
    spelled = spelled[: kind().itemsize * 8]
    size = len(spelled)
    masks = np.zeros(0x110000, kind)
    for i, c in enumerate(reversed(spelled)):
        masks[c] |= kind(1 << (kind().itemsize * 8 - size + i))
    found = []
    for a in range(0, len(points), SCANNED):
        part = masks.take(points[a : a + SCANNED + longest - 1], mode="clip")
        lanes = -(-min(SCANNED, len(points) - a) // LANE)
        padded = np.zeros(lanes * LANE + longest - 1, kind)
        padded[: len(part)] = part
        steps = np.lib.stride_tricks.sliding_window_view(padded, LANE + longest - 1)[::LANE].T.copy()
        near = np.empty((LANE, lanes), bool)
        up, down = np.full(lanes, ~kind(0)), np.zeros(lanes, kind)
        across, more, less = (np.empty(lanes, kind) for _ in range(3))
        edge, errors = np.empty(lanes, bool), np.full(lanes, size, np.int8)
        one, more_signed, less_signed = edge.view(np.int8), more.view(signed), less.view(signed)
        for t in range(len(steps) - 1, -1, -1):
            same = steps[t]
            np.bitwise_and(same, up, out=across)
            across += up
            across ^= up
            across |= same
            np.bitwise_or(across, up, out=more)
            np.invert(more, out=more)
            more |= down
            np.bitwise_and(up, across, out=less)
            np.less(more_signed, 0, out=edge)
            errors += one
            np.less(less_signed, 0, out=edge)
            errors -= one
            more += more
            less += less
            same |= down
            np.bitwise_or(same, more, out=up)
            np.invert(up, out=up)
            up |= less
            np.bitwise_and(more, same, out=down)
            if t < LANE:
                np.less_equal(errors, limit, out=near[t])
        step, lane = np.divmod(np.flatnonzero(near), lanes)
        found.append(np.sort(lane * LANE + step) + a)
    starts = np.concatenate(found) if found else np.zeros(0, np.int64)
    return starts[starts < len(points)]


def _piece_starts(points: np.ndarray, spelled: list[int], limit: int, pieces: Sequence[tuple[int, str]]) -> np.ndarray:
    """The starts with a piece of the phrase at about its place."""
    wanted = np.zeros(len(points) + 1, bool)
    for at, piece in pieces:
        here = np.zeros(len(points), bool)
        last = max(0, len(points) - len(piece) + 1)
        here[:last] = points[:last] == spelled[at]
        for i in range(1, len(piece)):
            here[:last] &= points[i : last + i] == spelled[at + i]
        place = np.flatnonzero(here)
        for back in range(max(0, at - limit), at + limit + 1):
            wanted[place[np.searchsorted(place, back) :] - back] = True
    return np.flatnonzero(wanted)


def _distances(points: np.ndarray, starts: np.ndarray, spelled: list[int], shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, edit distance of the phrase to the text of this length from each start) for all lengths of candidates."""
    size, n = len(spelled), len(starts)
    small = np.int8 if longest < 120 else np.int32
    # The distance of the first i letters, less i: with it a row needs no sums for letters left out.
    last, now = np.zeros((size + 1, n), small), np.empty((size + 1, n), small)
    for length in range(1, longest + 1):
        letter = points[np.minimum(starts + (length - 1), len(points) - 1)]  # what follows the last text is never counted
        now[0] = length
        for i, c in enumerate(spelled, 1):
            line = now[i]
            # one letter of the phrase against one of the text: an error less i, or none
            np.subtract(last[i - 1], (letter == c).view(np.int8), out=line)
            np.minimum(line, last[i] + small(1), out=line)
            np.minimum(line, now[i - 1], out=line)
        if length >= shortest:
            yield length, now[size].astype(np.int32) + size
        last, now = now, last
