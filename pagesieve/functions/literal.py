"""Occurrences of a long list of literal phrases in batches of texts: numpy inside a task.

Each phrase is found by an anchor, that of its stretches of up to eight bytes which fewest phrases hold. The stretches that begin at
every byte of the texts are looked up in the anchors at once, and only where one stands the whole phrase is compared. Bytes are
compared, as Spark's own functions do, so the result is that of counting each phrase in each text. A bounded number of bytes is laid
out at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: So many bytes of texts are laid out at a time (a longer text alone).
CHARACTERS = 1 << 20
#: Lengths of anchors in bytes; a phrase shorter than eight bytes has the greatest that fits.
ANCHORS = (8, 5, 3, 2, 1)

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each `first` on, as many as `counts` says, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after the other, and where each begins, with the end; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)).copy()


class Phrases:
    """A list of phrases with their anchors; empty phrases and nulls occur nowhere."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        data, offsets = _bytes(texts)
        self.ids, self.sizes, self.starts = ids, np.diff(offsets), offsets[:-1]
        self.words = _words(data)
        self.anchors = []
        taken = self.sizes >= 1
        for length in ANCHORS:
            which = np.flatnonzero(taken & (self.sizes >= length))
            taken[which] = False
            if not len(which):
                continue
            counts = self.sizes[which] - length + 1
            at = ragged(np.zeros(len(which), np.int64), counts)
            number = np.repeat(np.arange(len(which)), counts)
            stretch = self.words[self.starts[which][number] + at] & _MASKS[length]
            _, same, often = np.unique(stretch, return_inverse=True, return_counts=True)
            # the rarest stretch of each phrase, the first of several
            order = np.lexsort((at, often[same], number))
            least = order[np.searchsorted(number, np.arange(len(which)))]
            order = np.argsort(stretch[least], kind="stable")
            keys, first = np.unique(stretch[least][order], return_index=True)
            bits = max(8, int(np.ceil(np.log2(len(keys)))) + 5)
            known = np.zeros(1 << bits, bool)
            known[(keys * _MIX) >> np.uint64(64 - bits)] = True
            self.anchors.append((length, keys, np.append(first, len(order)), which[order], at[least][order], known, np.uint64(64 - bits)))

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the text, id of the phrase and number of its occurrences without overlaps, for those that occur."""
        data, offsets = _bytes(texts)
        first = 0
        while first < len(texts) and self.anchors:
            after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHARACTERS, side="right")) - 1)
            begin, end = offsets[first], offsets[after]
            text, phrase, start = self._places(data[begin:end], offsets[first : after + 1] - begin)
            if len(text):
                text, phrase, n = self._counted(text, phrase, start)
                yield text + first, self.ids[phrase], n
            first = after

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, phrase and start of all occurrences, those of a phrase in order."""
        words = _words(data)
        text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        found = [(np.zeros(0, np.int64),) * 3]
        for length, keys, first, listed, at, known, shift in self.anchors:
            stretch = words[:-1] & _MASKS[length] if length < 8 else words[:-1]
            place = np.flatnonzero(known[(stretch * _MIX) >> shift])
            asked = stretch[place]
            slot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            same = keys[slot] == asked
            place, slot = place[same], slot[same]
            counts = first[slot + 1] - first[slot]
            row = ragged(first[slot], counts)
            phrase, place = listed[row], np.repeat(place, counts)
            text, start = text_of[place], place - at[row]
            fits = (start >= offsets[text]) & (start + self.sizes[phrase] <= offsets[text + 1])
            text, phrase, start = text[fits].astype(np.int64), phrase[fits], start[fits]
            alive, done = np.arange(len(text)), 0
            while len(alive):
                left = self.sizes[phrase[alive]] - done
                here, wanted = words[start[alive] + done], self.words[self.starts[phrase[alive]] + done]
                equal = ((here ^ wanted) & _MASKS[np.minimum(left, 8)]) == 0
                full = alive[equal & (left <= 8)]
                if len(full):
                    found.append((text[full], phrase[full], start[full]))
                alive, done = alive[equal & (left > 8)], done + 8
        return tuple(np.concatenate(x) for x in zip(*found))

    def _counted(self, text: np.ndarray, phrase: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = text * len(self.sizes) + phrase
        order = np.lexsort((start, pair))
        text, phrase, start, pair = text[order], phrase[order], start[order], pair[order]
        heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        counts = np.diff(np.append(heads, len(pair)))
        close = np.flatnonzero((pair[1:] == pair[:-1]) & (start[1:] - start[:-1] < self.sizes[phrase[1:]])) + 1
        # from left to right, what begins within the one before does not count
        for group in np.unique(np.searchsorted(heads, close, side="right") - 1).tolist():
            size, end, n = int(self.sizes[phrase[heads[group]]]), -1, 0
            for s in start[heads[group] : heads[group] + counts[group]].tolist():
                if s >= end:
                    end, n = s + size, n + 1
            counts[group] = n
        return text[heads], phrase[heads], counts
