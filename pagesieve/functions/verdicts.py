"""From the phrases that occur on a page to the tables that it meets: numpy inside a task.

The elements of a page are as many as its phrases have uses, so they are made, summed up by table and judged a bounded number at a time
and never leave the task. Results are those of `detect.decide`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagesieve.functions.literal import ragged

#: So many elements are held at a time (those of one page together), and so many scores of a document before they are summed up.
ELEMENTS, SCORES = 1 << 20, 1 << 22

_STRATEGIES = ("all_elements", "min_count", "min_percentage", "weighted_score")


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as doubles; null becomes NaN, which meets no limit."""
    return pc.cast(column, pa.float64()).to_numpy()


def _group_sums(values: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the groups of doubles from each head on: two doubles whose sum is that of the group, and whether it is so exactly."""
    sizes = np.diff(np.append(heads, len(values)))
    total, lost, sure = values[heads], np.zeros(len(heads)), np.ones(len(heads), bool)
    left, at = np.flatnonzero(sizes > 1), 1
    while len(left):
        x, a, c = values[heads[left] + at], total[left], lost[left]
        total[left] = s = a + x
        e = (a - (s - (s - a))) + (x - (s - a))
        lost[left] = t = c + e
        sure[left] &= (c - (t - (t - c))) + (e - (t - c)) == 0
        at += 1
        left = left[sizes[left] > at]
    return total, lost, sure


def exact_sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sum of each group of doubles from each head on, without any rounding but that of the result, as `numbers.exact_sum`."""
    total, lost, sure = _group_sums(values, heads)
    out, ends = total + lost, np.append(heads, len(values))
    for i in np.flatnonzero(~sure).tolist():
        out[i] = math.fsum(values[ends[i] : ends[i + 1]].tolist())
    return out


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


class Tables:
    """The elements of some tables, listed by phrase, and the rules of the tables.

    `rows` has a row for each element: phrase_id, max_errors, max_error_rate, weight, and the columns of its rule. Equal rules are one table.
    """

    def __init__(self, rows: pa.Table, rule: list[str]):
        rows = rows.sort_by("phrase_id").combine_chunks()
        self.ids, first = np.unique(rows["phrase_id"].to_numpy(), return_index=True)
        self.first = np.append(first, len(rows))
        self.max_errors, self.rate, self.weight = (_doubles(rows[c]) for c in ("max_errors", "max_error_rate", "weight"))
        keys = rows.select(rule).to_pandas()
        self.table = keys.groupby(rule, dropna=False, sort=False).ngroup().to_numpy()
        _, one = np.unique(self.table, return_index=True)
        #: a row for each table, in the order of their numbers
        self.rules = rows.select(rule).take(pa.array(one))
        names = keys["table_name"].iloc[one]
        self.name = names.groupby(names.to_numpy(), dropna=False, sort=False).ngroup().to_numpy()
        _, one = np.unique(self.name, return_index=True)
        self.names = self.rules["table_name"].take(pa.array(one)).combine_chunks()
        numbers = ("min_elements", "min_percentage", "min_score", "total_elements", "total_weight")
        self.min_elements, self.min_percentage, self.min_score, self.total, self.total_weight = (_doubles(self.rules[c]) for c in numbers)
        kinds = {s: i for i, s in enumerate(_STRATEGIES)}
        self.strategy = np.array([kinds.get(s, -1) for s in self.rules["match_strategy"].to_pylist()], np.int8)

    def judged(self, hits: pa.ListArray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Of the pages, given by their hits, and the tables that they meet with a score of `least` or more: number of the page and of the
        table, number of elements found, and score. Pages come in order."""
        if not len(self.ids):
            return
        offsets = hits.offsets.to_numpy().astype(np.int64)
        phrase, n, error = (hits.values.field(i).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for i in range(3))
        page = np.repeat(np.arange(len(hits)), np.diff(offsets))
        slot = np.minimum(np.searchsorted(self.ids, phrase), len(self.ids) - 1)
        known = np.flatnonzero(self.ids[slot] == phrase)
        page, n, error, slot = page[known], n[known], error[known], slot[known]
        counts = self.first[slot + 1] - self.first[slot]
        heads = _heads(page)
        ends = np.append(heads[1:], len(page)) if len(heads) else heads
        sums = np.append(0, np.cumsum(counts))
        at = 0
        while at < len(heads):
            a = heads[at]
            at = max(at + 1, int(np.searchsorted(sums[ends], sums[a] + ELEMENTS, side="right")))
            here = slice(a, ends[at - 1])
            yield self._verdicts(page[here], n[here], error[here], self.first[slot[here]], counts[here], least)

    def _verdicts(self, page, n, error, first, counts, least) -> tuple[np.ndarray, ...]:
        element = ragged(first, counts)
        n, error, table = np.repeat(n, counts), np.repeat(error, counts), self.table[element]
        ok = (n <= self.max_errors[element] + 1) & (error <= self.rate[element])
        group = np.repeat(page - page[0], counts) * len(self.strategy) + table
        order = np.argsort(group, kind="stable")
        heads = _heads(group[order])
        found_count = np.add.reduceat(ok[order].astype(np.int32), heads)
        place, table = np.divmod(group[order][heads], len(self.strategy))
        strategy, share = self.strategy[table], found_count / self.total[table]
        weighted = np.zeros(len(heads))
        by_weight = (strategy < 0) | (strategy == 3)
        if by_weight.any():
            sizes = np.diff(np.append(heads, len(order)))
            mine = order[np.repeat(by_weight, sizes)]
            starts = np.cumsum(sizes[by_weight]) - sizes[by_weight]
            whole = self.total_weight[table[by_weight]]
            with np.errstate(divide="ignore", invalid="ignore"):
                sums = exact_sums((1 - error[mine]) * self.weight[element[mine]], starts) / whole
            weighted[by_weight] = np.where(whole > 0, sums, 0.0)
        met = np.select(
            [strategy == 0, strategy == 1, strategy == 2],
            [found_count == self.total[table], found_count >= self.min_elements[table], share >= self.min_percentage[table]],
            weighted >= self.min_score[table],
        )
        score = np.where(strategy == 3, weighted, share)
        kept = np.flatnonzero(met & (score >= least))
        return place[kept] + page[0], table[kept], found_count[kept], score[kept]


def documents(tables: Tables, batches: Iterator[pa.RecordBatch], least: float) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of batches of pages (document, hits) in the order of their documents: per document and table name the document, the number of the
    name, the number of pages that meet a table of that name, and their mean score."""
    doc, held = None, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    for batch in batches:
        ids, hits = batch.column(0), batch.column(1)
        run = np.cumsum(np.append(True, _differ(ids.slice(1), ids.slice(0, len(ids) - 1)))) - 1 if len(ids) else np.zeros(0, np.int64)
        for page, table, _, score in tables.judged(hits, least):
            if not len(page):
                continue
            at, name = run[page], tables.name[table]
            one = np.ones(len(page), np.int64)
            if doc is not None and not _differ(doc, ids.slice(page[0], 1))[0]:
                mine = int(np.searchsorted(at, at[0], side="right"))
                held = tuple(np.append(h, x[:mine]) for h, x in zip(held, (name, score, one)))
                page, at, name, score, one = (x[mine:] for x in (page, at, name, score, one))
            if len(page):
                if len(held[0]):
                    name_of, n, mean = _means(*held)
                    yield doc.take(pa.array(np.zeros(len(n), np.int64))), name_of, n, mean
                last = int(np.searchsorted(at, at[-1], side="left"))
                if last:
                    row, name_of, n, mean = _means_by(at[:last], name[:last], score[:last], one[:last], len(tables.names))
                    yield ids.take(pa.array(page[:last][np.searchsorted(at[:last], row)])), name_of, n, mean
                doc, held = ids.slice(page[-1], 1), (name[last:], score[last:], one[last:])
            if len(held[0]) > SCORES:
                held = _summed(*held)
    if len(held[0]):
        name_of, n, mean = _means(*held)
        yield doc.take(pa.array(np.zeros(len(n), np.int64))), name_of, n, mean


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether two values are different, null being a value."""
    other = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | other.to_numpy(zero_copy_only=False)


def _summed(name: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same sums by name in fewer values, those that two doubles hold exactly."""
    order = np.argsort(name, kind="stable")
    name, value, n = name[order], value[order], n[order]
    heads = _heads(name)
    total, lost, sure = _group_sums(value, heads)
    rest = np.repeat(~sure, np.diff(np.append(heads, len(name))))
    counts = np.add.reduceat(n, heads)[sure]
    names = name[heads][sure]
    return (
        np.concatenate([names, names, name[rest]]), np.concatenate([total[sure], lost[sure], value[rest]]),
        np.concatenate([counts, np.zeros(len(counts), np.int64), n[rest]]),
    )


def _means(name: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(name, kind="stable")
    name, value = name[order], value[order]
    heads = _heads(name)
    counts = np.add.reduceat(n[order], heads)
    return name[heads], counts, exact_sums(value, heads) / counts


def _means_by(row: np.ndarray, name: np.ndarray, value: np.ndarray, n: np.ndarray, names: int) -> tuple[np.ndarray, ...]:
    pair, counts, mean = _means(row * names + name, value, n)
    return (*np.divmod(pair, names), counts, mean)
