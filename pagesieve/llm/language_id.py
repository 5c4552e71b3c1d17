"""Language identification by the nearest centroid of TF-IDF vectors of character n-grams.

A text becomes counts of its letter 1- to 3-grams in hashed buckets (lower case, everything but letters is a
gap), weighted by inverse document frequency and normalised. Each language has several centroids, found by spherical
k-means on its training vectors; the prediction is the language of the centroid with the greatest cosine. A text
farther from all centroids than `SLACK` times what nearly all training texts keep to is rejected.

The model is fitted on a bounded sample: about `SAMPLE` labelled rows of each language, whole texts, chosen by a
hash of the id. Predictions read whole texts, in chunks that bound memory.

Defined cases: a null text and a text without a letter are `und` with score 0, and rejected; without any labelled
row all texts are `und` with score 0 and nothing else is rejected; of equally near languages the first in order wins; input
columns named like added ones, whatever their case, are replaced.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagesieve.llm import pretokens
from pagesieve.llm.shingles import text_chunks
from pagesieve.llm.tables import map_arrow

BUCKETS = 4096
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 12
#: Cosines below this part of the least but 1 % of the training texts' are rejected.
SLACK = 0.5
#: Texts of fewer n-grams are held to a lower cosine.
ENOUGH = 300
#: Bytes and texts in work at a time: a text takes a row of counts, however short it is.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 256
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one normalised row each
    idf: np.ndarray
    floor: float  # cosines below are rejected


@functools.cache
def _folded() -> np.ndarray:
    """The lower case of each letter as a code point; 0 for all that is no letter."""
    letters = np.flatnonzero(pretokens.classes() == 1)
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    out[letters] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in letters.tolist()]
    return out


def ngram_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and counts (texts x buckets) of chunks of texts."""
    for row, data, offsets in text_chunks(column, CHUNK_BYTES, CHUNK_ROWS):
        texts = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        place = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        letters = _folded()[points]
        owner = np.repeat(np.arange(texts, dtype=np.int64), np.diff(place))
        # Runs of gaps count once.
        keep = letters > 0
        keep[1:] |= letters[:-1] > 0
        letters, owner = letters[keep], owner[keep]
        counts = np.zeros(texts * BUCKETS, dtype=np.int64)
        grams = np.zeros(len(letters), dtype=np.uint32)
        for n in range(1, 4):
            width = len(letters) - n + 1
            if width <= 0:
                break
            grams = grams[:width] * np.uint32(0x9E3779B1) + letters[n - 1 :] + np.uint32(n)
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            whole = (owner[:width] == owner[n - 1 :]) & (letters[n - 1 :] > 0)
            place_of = owner[:width][whole] * BUCKETS + (mixed[whole] >> np.uint32(20))
            counts += np.bincount(place_of, minlength=len(counts))
        yield row, counts.reshape(texts, BUCKETS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from starts that are far from each other; fewer rows give fewer centroids."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = _unit(sums)
    return centres


def fit_vectors(counts: np.ndarray, languages: list[str]) -> Model:
    """The model of training counts, one row and one language each."""
    if not len(counts):
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32), np.ones(BUCKETS, dtype=np.float32), 0.0)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(counts.astype(np.float32) * idf)
    names, centres = [], []
    labels = np.array(languages)
    for name in sorted(set(languages)):
        found = cluster(x[labels == name], CENTROIDS)
        names += [name] * len(found)
        centres.append(found)
    centres = np.concatenate(centres)
    nearest = (x @ centres.T).max(axis=1)
    return Model(names, centres, idf, float(np.quantile(nearest, 0.01)) * SLACK)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of rows with columns doc_id, text and lang, from about `sample` rows of each language."""
    known = labelled.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(9)), 11) / float(1 << 53)
    wanted = F.lit(False)
    for name, n in sorted(sizes.items()):
        wanted = wanted | ((F.col("lang") == name) & (place < min(1.0, sample / n)))
    chosen = known.filter(wanted).select("doc_id", "text", "lang", place.alias("place"))
    # Rows that repeat one another are drawn together, so the number is bounded once more.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = chosen.withColumn("turn", turn).filter(F.col("turn") <= 2 * sample).select("doc_id", "text", "lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts in ngram_counts(batch.column("text")):
                rows = [c.astype("<u4").tobytes() for c in counts]
                part = batch.slice(row, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "counts"]
                )

    id_type = chosen.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(chosen, work, f"doc_id {id_type}, lang string, counts binary").collect()
    rows = sorted(((r["doc_id"], r["lang"], bytes(r["counts"])) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    counts = np.array([np.frombuffer(c, dtype="<u4") for _, _, c in rows], dtype=np.uint32).reshape(-1, BUCKETS)
    some = counts.sum(axis=1) > 0
    return fit_vectors(counts[some], [lang for (_, lang, _), ok in zip(rows, some) if ok])


def judge(counts: np.ndarray, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each row of counts."""
    some = counts.sum(axis=1) > 0
    if not model.languages:
        return [UNKNOWN] * len(counts), np.zeros(len(counts)), ~some
    x = _unit(counts.astype(np.float32) * model.idf)
    near = x @ model.centroids.T
    best = near.argmax(axis=1)
    score = np.where(some, np.clip(near[np.arange(len(x)), best], 0, 1), 0).astype(np.float64)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
    # The cosine of a short text is small for want of n-grams, about with the root of their number.
    floor = model.floor * np.sqrt(np.minimum(1, counts.sum(axis=1) / ENOUGH))
    return names, score, ~some | (score < floor)


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """The rows of `docs` with lang_pred, score and rejected."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in added}
    held = [f for f in docs.schema.fields if f.name.lower() not in names]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, counts in ngram_counts(batch.column(column)):
            languages, score, rejected = judge(counts, model)
            part = batch.slice(row, len(languages)).select([f.name for f in held])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*(f.name for f in held), *(f.name for f in added)],
            )

    return map_arrow(docs, lambda batches: chain.from_iterable(map(work, batches)), T.StructType(held + added))


def keep_known(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """The rows of `docs` that are not rejected, all columns as they are, whatever their names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, counts in ngram_counts(batch.column(column)):
                _, _, rejected = judge(counts, model)
                yield batch.slice(row, len(counts)).filter(pa.array(~rejected))

    return map_arrow(docs, work, docs.schema)
