"""Toxicity: a recurrent network over overlapping windows of a text, trained on labelled documents.

A document's score is that of its most toxic window. Windows of 32 words start at every word. The network is trained on
the driver in numpy, on a bounded sample of labelled rows: about `SAMPLE` of each label, chosen by a hash of the id, with
`LONGEST` characters a row on average. Shorter texts train whole; the longer ones share what that leaves, and one that is longer than
its share trains with `STRETCHES` stretches spread evenly over it.
A shift of the logits is fitted so that 0.5 parts the sample best. Scoring reads whole texts.

Defined cases: a null text counts as empty; a text without words scores 0; where no row of one of the labels
is given, all texts score 0; rows with a null label, and labels other than 0 and 1, train nothing. Other columns
stay; input columns named as added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagesieve.llm.gru import Network, read_words, sigmoid
from pagesieve.llm.shingles import text_chunks
from pagesieve.llm.tables import map_arrow

SAMPLE = 1000
LONGEST = 20_000
STRETCHES = 10
PASSES, BATCH, RATE = 6, 128, 0.01
CHUNK_BYTES = 1 << 20


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network for doc_id and text of `docs` and doc_id and toxic of `labels`."""
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("__id"), "toxic")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("__id", F.lit(6)), 11) / float(1 << 53)
    wanted = F.lit(False)
    for label, n in sorted(sizes.items()):
        wanted = wanted | ((F.col("toxic") == label) & (place < min(1.0, sample / n)))
    # Rows that repeat an id are drawn together, so the number is bounded once more: rows of two numbers, at most twice the sample a label.
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy(place, "__id"))
    drawn = known.filter(wanted).withColumn("turn", turn).filter(F.col("turn") <= 2 * sample).drop("turn")
    chosen = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    again = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "text")))
    chosen = chosen.withColumn("turn", again).filter(F.col("turn") <= 4 * sample).drop("turn")
    rows = _shortened(chosen.filter("text is not null"), sample).select("doc_id", "toxic", "text").collect()
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows)
    target = np.array([r[1] for r in rows], dtype=np.int64)
    if len(set(target.tolist())) < 2:
        return None
    column = pa.array([r[2] for r in rows], pa.large_string())
    network = Network.fresh()
    (_, data, offsets), *_ = text_chunks(column, 1 << 40, rows=len(column))
    words = read_words(data, offsets)
    network.fit(words, target, PASSES, BATCH, RATE)
    network.shift = _threshold(network.score_texts(words), target)
    return network


def _shortened(chosen: DataFrame, sample: int) -> DataFrame:
    """The rows with texts whose characters of each label are bounded together; see above."""
    size, long = F.length("text"), F.length("text") > LONGEST
    sums = chosen.groupBy("toxic").agg(F.sum(F.when(~long, size)).alias("short"), F.count_if(long).alias("n")).collect()
    text = F.col("text")
    for r in sums:
        if r["n"]:
            share = max(LONGEST, (sample * LONGEST - (r["short"] or 0)) // r["n"])
            piece = share // STRETCHES
            start = lambda i, piece=piece: (i * (size - piece).cast("long") / (STRETCHES - 1)).cast("int") + 1
            pieces = [F.substring("text", start(F.lit(i)), F.lit(piece)) for i in range(STRETCHES)]
            text = F.when((F.col("toxic") == r["toxic"]) & (size > share), F.concat_ws(" ", *pieces)).otherwise(text)
    return chosen.withColumn("text", text)


def _threshold(logits: np.ndarray, target: np.ndarray) -> float:
    """The logit that parts the two labels with the fewest errors, each label weighing the same."""
    finite = np.isfinite(logits)
    order = np.argsort(logits[finite])
    values, labels = logits[finite][order], target[finite][order]
    if not len(values):
        return 0.0
    missed = np.append(0, np.cumsum(labels)) / max(1, labels.sum())
    alarms = np.append(np.cumsum((1 - labels)[::-1])[::-1], 0) / max(1, (1 - labels).sum())
    cut = int(np.argmin(missed + alarms))
    if cut in (0, len(values)):
        return float(values[min(cut, len(values) - 1)])
    return float((values[cut - 1] + values[cut]) / 2)


def score(docs: DataFrame, network: Network | None, column: str = "text") -> DataFrame:
    """The rows of `docs`, without the text, with score (0 to 1) and predicted (1 from 0.5 on)."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    held = [f for f in docs.schema.fields if f.name.lower() not in {"score", "predicted", column.lower()}]
    names = [f.name for f in held]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for _, data, offsets in text_chunks(batch.column(column), CHUNK_BYTES):
                if network is None:
                    found.append(np.zeros(len(offsets) - 1))
                else:
                    found.append(sigmoid(network.score_texts(read_words(data, offsets)) - network.shift))
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*names, "score", "predicted"],
            )

    return map_arrow(docs, work, T.StructType(held + added))
