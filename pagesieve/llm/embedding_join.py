"""Embedding near-duplicates by an epsilon grid order join.

Vectors of cosine c or more are, normalised, within epsilon = sqrt(2 - 2 c) of each other. All are rotated to principal
axes; cells of width epsilon on the leading axes put them in epsilon grid order, and the sequence is cut into blocks.
Pairs of sequence intervals are joined recursively, from the whole sequence down to single blocks and within blocks down to
a few vectors; a pair whose bounding boxes are farther apart than epsilon is skipped with all that is in it.
What is left is compared in double precision. Each pair of blocks gives the link counts of its vectors and a
local component for each, so the output grows with the vectors of a pair of blocks and not with their links.

The axes come from a sample of about `SAMPLE` vectors; any rotation keeps distances, so the sample decides speed alone.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and rows with a
null vec_id as well; vectors of different lengths are not compared; identical vectors are compared once and count each,
also when they repeat a vec_id; different vectors with one vec_id are vectors each, with links and a component of their own; an empty table gives an empty result. Columns other than vec_id and embedding are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.llm.components import components
from pagesieve.llm.tables import cut, join_checked, map_arrow

COSINE = 0.95
SAMPLE = 4_000
#: Leading axes with grid cells, and axes in the boxes of intervals.
GRID, BOX = 6, 16
#: Vectors of a block, and of the intervals within blocks that are compared as a whole.
BLOCK, LEAF = 2048, 64
#: Intervals of the next level in one of this level.
FAN = 8


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept."""
    embedding = F.col("embedding")
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    fine = F.coalesce(F.col("vec_id").isNotNull() & some & ~F.coalesce(bad, F.lit(False)), F.lit(False))
    keyed = vectors.select(
        "vec_id", "embedding", F.xxhash64("embedding").alias("one"), F.xxhash64("embedding", F.lit(10)).alias("two"), fine.alias("fine")
    )
    narrow = cut(keyed.select("vec_id", "one", "two", "fine"))
    classes = cut(
        keyed.filter("fine")
        .groupBy("one", "two")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding"))
        # Different vectors may have one least vec_id; the rows are written, so their numbers stay.
        .withColumn("id", F.monotonically_increasing_id())
    )
    found = None
    # Vectors of one table mostly have one length; each length is a join of its own.
    for row in classes.select("size").distinct().collect():
        part = _linked(classes.filter(F.col("size") == row["size"]).drop("size", "least"), row["size"], cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")).limit(0)
    found = cut(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = cut(
        classes.drop("embedding", "size")
        .join(links, "id", "left")
        .join(labels, "id", "left")
        .select(
            "one",
            "two",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(cut(names), "component").select("one", "two", "n_links", "component_id")
    own = narrow.filter("fine").join(cut(known), ["one", "two"]).select("vec_id", "n_links", "component_id")
    alone = narrow.filter("not fine").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    rows = own.unionByName(alone)
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    # Scaling by the greatest component first keeps squares of huge and tiny ones in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """An orthonormal basis, leading axes of a hash sample of the normalised vectors first."""
    total = classes.count()
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) / float(1 << 53)
    rows = classes.filter(place < min(1.0, SAMPLE / max(total, 1))).select("id", "embedding").toArrow().sort_by("id")
    if not len(rows):
        return np.eye(size)
    x = _unit(_matrix(rows["embedding"], size))
    values, axes = np.linalg.eigh(np.cov(x.T).reshape(size, size) if len(x) > 1 else np.eye(size))
    return axes[:, np.argsort(-values, kind="stable")]


def _linked(classes: DataFrame, size: int, cosine: float) -> DataFrame:
    """id, links (weighted by copies) and root (least id of the local component), for each pair of blocks."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    axes = principal_axes(classes, size)
    blocks = _blocks(classes, size, axes, epsilon)
    boxes = blocks.drop("ids", "copies", "vectors")
    pairs = _near_blocks(boxes, epsilon)
    own = blocks.select("block", "ids", "copies", "vectors")
    left = own.toDF(*[f"{c}_a" for c in own.columns])
    right = own.toDF(*[f"{c}_b" for c in own.columns])
    joined = pairs.join(left, pairs["a"] == left["block_a"]).join(right, F.col("b") == F.col("block_b"))
    kind = classes.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, links, roots = _join_blocks(row, size, axes, epsilon, cosine)
                type_ = batch.schema.field("ids_a").type.value_type
                columns = [pa.array(ids, type_), pa.array(links), pa.array(roots, type_)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "links", "root"])

    columns = ["a", "b", *(f"{c}_{s}" for s in "ab" for c in ("ids", "copies", "vectors"))]
    return map_arrow(joined.select(columns), work, f"id {kind}, links long, root {kind}")


def _blocks(classes: DataFrame, size: int, axes: np.ndarray, epsilon: float) -> DataFrame:
    """block (numbers in epsilon grid order), ids, copies, vectors, and the box lo, hi of each block."""
    lead = axes[:, : max(GRID, BOX)]
    schema = classes.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = _unit(_matrix(batch.column("embedding"), size)) @ lead
            cells = np.floor(spots[:, :GRID] / epsilon).astype(np.int32)
            ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            # Within a cell the next axis decides, so that a full cell can be cut anywhere.
            rest = spots[:, min(GRID, spots.shape[1] - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(cells.ravel())), pa.array(rest)],
                names=[*batch.schema.names, "cells", "rest"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    placed = cut(map_arrow(classes, place, f"{fields}, cells array<int>, rest double"))
    spark = classes.sparkSession
    parts = -(-placed.count() // BLOCK)
    parts = max(1, min(parts, 4 * max(200, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    order = ["cells", "rest", "id"]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    single = schema["embedding"].dataType.elementType.simpleString() == "float"
    dtype = np.dtype("<f4" if single else "<f8")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        number = 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, number
            table = pa.Table.from_batches(waiting).combine_chunks()
            upto = table.num_rows if last else table.num_rows // BLOCK * BLOCK
            for i in range(0, upto, BLOCK):
                part = table.slice(i, min(BLOCK, upto - i))
                raw = _matrix(part["embedding"], size).astype(dtype)
                spots = _unit(raw) @ lead[:, :BOX]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "k": number,
                            "ids": part["id"].to_pylist(),
                            "copies": part["copies"].to_pylist(),
                            "vectors": raw.tobytes(),
                            "lo": spots.min(axis=0).tolist(),
                            "hi": spots.max(axis=0).tolist(),
                        }
                    ]
                )
                number += 1
            waiting = table.slice(upto).to_batches()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK:
                yield from blocks(False)
        if waiting:
            yield from blocks(True)

    kind = schema["id"].dataType.simpleString()
    made = map_arrow(
        ranged.select("id", "copies", "embedding"),
        gather,
        f"k long, ids array<{kind}>, copies array<bigint>, vectors binary, lo array<double>, hi array<double>",
    )
    made = cut(made.withColumn("part", F.spark_partition_id()))
    # Blocks are numbered through, partition after partition; one row for each partition meets in one task.
    counts = made.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(counts.select("part", F.coalesce(upto, F.lit(0)).alias("before")))
    numbered = join_checked(made, offsets, "part")
    return cut(numbered.select((F.col("before") + F.col("k")).alias("block"), "ids", "copies", "vectors", "lo", "hi"))


def _near_blocks(boxes: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b), a not behind b, of blocks whose boxes are within epsilon, by recursion over intervals."""
    low = lambda c: F.array(*[F.min(F.get(c, i)) for i in range(BOX)])
    high = lambda c: F.array(*[F.max(F.get(c, i)) for i in range(BOX)])
    levels = [cut(boxes.select(F.col("block").alias("i"), "lo", "hi"))]
    while levels[-1].count() > 1:
        up = F.floor(F.col("i") / FAN).alias("i")
        levels.append(cut(levels[-1].groupBy(up).agg(low(F.col("lo")).alias("lo"), high(F.col("hi")).alias("hi"))))
    pairs = levels[-1].select(F.col("i").alias("a"), F.col("i").alias("b"))
    for level in reversed(levels[:-1]):
        child = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
        # Each side is joined with the boxes before the other side is split up.
        one = level.select(F.col("i").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        two = level.select(F.col("i").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        split = pairs.select(child("a").alias("a"), "b").join(one, "a")
        split = split.select("a", "lo_a", "hi_a", child("b").alias("b")).filter("a <= b").join(two, "b")
        apart = F.zip_with(
            F.zip_with("lo_a", "hi_b", lambda x, y: x - y),
            F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
            lambda x, y: F.greatest(x, y, F.lit(0.0)),
        )
        square = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x * x)
        pairs = cut(split.filter(square <= epsilon * epsilon).select("a", "b"))
    return cut(pairs)


def _join_blocks(row: dict, size: int, axes: np.ndarray, epsilon: float, cosine: float) -> tuple[list, np.ndarray, list]:
    """Links between two blocks, or within one: ids that have any, their number, and the least id they reach."""
    sides = []
    for s in "ab":
        raw = row[f"vectors_{s}"]
        raw = np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * size * len(row[f"ids_{s}"]) else "<f8").reshape(-1, size)
        unit = _unit(raw)
        sides.append((unit, unit @ axes[:, :BOX], np.array(row[f"copies_{s}"], dtype=np.int64)))
    same = row["a"] == row["b"]
    (x, spots_x, copies_x), (y, spots_y, copies_y) = sides
    left, right = [], []
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        a, b, c, d = waiting.pop()
        if same and c < a:
            continue  # the mirror image of another pair
        lo_a, hi_a = spots_x[a:b].min(axis=0), spots_x[a:b].max(axis=0)
        lo_b, hi_b = spots_y[c:d].min(axis=0), spots_y[c:d].max(axis=0)
        gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
        if gap @ gap > epsilon * epsilon:
            continue
        if b - a > LEAF or d - c > LEAF:
            # On the diagonal both sides are cut alike, so mirror images keep the same bounds.
            firsts = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
            seconds = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > LEAF else [(c, d)]
            waiting += [(*p, *q) for p in firsts for q in seconds]
            continue
        i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
        i, j = i + a, j + c
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
    j = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
    ids = row["ids_a"] if same else row["ids_a"] + row["ids_b"]
    copies = copies_x if same else np.concatenate([copies_x, copies_y])
    if not same:
        j = j + len(x)
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    order = np.argsort(np.array(ids), kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    root = _least_reached(rank[i], rank[j], len(ids))
    linked = np.flatnonzero(links)
    return [ids[k] for k in linked], links[linked], [ids[order[root[rank[k]]]] for k in linked]


def _least_reached(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least one it reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
