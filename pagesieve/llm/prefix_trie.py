"""Conversation prefix trie: what conversations share with each other, turn by turn from the start.

A node is a distinct sequence of first turns, its members are the conversations that start with it. Turns are told apart by 128 bits of
role and text, and only these and the sizes of the texts are moved. A conversation becomes rows of `BLOCK` positional
turn-id columns, each row keyed by the node that its earlier blocks lead to. One ROLLUP over these columns counts all prefixes of all
blocks together; ``grouping_id`` tells how long the prefix is. The name of a node combines one number for each
(turn, position) by xor, so the key of any block is a running xor and no step waits for the block before.

Sums over subtrees need no walk either: the weight of a node is carried by its smallest member, from the depth at which that one
is the smallest; summed over the members of any node by a second ROLLUP, these are the sums over its subtree. In the same way a leaf is
counted by its smallest member.

`rebuilt` gives conversations new heads before that, see there.

Conversations may be of any length: running values are taken within buckets of positions and over the buckets. Ids of
conversations that end at one node are hashed in order: pieces are joined where the ids lie, the digest reads the pieces as
a stream, since SHA-256 goes from front to back.

Defined cases: turns are in order of `turn`, null first, those of one turn by role, the first characters of the text, and a hash;
repeated rows are turns each; a null role or text is empty; rows without a conv_id belong to no conversation; a
conversation may be left without turns and is then a member of the root alone; an empty table has no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.functions.frames import one_row
from pagesieve.llm.tables import cut, map_arrow

#: Turn-id columns of a row; values of one key that a window puts in order at a time; ids joined in one piece.
BLOCK, BUCKET, PIECE = 8, 1024, 4096
NONE = hashlib.sha256(b"").hexdigest()
_HEAD = 32
_COLUMNS = [f"t{i}" for i in range(BLOCK)]


def _running(df: DataFrame, key: str, order: str, sums: dict[str, tuple[str, str]], ahead: bool = False) -> DataFrame:
    """`df` with, for each new column, the `sum` or `bit_xor` of a column over the rows of the key before it (after it if `ahead`).

    `order` is a whole number; rows are put in order within buckets of it, and the buckets' totals over the key.
    """
    bucket = F.coalesce(F.floor(F.col(order) / BUCKET), F.lit(-(1 << 53)))
    marked = df.withColumn("__bucket", bucket)
    by = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    within = Window.partitionBy(key, "__bucket").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(key).orderBy(by("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    call = lambda kind, c: F.call_function(kind, F.col(c))
    totals = marked.groupBy(key, "__bucket").agg(*[call(kind, c).alias(f"__{n}") for n, (kind, c) in sums.items()])
    zero = F.lit(0).cast("long")
    before = totals.select(
        key, "__bucket", *[F.coalesce(F.call_function(kind, F.col(f"__{n}")).over(over), zero).alias(f"__{n}") for n, (kind, _) in sums.items()]
    )
    local = marked.withColumns({f"__in_{n}": F.coalesce(call(kind, c).over(within), zero) for n, (kind, c) in sums.items()})
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    joined = local.join(before, [key, "__bucket"])
    return joined.select(
        *df.columns, *[join[kind](F.col(f"__in_{n}"), F.col(f"__{n}")).alias(n) for n, (kind, _) in sums.items()]
    )


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0) and t (two hashes and the bytes of the text) of all turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.octet_length(text).alias("bytes")
    )
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, _HEAD).alias("head"), turn.alias("t")
    )
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 53))))
    within = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "t")
    over = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("conv_id", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    placed = rows.withColumn("rank", F.row_number().over(within)).join(before, ["conv_id", "bucket"])
    return placed.select("conv_id", (F.col("before") + F.col("rank") - 1).alias("pos"), "t")


def heads(conv_id: Column) -> tuple[Column, Column]:
    """How many first turns a conversation gets from another one, and from which."""
    return F.crc32(conv_id.cast("string")) % 9, conv_id - conv_id % 5


MOST_HEAD = 8


def rebuilt(placed: DataFrame, given=heads) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, t) of all conversations after each got its new head, and all conversations (conv_id).

    `given` names for a conversation the number h of turns, at most `MOST_HEAD`, and the conversation they come from: its first h
    turns (all if fewer, none if it is not there) stand in place of the first h own turns (all if fewer).
    """
    h, base = given(F.col("conv_id"))
    sizes = cut(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    convs = sizes.select("conv_id", h.alias("h"), base.alias("base"))
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = cut(convs.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))))
    first = placed.filter(F.col("pos") < MOST_HEAD).select(F.col("conv_id").alias("base"), "pos", "t")
    taken = known.filter("head > 0").select("conv_id", "base", "head").join(first, "base").filter("pos < head")
    own = placed.join(known.select("conv_id", "h", "head"), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "t")
    return taken.select("conv_id", "pos", "t").unionByName(own), known.select("conv_id")


def _name(t: Column, pos: Column) -> tuple[Column, Column]:
    """The two numbers of a turn at a position; 0 without a turn."""
    return tuple(
        F.when(t.isNotNull(), F.xxhash64(F.lit(salt), t["a"], t["b"], pos.cast("long"))).otherwise(F.lit(0).cast("long"))
        for salt in (3, 4)
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, its turn ids, and the node (p1, p2) before it."""
    one, two = _name(F.col("t"), F.col("pos"))
    named = turns.withColumns({"block": F.call_function("div", F.col("pos"), F.lit(BLOCK)), "one": one, "two": two})
    wide = cut(
        named.groupBy("conv_id", "block").agg(
            *[F.max(F.when(F.col("pos") % BLOCK == i, F.col("t"))).alias(c) for i, c in enumerate(_COLUMNS)],
            F.bit_xor("one").alias("one"),
            F.bit_xor("two").alias("two"),
        )
    )
    return cut(_running(wide, "conv_id", "block", {"p1": ("bit_xor", "one"), "p2": ("bit_xor", "two")}))


def _rolled(blocks: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks: id, parent's id, depth, bytes of the last text, level (depth in the block), and the measures."""
    columns = ", ".join(_COLUMNS)
    grouped = blocks.sparkSession.sql(
        f"select p1, p2, block, {columns}, {BLOCK} - bit_count(grouping_id()) as level, {measures} "
        f"from {{blocks}} group by p1, p2, block, rollup({columns})",
        blocks=blocks,
    )
    last = F.element_at(F.array(*_COLUMNS), F.col("level"))
    ids = {"1": F.col("p1"), "2": F.col("p2")}
    for i, c in enumerate(_COLUMNS):
        for side, number in zip(ids, _name(F.col(c), F.col("block") * BLOCK + i)):
            # columns beyond the level are rolled up, and null
            ids[side] = ids[side].bitwiseXOR(number)
    depth = F.col("block") * BLOCK + F.col("level")
    own = _name(F.col("last"), F.col("depth") - 1)
    nodes = grouped.filter("level > 0").withColumns({"last": last, "depth": depth}).filter("last is not null")
    nodes = nodes.withColumns({"id1": ids["1"], "id2": ids["2"], "bytes": F.col("last.bytes").cast("long")})
    parents = {"pid1": F.col("id1").bitwiseXOR(own[0]), "pid2": F.col("id2").bitwiseXOR(own[1])}
    return nodes.withColumns(parents).drop(*_COLUMNS, "p1", "p2", "block", "last")


def _carried(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The blocks with what each conversation carries as smallest member: s1.. (weights from a level of the block on) and leaf."""
    shared = nodes.filter("n_convs > 1").select(
        "conv_id",
        F.call_function("div", F.col("depth") - 1, F.lit(BLOCK)).alias("block"),
        "level",
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"),
    )
    from_level = [F.sum(F.when(F.col("level") >= i, F.col("w"))).alias(f"s{i}") for i in range(1, BLOCK + 1)]
    weights = shared.groupBy("conv_id", "block").agg(*from_level)
    held = blocks.join(weights, ["conv_id", "block"], "left").na.fill(0, [f"s{i}" for i in range(1, BLOCK + 1)])
    held = _running(cut(held), "conv_id", "block", {"later": ("sum", "s1")}, ahead=True)
    held = held.withColumns({f"s{i}": F.col(f"s{i}") + F.col("later") for i in range(1, BLOCK + 1)})
    inner = nodes.select(F.col("pid1").alias("id1"), F.col("pid2").alias("id2")).distinct()
    leaves = cut(nodes.join(inner, ["id1", "id2"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf")))
    return cut(held.join(leaves, "conv_id", "left").na.fill(0, ["leaf"]).drop("one", "two", "later"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to PIECE ids of one node, joined; rows come in order."""
    names = ["id1", "id2", "first", "ids"]
    for batch in batches:
        ids = [batch.column(n).to_pylist() for n in ("id1", "id2", "conv_id")]
        out, at, n = [], 0, batch.num_rows
        for i in range(1, n + 1):
            if i == n or (ids[0][i], ids[1][i]) != (ids[0][at], ids[1][at]) or i - at == PIECE:
                out.append((ids[0][at], ids[1][at], ids[2][at], ",".join(map(str, ids[2][at:i]))))
                at = i
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=names
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order; a node may go on in the next batch."""
    names = ["id1", "id2", "ends_sha256"]

    def rows(done: list) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], names=names
        )

    key, digest = None, None
    for batch in batches:
        done = []
        for one, two, ids in zip(*(batch.column(n).to_pylist() for n in ("id1", "id2", "ids"))):
            if (one, two) == key:
                digest.update(b",")
            else:
                if digest:
                    done.append((*key, digest.hexdigest()))
                key, digest = (one, two), hashlib.sha256()
            digest.update(ids.encode())
        yield rows(done)
    if digest:
        yield rows([(*key, digest.hexdigest())])


def _ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """id1, id2 and ends_sha256 of the nodes at which conversations end."""
    last = blocks.groupBy("conv_id").agg(F.bit_xor("one").alias("id1"), F.bit_xor("two").alias("id2"))
    ends = cut(convs.join(last, "conv_id", "left").na.fill(0, ["id1", "id2"]).select("id1", "id2", "conv_id"))
    keys = ["id1", "id2", "conv_id"]
    pieces = map_arrow(
        ends.repartitionByRange(*keys).sortWithinPartitions(*keys), _pieces, "id1 long, id2 long, first long, ids string"
    )
    ordered = pieces.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "first").select("id1", "id2", "ids")
    return map_arrow(ordered, _digests, "id1 long, id2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of conversations `convs` (conv_id) with turns (conv_id, pos from 0 without gaps, t).

    One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes
    in its subtree), saved_tokens (bytes of texts that need not be repeated in the subtree), ends_sha256.
    """
    blocks = _blocks(turns)
    counts = "count(*) as n_convs, min(conv_id) as conv_id"
    nodes = cut(_rolled(blocks, counts))
    carried = _carried(blocks, nodes)
    sums = ", ".join(f"sum(s{i})" for i in range(1, BLOCK + 1))
    nodes = _rolled(carried, f"{counts}, sum(leaf) as n_leaves, array({sums}) as sums")
    nodes = cut(nodes.withColumn("saved_tokens", F.element_at("sums", F.col("level"))).drop("sums", "level", "bytes"))
    children = nodes.groupBy("pid1", "pid2").agg(F.count(F.lit(1)).alias("n_children")).toDF("id1", "id2", "n_children")
    zero = lambda name: F.lit(0).cast("long").alias(name)
    top = nodes.filter("depth = 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    top = cut(one_row(whole, top).filter("n_convs > 0"))
    root = top.select(
        zero("depth"), "n_convs", "conv_id", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), zero("id1"), zero("id2"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.coalesce("saved_tokens", zero("x")).alias("saved_tokens"),
    )
    above = nodes.select("id1", "id2", "conv_id").unionByName(root.select("id1", "id2", "conv_id"))
    above = above.toDF("pid1", "pid2", "parent_conv_id")
    every = nodes.join(cut(above), ["pid1", "pid2"]).drop("pid1", "pid2").unionByName(root)
    every = every.join(children, ["id1", "id2"], "left").join(_ends(blocks, convs), ["id1", "id2"], "left")
    return every.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, given=heads) -> DataFrame:
    """The trie of `conversations` (conv_id, turn, role, text) after each got the head that `given` names; see `trie`."""
    turns, convs = rebuilt(cut(positions(conversations)), given)
    return trie(cut(turns), convs)
