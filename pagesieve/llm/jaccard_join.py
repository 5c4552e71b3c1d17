"""N-gram Jaccard join: documents whose sets of word shingles are similar, by a grouped prefix join.

1. Each document becomes its set of hashed shingles. Documents with one and the same set are one class and
   one member stands for them; sets are told apart by 128 bits.
2. A set can only have a partner if nearly all of its shingles occur in other sets: of n shingles at most the share
   of n that the threshold leaves may be in no other set. Counting those in a fixed range of the hashes rules
   most sets out, so that their texts are never moved.
3. Of the remaining sets, shingles in one set only come first, then the others from rare to frequent. Sets that are
   similar share a shingle in their prefixes in that order. Sets with the same prefix and the same size
   are collapsed into one group, and prefixes are indexed by group.
4. In each list of the index the group that has the shingle earliest in its order leads. Pairs of groups (leader, other) that
   pass the filters by size and place are expanded to members and verified. Sets linked so far form clusters.
5. What could still be missed are links between clusters. A set is compared with all sets of another cluster, block
   by block, if it shares a list with it and the filters allow a link. So a large group of near copies is
   never paired with itself, and no link between clusters is lost.

Shingles are told apart by 64-bit hashes, links are verified on the whole sets of hashes.

Defined cases: a null or empty text and one without words has no shingles and is linked with nothing; a text
of fewer words than a shingle has its whole sequence as one; rows with a null doc_id are linked
with nothing and have a null component; rows that repeat a doc_id are one document with the links of all of them, also where
their texts differ; an empty table gives an empty result. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm import bloom
from pagesieve.llm.components import components
from pagesieve.llm.shingles import mix, shingle_sets, text_chunks
from pagesieve.llm.tables import cut, join_checked, map_arrow, ship

WIDTH, PERCENT = 5, 75
#: The range of hashes in which shingles of no other set are counted, as a share of all hashes. It should be a
#: little above the share of shingles that may be missing; more moves more rows and rules out more sets.
COUNTED = 0.35
#: Sets of a cluster that are compared together.
BLOCK = 128


def _sets(docs: DataFrame, width: int, schema: str, row: str) -> DataFrame:
    """Shingle sets of doc_id and text, as rows of one kind: `digest`, `counted` or `whole`."""
    upto = np.uint64(int(COUNTED * 2**64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_chunks(batch.column("text")):
                values, sizes = shingle_sets(data, offsets, width)
                bounds = np.append(0, np.cumsum(sizes))
                if row == "whole":
                    sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                    columns = [ids.slice(first, len(sizes)), pa.array(sizes), sets]
                else:
                    one, two = _digests(values, bounds)
                    columns = [ids.slice(first, len(sizes)), pa.array(sizes), pa.array(one), pa.array(two)]
                    if row == "counted":
                        some = values < upto
                        columns = [pa.array(values[some].view(np.int64)), pa.array(np.repeat(one, sizes)[some])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), work, schema)


def _digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, which do not depend on the order of its members."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(salt))))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def similar(n1: Column, n2: Column, shared: Column, percent: int) -> Column:
    """Whether sets of these sizes that share so many members reach the threshold."""
    return (100 + percent) * shared >= percent * (n1 + n2)


def _least_shared(n1: Column, n2: Column, percent: int) -> Column:
    return F.ceil(percent * (n1 + n2) / (100 + percent))


def _sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    narrow = _digested(docs, width)
    if not _repeats(narrow):
        return _groups(docs, narrow, width, percent)
    # Ids with several texts: the texts are grouped under names of their own, and those that share an id are linked.
    keyed = docs.filter("doc_id is not null").select("doc_id", _text_name().alias("key"), "text")
    found = _named_groups(keyed, width, percent).select("key", "n_shingles", "component")
    rows = cut(keyed.select("doc_id", "key").join(cut(found.distinct()), "key"))
    members = rows.filter("n_shingles > 0").select("doc_id", "component").distinct()
    least = members.groupBy("component").agg(F.min("doc_id").alias("least"))
    tops = components(members.join(cut(least), "component").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    own = rows.join(tops.select(F.col("id").alias("doc_id"), F.col("component").alias("top")), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("top", "doc_id").alias("component_id")
    )
    nameless = narrow.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(nameless)


def _digested(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(_sets(docs, width, f"doc_id {kind}, n long, one long, two long", "digest"))


def _repeats(narrow: DataFrame) -> bool:
    """Whether an id comes with two different sets."""
    sets = narrow.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct("one", "two", "n")).alias("a"), F.max(F.struct("one", "two", "n")).alias("b")
    )
    return not sets.filter("a != b").isEmpty()


def _text_name() -> Column:
    """A name for an id with a text: rows with both equal share it."""
    text = F.coalesce("text", F.lit(""))
    return F.concat_ws("#", F.col("doc_id").cast("string"), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def _named_groups(keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """key, n_shingles and component (the least key reachable) of all rows of `keyed` (key, text)."""
    docs = keyed.select(F.col("key").alias("doc_id"), "text")
    return _groups(docs, _digested(docs, width), width, percent).toDF("key", "n_shingles", "component")


def _groups(docs: DataFrame, narrow: DataFrame, width: int, percent: int) -> DataFrame:
    """`groups` of rows whose ids have one text each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = narrow.filter("doc_id is not null and n > 0")
    classes = cut(known.groupBy("one", "two", "n").agg(F.min("doc_id").alias("sid")))
    whole = _candidates(docs, classes, width, percent, kind)
    labels = _clusters(whole, percent)
    found = classes.join(labels, classes["sid"] == labels["id"], "left").select(
        "one", "two", "n", F.coalesce("component", "sid").alias("component_id")
    )
    # Both sides are written tables, so that a class with a large share of all rows can be split.
    own = known.join(cut(found), ["one", "two", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = narrow.filter("doc_id is null or n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return own.unionByName(rest)


def _candidates(docs: DataFrame, classes: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """sid, n and the shingles of all sets that may have a partner; few others among them do no harm."""
    counted = _sets(docs, width, "token long, one long", "counted")
    # A shingle that only one set has shows the same digest as least and as greatest.
    alone = counted.groupBy("token").agg(F.min("one").alias("one"), F.max("one").alias("last")).filter("one = last")
    alone = cut(alone.groupBy("one").agg(F.count(F.lit(1)).alias("alone")))
    few = 100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")
    wanted = cut(classes.join(alone, "one", "left").filter(few).select("sid"))
    words = bloom.words_for(wanted.count())
    held = cut(bloom.build(wanted, F.col("sid"), words))
    picked = bloom.probe(docs.filter("doc_id is not null"), F.col("doc_id"), held, "wanted", words).filter("wanted")
    return cut(_sets(picked, width, f"sid {kind}, n long, tokens array<bigint>", "whole").filter("n > 0"))


def _clusters(whole: DataFrame, percent: int) -> DataFrame:
    """id and component of the sets that have a link."""
    prefixes = cut(_prefixes(whole, percent))
    members = prefixes.select("sid", "gid")
    grouped = cut(
        prefixes.groupBy("gid").agg(
            F.first("n").alias("n"), F.first("u").alias("u"), F.first("prefix").alias("prefix"), F.min("sid").alias("rep")
        )
    )
    lists = cut(grouped.select("gid", "n", "rep", "u", F.posexplode("prefix").alias("i", "token"))).withColumn(
        "place", F.col("u") + F.col("i")
    )
    leaders = cut(
        lists.groupBy("token")
        .agg(F.min(F.struct("place", "gid", "n", "rep")).alias("lead"), F.count(F.lit(1)).alias("many"))
        .filter("many > 1")
        .select("token", "lead.*")
        .toDF("token", "l_place", "l_gid", "l_n", "l_rep")
    )
    left = F.least(F.col("n") - F.col("place"), F.col("l_n") - F.col("l_place"))
    pairs = (
        lists.join(leaders, "token")
        .filter(F.col("gid") != F.col("l_gid"))
        .filter(_sizes_fit(F.col("n"), F.col("l_n"), percent) & (left >= _least_shared(F.col("n"), F.col("l_n"), percent)))
        .select("gid", F.col("l_rep").alias("a"))
        .unionByName(grouped.select("gid", F.col("rep").alias("a")))
        .distinct()
    )
    expanded = cut(cut(pairs).join(members, "gid").select("a", F.col("sid").alias("b")).filter("a != b").distinct())
    near = components(_verified(expanded, whole, percent))
    across = _across(prefixes, near, whole, percent)
    # Links between clusters join their names.
    top = components(across)
    near = join_checked(near, top.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    near = near.select("id", F.coalesce("to", "component").alias("component"))
    return cut(near.unionByName(top).groupBy("id").agg(F.min("component").alias("component")))


def _prefixes(whole: DataFrame, percent: int) -> DataFrame:
    """sid, n, u (shingles that no other set has), prefix (the rest of it, rare ones first) and gid."""
    tokens = whole.select("sid", "n", F.explode("tokens").alias("token"))
    often = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    listed = (
        tokens.join(often, "token")
        .groupBy("sid", "n")
        .agg(F.array_sort(F.collect_list(F.struct("many", "token"))).alias("shared"))
        .withColumn("u", F.greatest(F.col("n") - F.size("shared"), F.lit(0)))
    )
    spare = F.floor((100 - percent) * F.col("n") / 100)
    prefix = F.transform(F.slice("shared", F.lit(1), (spare + 1 - F.col("u")).cast("int")), lambda x: x["token"])
    return (
        listed.filter(F.col("u") <= spare)
        .select("sid", "n", "u", prefix.alias("prefix"))
        .withColumn("gid", F.xxhash64("n", "prefix"))
    )


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; `pairs` is a written table, hot ids in it can be split."""
    one = pairs.join(whole.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")), "b")
    two = whole.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    fits = _sizes_fit(F.col("n_a"), F.col("n_b"), percent)
    return one.join(two, "a").filter(fits & similar(F.col("n_a"), F.col("n_b"), shared, percent)).select("a", "b")


def _across(prefixes: DataFrame, near: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between cluster names, found by comparing sets with the clusters they share lists with."""
    named = prefixes.join(near, prefixes["sid"] == near["id"], "left").select(
        "sid", "n", "u", "prefix", F.coalesce("component", "sid").alias("cluster")
    )
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    named = cut(join_checked(named, cut(sizes), "cluster"))
    lists = named.select("sid", "n", "cluster", "members", "u", F.posexplode("prefix").alias("i", "token"))
    lists = lists.withColumn("left", F.col("n") - F.col("u") - F.col("i"))
    by_cluster = lists.groupBy("token", "cluster", "members").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("best")
    )
    mixed = by_cluster.groupBy("token").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).filter("x != y")
    mixed = cut(mixed.select("token"))
    lists = cut(lists.join(mixed, "token").select("token", "sid", "n", "left", "cluster", "members"))
    other = cut(by_cluster.join(mixed, "token").toDF("token", "o_cluster", "o_members", "o_least", "o_most", "o_best"))
    n, smallest = F.col("n"), F.greatest("o_least", F.ceil(percent * F.col("n") / 100))
    need = _least_shared(n, smallest, percent)
    chosen = (
        lists.join(other, "token")
        # Of two clusters the sets of the smaller one are compared with the larger one.
        .filter(F.struct("members", "cluster") < F.struct("o_members", "o_cluster"))
        .filter((100 * n >= percent * F.col("o_least")) & (100 * F.col("o_most") >= percent * n))
        .filter((F.col("left") >= need) & (F.col("o_best") >= need))
        .select("sid", "cluster", "o_cluster", "o_members")
        .distinct()
    )
    chosen = cut(chosen)
    # Sets of the larger clusters in blocks, and the sets to compare with them in blocks as well.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    wanted = cut(chosen.select(F.col("o_cluster").alias("cluster")).distinct())
    held = named.join(wanted, "cluster").select(
        F.col("cluster").alias("o_cluster"), "sid", F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("block")
    )
    many = chosen.groupBy("o_cluster").agg(F.count(F.lit(1)).alias("guests"))
    many = cut(many.withColumn("guest_blocks", F.ceil(F.col("guests") / BLOCK).cast("int")).drop("guests"))
    everyone = lambda column: F.explode(F.sequence(F.lit(0), column - 1))
    hosts = join_checked(held, many, "o_cluster").select(
        "o_cluster", "block", "sid", everyone(F.col("guest_blocks")).alias("guest_block"), F.lit(None).cast(named.schema["cluster"].dataType).alias("cluster")
    )
    o_blocks = F.ceil(F.col("o_members") / BLOCK).cast("int")
    guests = join_checked(chosen, many, "o_cluster").select(
        "o_cluster",
        everyone(o_blocks).alias("block"),
        "sid",
        F.pmod(F.xxhash64("sid"), F.col("guest_blocks")).cast("int").alias("guest_block"),
        "cluster",
    )
    rows = cut(hosts.unionByName(guests)).join(whole, "sid")
    kind = named.schema["cluster"].dataType.simpleString()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        host = rows["cluster"].isna().to_numpy()
        hosts, guests = rows[host], rows[~host]
        found = []
        if len(hosts) and len(guests):
            sizes = hosts["n"].to_numpy()
            members = np.concatenate(hosts["tokens"].to_list())
            bounds = np.cumsum(sizes) - sizes
            for tokens, n, cluster in zip(guests["tokens"], guests["n"], guests["cluster"]):
                own = np.sort(tokens)
                at = np.minimum(np.searchsorted(own, members), len(own) - 1)
                shared = np.add.reduceat((own[at] == members).astype(np.int64), bounds)
                if ((100 + percent) * shared >= percent * (sizes + n)).any():
                    found.append(cluster)
        return pd.DataFrame({"a": found, "b": [rows["o_cluster"].iloc[0]] * len(found)})

    ship(whole.sparkSession)
    return rows.groupBy("o_cluster", "block", "guest_block").applyInPandas(compare, f"a {kind}, b {kind}")


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` but those that another document of their group, the one with the least id, stands for.

    Here a document is an id with its text: where ids repeat with different texts or are null, rows are told apart by both, and no text is
    lost with another one. Rows that agree in both stay or go together.
    """
    narrow = _digested(docs, width)
    if narrow.filter("doc_id is null and n > 0").isEmpty() and not _repeats(narrow):
        found = _groups(docs.select("doc_id", "text"), narrow, width, percent)
        return bloom.without(docs, "doc_id", found.filter("doc_id != component_id").select("doc_id"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _text_name().alias("key"), "text")
    found = _named_groups(packed.select("key", "text"), width, percent).filter("n_shingles > 0")
    ids = packed.select("key", "doc_id").distinct()
    found = cut(found.select("key", "component").distinct().join(ids, "key"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = found.groupBy("component").agg(F.min(order).alias("first"))
    gone = found.join(cut(first), "component").filter(F.col("key") != F.col("first.key")).select("key")
    return bloom.without(packed, "key", gone).select("row.*")
