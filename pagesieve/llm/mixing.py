"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of times it is taken on average. Of all rates between 0 and
`most` whose words meet the targets of the sources, those of least relative entropy to "each document once" are
exponentially tilted: min(most, exp(lambda * size)), one lambda for each source. The lambdas solve the convex dual;
they are found by Newton iterations over the histogram of sizes by source, safeguarded by a bracket.
Rates are then rounded into copies: a document is taken floor(rate) times, and once more if a hash of
its id is below the rest of its rate. That threshold is moved a little for each source until its words reach the target as
far as whole documents do, and one more document, of about the size still missing, is taken if that comes nearer.

A plan has one row for each source; it is applied to documents row by row, so texts are not moved.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; a source without words has target 0; rows that repeat a doc_id, source and size share one decision; an empty
table gives an empty mix. Only doc_id, source and text are looked at; other columns stay with `apply`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesieve.llm.tables import cut, join_checked

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
TOLERANCE = 1e-9
#: Steps of the rounding threshold; a source's documents between two of them are put in order.
NOTCHES, BAND = 1 << 14, 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def targets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """key, source, source_size, size_scale and target of each source.

    The first sources in order of `most * size / weight` stop at their limits, the others share the rest by
    weight. This is where resharing the excess again and again ends.
    """
    squares = F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)"))
    sources = rows.groupBy("key").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.coalesce(F.try_divide(squares.cast("double"), F.sum("size").cast("double")), F.lit(1.0)).alias("size_scale"),
    )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    sources = sources.withColumn("weight", weight).withColumn("limit", limit)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "key")
    budget = F.sum("source_size").over(Window.partitionBy()) * float(share)
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumns({"level": (budget - before) / after, "budget": budget})
    sources = sources.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # The level of all that are not full is that of the first of them, the greatest.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * level))
    return sources.select("key", "source", "source_size", "size_scale", "full", target.alias("target"))


def tilts(histogram: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """The sources with their lambda; rates are min(most, exp(lambda * size / size_scale))."""
    open_ = (~F.col("full")) & (F.col("target") > 0)
    state = sources.withColumns(
        {
            "tilt": F.when(open_, F.log(F.try_divide("target", "source_size"))).otherwise(F.lit(0.0)),
            "low": F.col("size_scale") * -60.0,
            "high": F.col("size_scale") * float(most),
            "off": F.when(open_, F.lit(1.0)).otherwise(F.lit(0.0)),
        }
    )
    state = cut(state)
    for _ in range(STEPS):
        joined = join_checked(histogram, state.filter(F.col("off") > TOLERANCE), "key")
        x = F.col("size") / F.col("size_scale")
        words = F.col("n") * F.col("size")
        rate = F.exp(F.col("tilt") * x)
        # Decimal sums are the same in any order, so reruns take the same steps.
        exact = lambda term: F.sum(term.cast("decimal(38,12)")).cast("double")
        sums = joined.groupBy("key").agg(
            exact(words * F.least(rate, F.lit(float(most)))).alias("got"),
            exact(F.when(rate < most, words * rate * x).otherwise(F.lit(0.0))).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > F.col("__low")) & (newton < F.col("__high"))
        moved = (
            state.join(sums, "key", "left")
            .withColumns({"__low": low, "__high": high})
            .withColumn("__tilt", F.when(inside, newton).otherwise((F.col("__low") + F.col("__high")) / 2))
            .withColumn("__off", F.try_divide(F.abs(F.col("got") - F.col("target")), F.col("target")))
        )
        fresh = F.col("got").isNotNull()
        close = F.col("__off") <= TOLERANCE
        state = cut(
            moved.select(
                *sources.columns,
                F.when(fresh & ~close, F.col("__tilt")).otherwise(F.col("tilt")).alias("tilt"),
                *[F.when(fresh, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("low", "high", "off")],
            )
        )
        if not state.filter(F.col("off") > TOLERANCE).limit(1).count():
            break
    return state.select(*sources.columns, "tilt")


def _decisions(rows: DataFrame, found: DataFrame, most: int, seed: int) -> DataFrame:
    """`rows` (doc_id, key, size, ...) with what the plan so far says of each document."""
    rate = F.when((F.col("size") == 0) | (F.col("target") == 0), F.lit(0.0)).when(F.col("full"), F.lit(float(most)))
    rate = rate.otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("size_scale")), F.lit(float(most))))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    rest = F.col("rate") - F.col("whole")
    return (
        join_checked(rows, found, "key")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        # Taken once more are those with the least edge; without a rest there is nothing to round up.
        .withColumn("edge", F.when(rest > 0, chance - rest))
        .withColumn("notch", F.floor((F.col("edge") + 1) * (NOTCHES // 2)))
        .withColumn("mark", F.when(F.col("edge").isNotNull(), F.struct("edge", "doc_id", "size")))
    )


def plan(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 20
) -> DataFrame:
    """One row for each source: its target, its tilt, and which documents are rounded up.

    `weights` go to the sources in code point order and repeat; `share` is the size of the mix by that of
    all documents; no document is taken more than `most` times.
    """
    rows = cut(docs.select("doc_id", "source", source_key().alias("key"), word_count(F.col("text")).alias("size")))
    sources = cut(targets(rows, weights, share, most))
    histogram = cut(rows.filter("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    found = cut(tilts(histogram, sources, most))
    rated = _decisions(rows.drop("source"), found.drop("source"), most, seed)
    rated = cut(rated.select("key", "size", "target", "whole", "notch", "mark"))
    stops = cut(_stops(rated))
    # The few documents of a source in its last notch are put in order.
    upto = Window.partitionBy("key").orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = join_checked(rated, stops, "key").filter(F.col("notch") == F.col("stop"))
    last = last.withColumn("used", F.sum("size").over(upto)).filter(F.col("used") <= F.col("room"))
    last = last.groupBy("key").agg(F.max("mark").alias("upto"), F.max("used").alias("used"))
    missing = F.col("room") - F.coalesce("used", F.lit(0))
    ends = cut(join_checked(stops, cut(last), "key", "left").select("key", "stop", "upto", missing.alias("missing")))
    spare = join_checked(rated, ends, "key").filter(F.col("mark").isNotNull() & ~_rounded_up())
    gap = F.abs(F.col("size") - F.col("missing"))
    nearest = spare.groupBy("key").agg(F.min(F.struct(gap.alias("gap"), "mark", "missing")).alias("near"))
    nearest = nearest.filter("near.gap < near.missing").select("key", F.col("near.mark").alias("also"))
    return cut(found.join(ends, "key", "left").join(nearest, "key", "left").drop("missing"))


def _rounded_up() -> Column:
    before = (F.col("notch") < F.col("stop")) | ((F.col("notch") == F.col("stop")) & (F.col("mark") <= F.col("upto")))
    return F.coalesce(before, F.lit(False))


ADDED = ["size", "source_size", "target", "taken", "rate", "copies"]


def apply(docs: DataFrame, sources: DataFrame, most: int = 2, seed: int = 20) -> DataFrame:
    """The rows of `docs` with size, source_size, target, taken, rate and copies in place of columns of these names."""
    held = [c for c in docs.columns if c.lower() not in ADDED]
    return _applied(docs, held, sources, most, seed).select("row.*", *ADDED)


def _applied(docs: DataFrame, held: list[str], sources: DataFrame, most: int, seed: int) -> DataFrame:
    """The columns `held` of `docs` as one struct `row`, and the added columns beside it."""
    packed = docs.select(
        F.struct(*held).alias("row"), "doc_id", source_key().alias("key"), word_count(F.col("text")).alias("size")
    )
    once_more = _rounded_up() | F.coalesce(F.col("mark") == F.col("also"), F.lit(False))
    decided = _decisions(packed, sources.drop("source"), most, seed)
    decided = decided.withColumn("copies", (F.col("whole") + once_more.cast("long")).cast("int"))
    taken = (F.col("copies") * F.col("size")).cast("long")
    return decided.withColumn("taken", taken).select("row", *ADDED)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies: how many words of each document the mix takes."""
    mixed = apply(docs.select("doc_id", "source", "text"), plan(docs, weights, share, most), most)
    return mixed.drop("source", "text")


def take(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: the rows of `docs` as they are, each as often as it is taken."""
    mixed = _applied(docs, docs.columns, plan(docs, weights, share, most), most, seed=20)
    times = F.explode(F.sequence(F.lit(1), "copies")).alias("turn")
    return mixed.filter("copies > 0").select("row", times).select("row.*")


def _stops(rated: DataFrame) -> DataFrame:
    """For each source the notch in which its words meet the target, and the room left for that notch.

    Words are summed up over bands of notches and within each band, so no task has all notches of a source.
    """
    by_notch = cut(
        rated.withColumn("taken", F.col("whole") * F.col("size"))
        .groupBy("key", "notch")
        .agg(F.sum("taken").alias("taken"), F.sum("size").alias("words"), F.first("target").alias("target"))
    )
    needs = by_notch.groupBy("key").agg((F.round(F.first("target")).cast("long") - F.sum("taken")).alias("need"))
    rows = by_notch.filter("notch is not null").select("key", "notch", F.floor(F.col("notch") / BAND).alias("band"), "words")
    over = Window.partitionBy("key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("key", "band").agg(F.sum("words").alias("words"))
    bands = bands.select("key", "band", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "band").orderBy("notch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("words").over(within)).join(bands, ["key", "band"])
    needs = cut(needs)
    placed = join_checked(summed, needs, "key").withColumn("upto", F.col("before") + F.col("upto"))
    room = F.col("need") - F.col("upto") + F.col("words")
    found = (
        placed.filter(F.col("upto") >= F.col("need"))
        .groupBy("key")
        .agg(F.min(F.struct("notch", room.alias("room"))).alias("at"))
    )
    # A source whose rounded rates all stay below the target takes all that can be rounded up.
    return needs.join(found, "key", "left").select(
        "key", F.coalesce("at.notch", F.lit(NOTCHES + 1)).alias("stop"), F.coalesce("at.room", F.lit(0)).alias("room")
    )
