"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a schedule: its share of the words trained at time t of [0, 1] is
proportional to target * (1 + tilt * (2t - 1)), which integrates to the target. Cumulative demand until t is
target * ((1 - tilt) t + tilt t^2). A source's documents queue in the order of a hash of their ids, again from
the start when the queue is used up; the document at place x of the queue (in words) is trained when the
demand reaches x, so inverting the demand gives its position. Rows are range-sorted by position.

Only DataFrame functions run here. Identical rows are one row that counts several times. Running sums over a
source's queue are taken in two steps, within ranges of the queue's order and over the ranges' sums, so a source
with most of the rows spreads over many tasks; ranges are cut by hash, id, size and row hash, so that rows without
an id, or with one id, spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, written

#: Weights of the sources by rank, repeating; tilts likewise (late, even, early).
WEIGHTS = (3, 1, 2)
TILTS = (0.5, 0.0, -0.5)
#: Rows of a range of the queues, and ranges at most (larger ones beyond it).
ROWS_A_RANGE = 1 << 14
MOST_RANGES = 20_000
QUEUE = ("key", "doc_id", "size", "m1", "m2")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, factor: float = 1.5, most: int = 2) -> DataFrame:
    """(source, weight, tilt, source_size, target) for each source of sizes(source, size).

    Sources in order of code points, a null source last, have the weights 3, 1, 2, repeating. They share
    `factor` of all sizes by weight; a target stops at `most` times its source's size, and the excess is shared
    again by weight until none is above. That level is found at once: with sources in order of the ratio of
    bound to weight, those before the first that stays within its share are at their bound (later levels are only lower). Sources without
    words have target 0. One row a source is gathered, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int")).cast(kind)
    ranked = per.withColumn("rank", rank).withColumns({"weight": pick(WEIGHTS, "long"), "tilt": pick(TILTS, "double")})
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    bound = F.col("source_size") * most
    every = W.partitionBy()
    level = (
        ranked.withColumn("before", F.coalesce(F.sum(bound).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") * factor - F.col("before")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= bound, F.col("level"))).over(every))
    )
    share = F.least(F.col("level") * F.col("weight"), bound.cast("double"))
    return level.select("source", "weight", "tilt", "source_size", F.coalesce(share, bound.cast("double")).alias("target"))


def _queue(rows: DataFrame) -> DataFrame:
    """rows(source, size, n, ...) with `place`, the words of the source's rows that come before in order of QUEUE."""
    ranges = min(MOST_RANGES, rows.count() // ROWS_A_RANGE + 1)
    cut = written(rows.repartitionByRange(ranges, *QUEUE).withColumn("range", F.spark_partition_id()))
    words = F.col("size") * F.col("n")
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("source", "range").agg(F.sum(words).alias("words"))
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("source", "range").orderBy(*QUEUE).rowsBetween(W.unboundedPreceding, -1)
    own = cut.withColumn("place", F.coalesce(F.sum(words).over(inner), F.lit(0)))
    joined = own.join(sums, own["source"].eqNullSafe(sums["s"]) & (own["range"] == sums["r"]))
    return joined.withColumn("place", F.col("place") + F.col("base")).drop("s", "r", "base", "range")


def _each(rows: DataFrame) -> DataFrame:
    """A row for each of the n that rows(n, size, place, ...) stand for, one behind the other."""
    some = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 65536")))).withColumn("first", F.col("j") * 65536)
    one = some.withColumn("i", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + 65536) - 1)))
    return one.withColumn("place", F.col("place") + F.col("i") * F.col("size")).drop("i", "j", "first")


def _position(x: Column, target: Column, tilt: Column) -> Column:
    """The time at which the cumulative demand of a source is x."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / target))
    even = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)
    return F.when(target > 0, 2 * share / ((1 - tilt) + even))


def positions(docs: DataFrame, factor: float = 1.5, most: int = 2) -> DataFrame:
    """docs' columns but text, and size, source_size, target, copies, positions.

    One row for each row of docs(doc_id, source, text, ...), range-sorted by first position (rows that the
    mix leaves out come last). positions is an array with the training time of each copy. A copy is taken if
    the queue's place at its middle is within the target, so a source's words come within one document of its
    target, and no document is taken more than `most` times. Repeated rows queue one behind the other, and rows of
    one id by size and hash; null or empty texts have size 0, take part with no words, and get a position as any
    other; a null source is a source, a null doc_id an id. No rows give no rows. Where docs has a column of a new
    name, the new one's name ends in an underscore.
    """
    bare = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    names = {}
    for new in ("size", "source_size", "target", "copies", "positions"):
        names[new] = new
        while names[new].lower() in {c.lower() for c in bare.columns}:
            names[new] += "_"
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = packed(docs, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    rows = rows.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in bare.columns]))
    rows = written(rows.groupBy("source", *QUEUE).agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n")))
    sizes = rows.select("source", (F.col("size") * F.col("n")).alias("size"))
    goals = written(source_targets(sizes, factor, most)).select(F.col("source").alias("s"), "tilt", "source_size", "target")
    queued = _queue(rows)
    joined = _each(queued.join(goals, queued["source"].eqNullSafe(goals["s"])).drop("s"))
    taken = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col("place") + F.col("source_size") * k + F.col("size") / 2 <= F.col("target"))
    at = F.transform(taken, lambda k: _position(F.col("place") + F.col("source_size") * k + F.col("size") / 2, F.col("target"), F.col("tilt")))
    at = F.when(F.col("target") > 0, at).otherwise(F.expr("array()").cast("array<double>"))
    out = joined.withColumn("positions", at).withColumn("copies", F.size("positions")).withColumn("at", F.get("positions", F.lit(0)))
    order = (F.col("at").asc_nulls_last(), "doc_id", "m1")
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*", *[F.col(old).alias(new) for old, new in names.items()])


def mixed(docs: DataFrame, factor: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as it is taken, range-sorted by training position."""
    marked = packed(docs, "doc_id", "source", "text")
    at = positions(marked.select("doc_id", "source", "text", "m1", "m2"), factor, most)
    copies = at.select("m1", "m2", F.explode("positions").alias("at"))
    # Identical rows are interchangeable, so their copies are shared out once each.
    rows = marked.select("m1", "m2", "row").dropDuplicates(["m1", "m2"]).join(copies, ["m1", "m2"])
    return rows.repartitionByRange("at", "m1").sortWithinPartitions("at", "m1").select("row.*")
