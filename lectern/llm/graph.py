"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(src, dst); nodes have one root if they are connected.

    Each round hooks every node to the neighbour (or itself) of least random rank and contracts the
    graph along the hooks, so the number of nodes falls by a constant factor whatever the shape of the
    graph. A round is one aggregation with map-side combine and two equi-joins; all tables stay
    distributed and each round's tables are written to the shared folder. Nulls and self-loops are no
    edges; repeated edges count once; without edges the result is empty.
    """
    e = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    e = written(e.where("a <> b").distinct())
    levels: list[DataFrame] = []
    while not e.isEmpty():
        rank = len(levels)
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        rated = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rank)).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        hook = both.groupBy("node").agg(F.min(rated("v")).alias("m"))
        hook = written(hook.select("node", F.least(F.col("m"), rated("node"))["v"].alias("root")))
        levels.append(hook)
        x = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        y = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(x, "a").join(y, "b").where("ra <> rb")
        e = written(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels.pop()
    while levels:
        up = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = levels.pop().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
