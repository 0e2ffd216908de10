"""Similarity of embeddings and fusion of rankings (planned in the reference, not built there)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], n: int = 10) -> DataFrame:
    """The n vectors of highest cosine with a query; a top-n, no full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", cosine(F.col("embedding"), q)).orderBy(F.desc("similarity"), "vec_id").limit(n)


def fused(rankings: DataFrame, k: int = 60) -> DataFrame:
    """rankings(ranking, id, score) by reciprocal ranks: the sum of 1 / (k + place) over the rankings."""
    place = F.row_number().over(W.partitionBy("ranking").orderBy(F.desc("score"), "id"))
    return rankings.withColumn("p", place).groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("p"))).alias("score"))
