"""What is planned around the library: search filters, the citation graph, and evaluation of verdicts on claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(citations: DataFrame, years: tuple[int | None, int | None] = (None, None), statuses: list[str] | None = None, access: list[str] | None = None, has_pdf: bool | None = None) -> DataFrame:
    """Citations of a range of years (ends included), of some statuses and kinds of access, with or without a PDF."""
    keep = F.lit(True)
    if years[0] is not None:
        keep = keep & (F.col("year") >= years[0])
    if years[1] is not None:
        keep = keep & (F.col("year") <= years[1])
    if statuses:
        keep = keep & F.col("verification_status").isin(statuses)
    if access:
        keep = keep & F.col("access_type").isin(access)
    if has_pdf is not None:
        keep = keep & (F.coalesce(F.col("pdf_path") != "", F.lit(False)) == F.lit(has_pdf))
    return citations.where(keep)


def links(references: DataFrame, citations: DataFrame) -> DataFrame:
    """Edges (citing, cited) of references(citation_id, doi) to citations that are there; each once, none to itself."""
    known = citations.select(F.col("id").alias("cited"), "doi")
    return references.join(known, "doi").where("citation_id <> cited").select(F.col("citation_id").alias("citing"), "cited").distinct()


def counts(edges: DataFrame) -> DataFrame:
    """(id, n_references, n_citing) of every citation with an edge."""
    both = edges.select(F.col("citing").alias("id"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionAll(edges.select("cited", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("r").alias("n_references"), F.sum("c").alias("n_citing"))


def related(edges: DataFrame, asked: DataFrame, n: int = 5) -> DataFrame:
    """(id, other, shared, place): for each of asked(id), the n citations that share most references with it.

    Only the asked citations' references are met with all others', by an equi-join on the reference.
    """
    from pyspark.sql import Window as W

    own = edges.join(asked.select(F.col("id").alias("citing")), "citing", "left_semi").select(F.col("citing").alias("id"), "cited")
    shared = own.join(edges.withColumnRenamed("citing", "other"), "cited").where("id <> other").groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("shared"), "other"))
    return shared.withColumn("place", place).where(F.col("place") <= n)


def frontier(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of the citations that some of start(id) reach over references in at most `hops` steps, by their least."""
    out = start.select("id", F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        step = out.where(F.col("hop") == hop - 1).join(edges, out["id"] == edges["citing"]).select(F.col("cited").alias("id")).distinct()
        out = out.unionAll(step.join(out.select("id"), "id", "left_anti").select("id", F.lit(hop)))
    return out


def accuracy(results: DataFrame) -> DataFrame:
    """(system, n, n_right, accuracy) of results(claim_id, system, right)."""
    return results.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_right"), F.avg(F.col("right").cast("double")).alias("accuracy"))


def mcnemar(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row: claims that only a, and only b, has right, and McNemar's statistic with continuity correction (0 without
    any)."""
    right = lambda s: F.bool_or((F.col("system") == s) & F.col("right"))
    both = results.where(F.col("system").isin(a, b)).groupBy("claim_id").agg(right(a).alias("a"), right(b).alias("b"), F.countDistinct("system").alias("k")).where("k = 2")
    out = both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return out.withColumn("statistic", F.when(n > 0, gap * gap / n).otherwise(0.0))


def bootstrap(results: DataFrame, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """(system, low, high): percentile interval of the accuracy over resampled claims.

    A claim's weight in a round is a Poisson(1) number drawn from a hash of claim and round, so that claims are resampled
    where they are and reruns agree.
    """
    u = F.pmod(F.xxhash64("claim_id", "round"), F.lit(1 << 52)) / float(1 << 52)
    cuts, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        cuts.append(total)
        term /= k + 1
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    drawn = results.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight)
    per = drawn.groupBy("system", "round").agg((F.sum(F.when(F.col("right"), F.col("w")).otherwise(0)) / F.greatest(F.sum("w"), F.lit(1))).alias("accuracy"))
    side = (1 - level) / 2
    return per.groupBy("system").agg(F.percentile("accuracy", F.lit(side)).alias("low"), F.percentile("accuracy", F.lit(1 - side)).alias("high"))
