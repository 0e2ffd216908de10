"""The retrieval cascade's decisions over recorded outcomes, its circuit breaker, and second passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_stem, title_similarity
from .identity import LOOKUP_THRESHOLD, SEARCH_THRESHOLD, best_title

#: Stages in order; breaker trip and cooldown; retries.
STAGES = ("cache", "unpaywall", "semantic-scholar", "arxiv", "authenticated")
TRIP, COOLDOWN_MS = 3, 30_000
BASE_MS, MOST_MS = 1000, 30_000


def outcome_ok() -> Column:
    """Whether a stage's outcome(stage, ok, expected_title, upstream_title) counts: its title must be the entry's."""
    near = title_similarity(F.col("expected_title"), F.col("upstream_title"))
    return F.col("ok") & (
        F.when(F.col("stage") == "arxiv", F.coalesce(near >= SEARCH_THRESHOLD, F.lit(False)))
        .when((F.col("stage") == "semantic-scholar") & F.col("upstream_title").isNotNull() & F.col("expected_title").isNotNull(), near >= LOOKUP_THRESHOLD)
        .otherwise(True)
    )


def cascade(outcomes: DataFrame) -> DataFrame:
    """(doi, source, n_attempts, throttled): the first stage that succeeds for each DOI, null if none; attempts up to
    it; and whether a failure is worth another pass because a stage was throttled."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    rows = outcomes.withColumns({"_good": outcome_ok(), "_place": order}).where("_place > 0")
    won = F.min(F.when(F.col("_good"), F.col("_place"))).over(W.partitionBy("doi"))
    rows = rows.withColumn("_won", won).where("_won is null or _place <= _won")
    out = rows.groupBy("doi").agg(F.max("_won").alias("_won"), F.count(F.lit(1)).alias("n_attempts"), F.bool_or(F.coalesce("throttled", F.lit(False))).alias("_t"))
    return out.select("doi", F.when(F.col("_won").isNotNull(), F.element_at(F.array(*map(F.lit, STAGES)), F.col("_won").cast("int"))).alias("source"), "n_attempts", (F.col("_won").isNull() & F.col("_t")).alias("throttled"))


def second_pass(first: DataFrame, again: DataFrame) -> DataFrame:
    """first's results, those throttled replaced by again's: each is tried once more, no oftener."""
    redo = first.where("throttled").select("doi")
    return first.where("not throttled").unionByName(again.join(redo, "doi", "left_semi").withColumn("throttled", F.lit(False)))


def retry_delay_ms(attempt: Column, retry_after_s: Column) -> Column:
    """The wait before another try: what the service asks for, else doubling."""
    return F.least(F.coalesce(retry_after_s * 1000, F.pow(F.lit(2.0), attempt) * BASE_MS), F.lit(float(MOST_MS)))


def retryable(status: Column) -> Column:
    return status.isNull() | (status == 429) | (status >= 500)


def breaker_step(streak: int, until: int, ts_ms: int, outcome: str) -> tuple[int, int, bool]:
    """The breaker after an event, and whether the event was let through; until is -1 while it is closed."""
    if 0 <= until and ts_ms < until:
        return streak, until, False
    hit, probe = outcome == "429", until >= 0
    streak = streak + 1 if hit else 0
    return streak, ts_ms + COOLDOWN_MS if hit and (probe or streak >= TRIP) else -1, True


def breaker(events: DataFrame) -> DataFrame:
    """events(source, seq, ts_ms, outcome) with `allowed` and `state` after each: closed or open.

    Three answers of 429 in a row open a source's breaker for the cooldown, in which nothing is asked; then one probe
    may go: another 429 opens it again, any other answer closes it. A source's events stream in order through one
    task, which keeps two numbers; no source is gathered.
    """
    kinds = {c: t for c, t in events.dtypes if c in ("source", "seq")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, streak, until = object(), 0, -1
        for batch in batches:
            allowed, state = [], []
            for source, ts, outcome in zip(batch["source"], batch["ts_ms"], batch["outcome"]):
                if source != at:
                    at, streak, until = source, 0, -1
                streak, until, ok = breaker_step(streak, until, ts, outcome)
                allowed.append(ok)
                state.append("open" if until >= 0 else "closed")
            yield batch[["source", "seq"]].assign(allowed=allowed, state=state)

    rows = events.select("source", "seq", F.col("ts_ms").cast("long"), "outcome").repartition("source").sortWithinPartitions("source", "seq")
    return rows.mapInPandas(run, f"source {kinds['source']}, seq {kinds['seq']}, allowed boolean, state string")


def import_summary(results: DataFrame) -> DataFrame:
    """One row: counts by outcome of results(doi, inserted, source, skipped)."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("inserted")).alias("imported"),
        F.count_if(F.col("source").isNotNull()).alias("downloaded"),
        F.count_if(F.col("skipped")).alias("skipped"),
        F.count_if(F.col("source").isNull() & ~F.col("skipped")).alias("failed"),
    )


def import_issues(results: DataFrame) -> DataFrame:
    """(kind, doi, bibtex_key, reason) of the entries of results(doi, bibtex_key, source, skipped, reason) that were
    skipped or failed."""
    kind = F.when(F.col("skipped"), "skipped").when(F.col("source").isNull(), "failed")
    return results.withColumn("kind", kind).where("kind is not null").select("kind", "doi", "bibtex_key", "reason")


def cached(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(doi, path) of citations whose PDF is there: at its recorded path, else under its file stem in files(path, name)."""
    stem = F.concat(file_stem(F.col("bibtex_key"), F.col("doi")), F.lit(".pdf"))
    rows = citations.select("doi", "pdf_path", stem.alias("name"))
    recorded = rows.join(files.select(F.col("path").alias("pdf_path")).distinct(), "pdf_path", "left_semi").select("doi", F.col("pdf_path").alias("path"))
    named = rows.join(recorded, "doi", "left_anti").join(files.groupBy("name").agg(F.min("path").alias("path")), "name").select("doi", "path")
    return recorded.unionByName(named)


def arxiv_query(title: Column, broad: bool = False) -> Column:
    """A title as a phrase of arXiv's search: among titles, or (broad) anywhere and without punctuation."""
    text = F.regexp_replace(title, r"[^a-zA-Z0-9 ]+" if broad else '"', " ")
    phrase = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.concat(F.lit('all:"' if broad else 'ti:"'), phrase, F.lit('"'))


def arxiv_id(url: Column) -> Column:
    """An arXiv id in a URL, without its version."""
    return F.nullif(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/(.+?)(?:v\d+)?(?:\.pdf)?(?:[?#].*)?\z", 1), F.lit(""))


def two_step(strict: DataFrame, broad: DataFrame) -> DataFrame:
    """(doi, step, pos, actual, similarity) of the best title for each DOI among the strict search's answers or, where that
    has none, the broad one's; five of each at most are looked at. Both are (doi, pos, expected, actual)."""
    some = lambda rows, step: rows.where("pos < 5").withColumn("step", F.lit(step))
    first = some(strict, "strict")
    answers = first.unionByName(some(broad, "broad").join(first.select("doi").distinct(), "doi", "left_anti").select(*first.columns))
    return best_title(answers, "doi").select("doi", "step", "pos", "actual", "similarity")


#: Requests of a part, and parts, at most.
PART, MOST_PARTS = 50_000, 256


def _part_of(seq: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most seq; 0 for null. A tree of comparisons."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(seq < F.lit(cuts[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(seq.isNull(), 0).otherwise(among(0, len(cuts)))


def tickets(requests: DataFrame, interval_ms: int) -> DataFrame:
    """requests(source, seq, ts_ms) with `start_ms`: a serial limiter lets one request of a source start an interval.

    The n-th starts no sooner than an interval after the one before: the running maximum of ts - n * interval, plus
    n * interval. Requests (of a numeric seq) are cut into parts by seq, so that no task holds a source: each part counts
    and takes its maximum by itself, and starts from the sum and the maximum of the source's parts before it.
    """
    parts = min(MOST_PARTS, requests.count() // PART + 1)
    ranks = [k / parts for k in range(1, parts)]
    cuts = requests.agg(F.percentile_approx("seq", ranks, 10_000).alias("c")).first()["c"] if ranks else []
    rows = requests.withColumn("_part", _part_of(F.col("seq"), sorted(set(cuts or []))))
    own = W.partitionBy("source", "_part").orderBy("seq")
    rows = rows.withColumn("_n", F.row_number().over(own).cast("long") - 1)
    rows = rows.withColumn("_head", F.max(F.col("ts_ms") - F.col("_n") * interval_ms).over(own))
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    held = rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_held"), F.max("_head").alias("_most"))
    held = held.withColumn("_base", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    held = held.withColumn("_above", F.max(F.col("_most") - F.col("_base") * interval_ms).over(before))
    held = held.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), "_base", "_above")
    out = rows.join(held, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    start = F.greatest(F.col("_head") - F.col("_base") * interval_ms, F.col("_above")) + (F.col("_base") + F.col("_n")) * interval_ms
    return out.withColumn("start_ms", start).select(*requests.columns, "start_ms")


def progress(events: DataFrame) -> DataFrame:
    """events(entry_id, seq, stage, final) with `settled`, true exactly once an entry: at its first final event, if it has
    one; what follows that event is dropped."""
    first = F.min(F.when(F.col("final"), F.col("seq"))).over(W.partitionBy("entry_id"))
    rows = events.withColumn("_end", first).where("_end is null or seq <= _end")
    return rows.withColumn("settled", F.coalesce(F.col("seq") == F.col("_end"), F.lit(False))).drop("_end", "final")
