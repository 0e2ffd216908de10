"""Mutations as next snapshots: each takes the tables as they are and returns them as they will be.

Parquet has no update in place; a mutation is a plan over the old snapshot and the changes, written as a new
version by `Snapshots`. Keys are compared by equi-joins; nothing is collected.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("unverified", "verified", "suspicious", "fabricated", "error")
ACCESS = ("unknown", "open-access", "subscription")


def insert_if_absent(citations: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Incoming(seq, doi, ...) rows of new DOIs as they are to be added, first writer first; ids continue.

    Known DOIs keep their row. Empty DOIs are an error of the row and are left out; empty texts and year 0 are
    stored as null.
    """
    first = W.partitionBy("doi").orderBy("seq")
    rows = incoming.where("doi is not null and doi <> ''").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    rows = rows.join(citations.select("doi"), "doi", "left_anti")
    kinds = dict(citations.dtypes)
    top = citations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # Ids follow the order of arrival: a running count within ranges of seq, and over the ranges.
    rows = rows.withColumn("_range", F.floor(F.col("seq") / 10_000))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    nth = F.row_number().over(W.partitionBy("_range").orderBy("seq"))
    rows = rows.withColumn("_in", nth).join(sizes, "_range").join(F.broadcast(top))
    rows = rows.withColumn("id", (F.col("_top") + F.col("_base") + F.col("_in")).cast(kinds["id"]))
    out = []
    for c in citations.columns:
        if c in ("id", "doi"):
            out.append(F.col(c))
        elif c in ("created_at", "updated_at"):
            out.append(F.lit(now).cast(kinds[c]).alias(c))
        elif c == "verification_status":
            out.append(F.lit("unverified").alias(c))
        elif c == "access_type":
            out.append(F.lit("unknown").alias(c))
        elif c not in incoming.columns:
            out.append(F.lit(None).cast(kinds[c]).alias(c))
        elif kinds[c] == "string":
            out.append(F.nullif(F.col(c), F.lit("")).alias(c))
        else:
            out.append(F.nullif(F.col(c), F.lit(0)).cast(kinds[c]).alias(c))
    return rows.select(*out)


def upsert_manifestations(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new(citation_id, kind, path, ...): a known (citation, kind, path) is seen again, and a null never
    replaces a value; unknown ones get ids after the highest."""
    key = ["citation_id", "kind", "path"]
    value = [c for c in old.columns if c not in (*key, "id", "created_at") and c in new.columns]
    known = old.join(new.select(*key, *[F.col(c).alias(f"_{c}") for c in value], F.lit(True).alias("_hit")), key, "left")
    known = known.select(*[F.coalesce(f"_{c}", c).alias(c) if c in value else F.col(c) for c in old.columns])
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = new.join(old.select(*key), key, "left_anti")
    # Ids follow the order of keys: a running count within a citation, and over the citations' counts by ranges of them.
    sizes = fresh.groupBy("citation_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.floor(F.col("citation_id") / 10_000))
    ranges = sizes.groupBy("_range").agg(F.sum("_n").alias("_m"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_m").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_range").orderBy("citation_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_in", inside).join(ranges, "_range").select("citation_id", (F.col("_in") + F.col("_below")).alias("_base"))
    nth = F.row_number().over(W.partitionBy("citation_id").orderBy("kind", "path"))
    fresh = fresh.withColumn("_nth", nth).join(sizes, "citation_id").join(F.broadcast(top))
    kinds = dict(old.dtypes)
    fresh = fresh.select(*[(F.col("_top") + F.col("_base") + F.col("_nth")).cast(kinds[c]).alias(c) if c == "id" else F.col(c) if c in new.columns else (F.col("last_seen_at") if c == "created_at" else F.lit(None).cast(kinds[c])).alias(c) for c in old.columns])
    return known.unionByName(fresh)


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks with those of new's manifestations replaced."""
    return chunks.join(new.select("manifestation_id").distinct(), "manifestation_id", "left_anti").select(*chunks.columns).unionByName(new)


def updated(citations: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """citations with the columns of changes(doi, ...) where these are not null, and updated_at."""
    names = [c for c in changes.columns if c != "doi"]
    joined = citations.join(changes.select("doi", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_hit")), "doi", "left")
    out = []
    for c in citations.columns:
        if c in names:
            out.append(F.coalesce(f"_{c}", c).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit"), F.lit(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def pdf_path_set(citations: DataFrame, manifestations: DataFrame, paths: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after paths(doi, pdf_path) are recorded: in the legacy column, and as PDF manifestations."""
    own = citations.select("id", "doi").join(paths, "doi")
    new = own.select(F.col("id").alias("citation_id"), F.lit("pdf").alias("kind"), F.col("pdf_path").alias("path"), F.lit(now).alias("last_seen_at"))
    return updated(citations, paths, now), upsert_manifestations(manifestations, new)


def attempts_logged(log: DataFrame, citations: DataFrame, attempts: DataFrame, now: str) -> DataFrame:
    """log and attempts(seq, doi, source, success, ...) of known DOIs, with ids after the highest in order of seq."""
    own = attempts.join(citations.select(F.col("id").alias("citation_id"), "doi"), "doi")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    own = own.withColumn("_range", F.floor(F.col("seq") / 10_000))
    sizes = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = own.withColumn("_nth", F.row_number().over(W.partitionBy("_range").orderBy("seq"))).join(sizes, "_range").join(F.broadcast(top))
    kinds = dict(log.dtypes)
    made = {"id": F.col("_top") + F.col("_base") + F.col("_nth"), "created_at": F.lit(now)}
    return log.unionByName(own.select(*[(made[c] if c in made else F.col(c) if c in own.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in log.columns]))


def downloads_recorded(citations: DataFrame, manifestations: DataFrame, log: DataFrame, results: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after results(seq, doi, source, pdf_path, access_type), a path for each download and null for a
    failure: paths, access and status of what was downloaded, and an attempt each. Commit all three as one version."""
    got = results.where("pdf_path is not null")
    citations, manifestations = pdf_path_set(citations, manifestations, got.select("doi", "pdf_path"), now)
    known = updated(citations, got.select("doi", "access_type", F.lit("verified").alias("verification_status")), now)
    attempts = results.select("seq", "doi", "source", F.col("pdf_path").isNotNull().alias("success"))
    return known, manifestations, attempts_logged(log, citations, attempts, now)


def invalid_rows(citations: DataFrame) -> DataFrame:
    """Rows that break the checks on status and access."""
    return citations.where(~F.col("verification_status").isin(*STATUSES) | ~F.col("access_type").isin(*ACCESS))


def cascade(rows: DataFrame, citations: DataFrame, key: str = "citation_id") -> DataFrame:
    """rows whose citation still exists."""
    return rows.join(citations.select(F.col("id").alias(key)), key, "left_semi").select(*rows.columns)


def to_index(manifestations: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """Manifestations whose content or chunker changed since they were indexed, or that never were."""
    same = state.where(F.col("chunker_version") == version).select("manifestation_id", "content_hash")
    rows = manifestations.withColumn("manifestation_id", F.col("id"))
    return rows.join(same, ["manifestation_id", "content_hash"], "left_anti").select(*manifestations.columns)


class Conflict(RuntimeError):
    """Another writer committed a version first; what was to be written is computed from an old one."""


class Snapshots:
    """Versioned Parquet tables in a folder that Spark reaches.

    A table is dealt by a hash of its key to BUCKETS folders; a version names the folder of every bucket of every
    table. `commit` replaces whole tables and `change` the touched buckets only; both write new folders first and then
    create the version's log entry, which fails if another writer has created it: nothing is overwritten, readers see
    a version only when all of it is there, and tables that a commit does not touch stay as they are.
    """

    BUCKETS = 32

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, version: int) -> str:
        return f"_log/{version:020d}.json"

    def version(self) -> int:
        files, log = self._files(), self._path("_log")
        if not files.exists(log):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(log) if f.getPath().getName().endswith(".json") and f.getLen()), default=0)

    def state(self, version: int | None = None) -> dict:
        """Table -> its schema, key and the folder of each bucket."""
        v = self.version() if version is None else version
        if not v:
            return {}
        stream = self._files().open(self._path(self._entry(v)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return name in self.state()

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        table = self.state(version)[name]
        paths = [p for b, p in table["parts"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(table["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def _bucket(self, key: str | None) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.BUCKETS)).cast("int") if key else F.lit(0)

    def _written(self, name: str, rows: DataFrame, key: str | None, sort: list[str]) -> dict[str, str]:
        """The new folder of each bucket that rows have."""
        folder = f"{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(key))
        if sort:
            dealt = dealt.sortWithinPartitions("_bucket", *sort)
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        found = [f.getPath().getName() for f in self._files().listStatus(self._path(folder)) if f.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith("_bucket=")}

    def _commit(self, base: int, state: dict) -> int:
        try:
            out = self._files().create(self._path(self._entry(base + 1)), False)
        except Exception as e:  # noqa: BLE001  the file system says why
            if self.version() > base:
                raise Conflict(f"version {base + 1} is taken") from e
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return base + 1

    def commit(self, *, keys: dict[str, str] | None = None, sort: dict[str, list[str]] | None = None, base: int | None = None, **tables: DataFrame) -> int:
        """Replaces whole tables; keys: the column by which a table is dealt. base: the version that the tables were computed from."""
        base = self.version() if base is None else base
        state = self.state(base)
        for name, rows in tables.items():
            key = (keys or {}).get(name, state.get(name, {}).get("key"))
            order = (sort or {}).get(name, state.get(name, {}).get("sort", []))
            state[name] = {"schema": json.loads(rows.schema.json()), "key": key, "sort": order, "parts": self._written(name, rows, key, order)}
        return self._commit(base, state)

    def change(self, touched: dict[str, DataFrame], rows: Callable[[str, DataFrame], DataFrame], base: int | None = None) -> int:
        """Rewrites the buckets of tables' touched keys (a column of the key's name): rows(name, old rows of those buckets).

        At most BUCKETS numbers a table reach the driver.
        """
        base = self.version() if base is None else base
        state = self.state(base)
        for name, keys in touched.items():
            table = state[name]
            hit = [r[0] for r in keys.select(self._bucket(table["key"]).alias("b")).distinct().collect()]
            if hit:
                new = rows(name, self.read(name, base, hit))
                parts = self._written(name, new, table["key"], table["sort"])
                table["parts"] = {b: p for b, p in table["parts"].items() if int(b) not in hit} | parts
        return self._commit(base, state)

    def migrated(self, steps: dict[int, Callable[[Snapshots], None]]) -> int:
        """Runs the steps above the store's schema version in order, each once, and notes the last; returns it."""
        at = self.read("_schema").first()[0] if self.has("_schema") else 0
        for n in sorted(k for k in steps if k > at):
            steps[n](self)
            self.commit(_schema=self.spark.createDataFrame([(n,)], "version int"))
            at = n
        return at
