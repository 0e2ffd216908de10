"""Shared plumbing of the operators: reading tables, cutting lineage, shipping code, batches of text."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Maps every byte that is no letter, digit or part of a non-ASCII character to a space, and A-Z to a-z.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer partitions than there are cores (one small file) are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if name in ("documents", "pages") and df.rdd.getNumPartitions() < n else df


def session(df: DataFrame) -> SparkSession:
    """The session of a DataFrame, with this library importable in its Python workers."""
    spark = df.sparkSession
    root = Path(__file__).resolve().parents[2]
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc = spark.sparkContext
        if not getattr(sc, "_lectern_shipped", False):
            to = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern.zip"
            with zipfile.ZipFile(to, "w") as z:
                for p in sorted((root / "lectern").rglob("*.py")):
                    z.write(p, p.relative_to(root))
            sc.addPyFile(str(to))
            sc._lectern_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode) a temporary one."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        sc.setCheckpointDir(set_to)
    return set_to


_written: list[tuple[SparkSession, str, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path, name in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            if name:
                spark.sql(f"drop table if exists {name}")
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing needs any more, which it does once the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, bucket: tuple[int, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and any executor can read it again.

    bucket: (n, column) deals the table into n buckets, so that grouping by the column needs no shuffle of it.
    """
    spark, schema = df.sparkSession, df.schema
    name = f"lectern_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    if bucket:
        df.write.format("parquet").bucketBy(*bucket).option("path", path).saveAsTable(name)
    else:
        df.write.parquet(path)
    _written.append((spark, path, name if bucket else ""))
    return spark.table(name) if bucket else spark.read.schema(schema).parquet(path)


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """df's rows as one column `row`, beside the kept columns and two hashes of the whole row, `m1` and `m2`.

    Operators add columns of their own beside `row`, whatever names df's columns have. Rows of equal hashes are
    taken for identical (128 bits); as the hashes are plain join keys, a table is shuffled once for what follows.
    """
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*keep, F.xxhash64(*hashed).alias("m1"), F.xxhash64(F.lit(1), *hashed).alias("m2"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def numbered(df: DataFrame, *keep: str) -> DataFrame:
    """df with all columns but the kept ones named by number, so that no name clashes with an operator's own."""
    return df.toDF(*[c if c in keep else f"c{k}" for k, c in enumerate(df.columns)])


def one_of_each(marked: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of marked(m1, m2, row) that kept(m1, m2) names, one of each name, unpacked."""
    rows = marked.select("m1", "m2", "row").join(kept, ["m1", "m2"], "left_semi")
    nth = F.row_number().over(W.partitionBy("m1", "m2").orderBy(F.lit(0)))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def text_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text as UTF-8 bytes in column _t (null: empty)."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_t"))


def byte_lists(batch: pa.RecordBatch, name: str = "_t") -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def pieces(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about `most` bytes in all; an item is never split."""
    start = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


def take(batch: pa.RecordBatch, names: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch followed by new ones."""
    cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*cols, *extra.values()], [*names, *extra])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i], the smallest node of each node's component."""
    label = np.arange(n)
    while a.size:
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
