"""The driver's tables as a bibliography: the same expressions serve Spark and the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY = "'2024-01-' || lpad(cast(1 + doc_id % 28 as string), 2, '0') || 'T00:00:00.000Z'"
CITATIONS = {
    "id": "doc_id",
    "doi": "'10.' || cast(1000 + doc_id % 7 as string) || '/' || source || '.' || cast(doc_id as string)",
    "url": "case when doc_id % 5 = 0 then null else 'https://example.org/' || cast(doc_id as string) end",
    "title": "substring(split_part(text, chr(10), 1), 1, 80)",
    "authors": "source || ' Smith and ' || lang",
    "year": "cast(1990 + doc_id % 30 as int)",
    "journal": "lang",
    "bibtex_key": "source || cast(doc_id as string)",
    "pdf_path": "case when doc_id % 3 = 0 then '/old/' || cast(doc_id as string) || '.pdf' end",
    "verification_status": "case when doc_id % 4 = 0 then 'verified' when doc_id % 4 = 1 then 'suspicious' else 'unverified' end",
    "access_type": "case when doc_id % 2 = 0 then 'open-access' else 'unknown' end",
    "created_at": _DAY,
    "updated_at": _DAY,
}
#: Files: two of each order's part lines stand for versions of a citation's files.
MANIFESTATIONS = {
    "id": "(l_orderkey * 1000000 + l_partkey * 8 + l_linenumber) * 100 + cast(l_quantity as int)",
    "citation_id": "l_orderkey % 500",
    "kind": "case when l_linenumber % 2 = 0 then 'pdf' else 'markdown-extracted' end",
    "path": "'/files/' || cast(l_partkey as string) || '.' || cast(l_linenumber as string)",
    "content_hash": "case when l_linenumber % 3 = 0 then null else cast(l_suppkey as string) end",
    "last_seen_at": "cast(l_quantity as int)",
}
CHUNKS = {
    "manifestation_id": "conv_id",
    "citation_id": "conv_id % 100",
    "ordinal": "turn",
    "section": "role",
    "text": "text",
    "content_hash": "cast(conv_id % 7 as string)",
    "chunker_version": "cast(1 + conv_id % 2 as int)",
}
LOG = {
    "id": "event_id",
    "citation_id": "user_id",
    "source": "event_type",
    "success": "event_id % 3 <> 0",
    "duration": "value",
    "created_at": "event_id % 97",
}
_TABLES = {"citations": ("documents", CITATIONS), "manifestations": ("lineitem", MANIFESTATIONS), "chunks": ("conversations", CHUNKS), "retrieval_log": ("events", LOG)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one of the bibliography's."""
    if name not in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table, columns = _TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def wide(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it comes in fewer: one small file is one task, which would keep the
    text work on one core. Larger tables stay as they are read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def ctes(*names: str) -> str:
    """The same tables as common table expressions."""
    return ", ".join(f"{n} as (select {', '.join(f'{e} as {c}' for c, e in _TABLES[n][1].items())} from {_TABLES[n][0]})" for n in names)
