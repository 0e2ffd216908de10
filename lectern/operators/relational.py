"""Citations, files, passages and the retrieval log: lookups, pages, sets and windows over them."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import like_any

SEARCHED = ("title", "authors", "journal", "bibtex_key", "doi")


def newest_first(citations: DataFrame) -> DataFrame:
    return citations.orderBy(F.desc("created_at"), F.desc("id"))


def by_doi(citations: DataFrame, doi: str) -> DataFrame:
    return citations.where(F.col("doi") == doi)


def latest_manifestation(manifestations: DataFrame) -> DataFrame:
    """The row of highest id for each citation and kind; one aggregation, map-side combined."""
    newest = F.max_by(F.struct(*[c for c in manifestations.columns if c not in ("citation_id", "kind")]), "id")
    return manifestations.groupBy("citation_id", "kind").agg(newest.alias("m")).select("citation_id", "kind", "m.*")


def with_pdf_path(citations: DataFrame, manifestations: DataFrame) -> DataFrame:
    """citations with pdf_path from the newest PDF manifestation, else the legacy column."""
    pdf = manifestations.where("kind = 'pdf'").groupBy("citation_id").agg(F.max_by("path", "id").alias("_path"))
    joined = citations.join(pdf, citations["id"] == pdf["citation_id"], "left")
    return joined.select(*[c for c in citations.columns if c != "pdf_path"], F.coalesce("_path", "pdf_path").alias("pdf_path"))


def passages(chunks: DataFrame, citation_id: int) -> DataFrame:
    return chunks.where(F.col("citation_id") == citation_id).orderBy("ordinal")


def index_state(chunks: DataFrame) -> DataFrame:
    """What each manifestation was indexed from: hash and version of its first passage."""
    first = F.min_by(F.struct("content_hash", "chunker_version"), "ordinal")
    return chunks.groupBy("manifestation_id").agg(first.alias("s")).select("manifestation_id", "s.*")


def log_of(citations: DataFrame, log: DataFrame, doi: str) -> DataFrame:
    """Attempts for a DOI, newest first; none for an unknown one."""
    own = by_doi(citations, doi).select(F.col("id").alias("citation_id"))
    return log.join(own, "citation_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id"))


# Pages


def encode_cursor(**parts: object) -> str:
    return base64.b64encode(json.dumps(parts, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str, *names: str) -> dict:
    try:
        got = json.loads(base64.b64decode(cursor, validate=True))
        return {n: got[n] for n in names}
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor") from e


def offset_of(cursor: str | None) -> int | None:
    """The offset of a cursor of ranked results; None for none and for a cursor of another kind."""
    try:
        return int(decode_cursor(cursor, "offset")["offset"]) if cursor else None
    except ValueError:
        return None


def cursor_column(created_at: Column, id_: Column) -> Column:
    return F.base64(F.to_json(F.struct(created_at.alias("createdAt"), id_.alias("id"))).cast("binary"))


def _limit(limit: int | None, most: int, default: int) -> int:
    return min(max(default if limit is None else limit, 1), most)


def keyset_page(citations: DataFrame, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """The page after a cursor in order of (created_at, id), with next_cursor where more follows.

    One row more than the page is taken; only a top-n runs, never a full sort.
    """
    n = _limit(limit, 200, 50)
    rows = citations
    if cursor:
        at = decode_cursor(cursor, "createdAt", "id")
        after = (F.col("created_at") > at["createdAt"]) | (F.col("created_at") == at["createdAt"]) & (F.col("id") > at["id"])
        rows = rows.where(after)
    rows = rows.orderBy("created_at", "id").limit(n + 1)
    nth = F.row_number().over(W.orderBy("created_at", "id"))
    last = F.count(F.lit(1)).over(W.partitionBy()) > n
    return rows.withColumns({"_nth": nth, "_more": last}).where(F.col("_nth") <= n).withColumn(
        "next_cursor", F.when(F.col("_more") & (F.col("_nth") == n), cursor_column(F.col("created_at"), F.col("id")))
    ).drop("_nth", "_more")


def like_search(citations: DataFrame, query: str) -> DataFrame:
    """Rows with the query as a substring of any searched column."""
    return citations.where(like_any([F.col(c) for c in SEARCHED], query))


def offset_page(ranked: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of rows by (rank, id)."""
    n = _limit(limit, 200, 50)
    return ranked.orderBy("rank", "id").offset(max(0, offset)).limit(n)


def text_page(text: Column, offset: int = 0, size: int = 20_000) -> Column:
    """struct(text, next_offset) of a text from a character offset; next_offset is null at the end."""
    n = min(max(size, 1), 100_000)
    more = F.length(text) > offset + n
    return F.struct(F.substring(text, offset + 1, n).alias("text"), F.when(more, F.lit(offset + n)).alias("next_offset"))


# Predicates and sets


def matched_fields(query: str) -> Column:
    """Names of the fields that hold every lower-cased word of the query as a substring."""
    words = query.lower().split()
    fields = F.array(*[F.struct(F.lit(c).alias("name"), F.lower(F.coalesce(F.col(c), F.lit(""))).alias("value")) for c in SEARCHED])
    has = lambda f: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(f["value"], w))
    return F.transform(F.filter(fields, has if words else lambda f: F.lit(False)), lambda f: f["name"])


def stored_paths(citations: DataFrame, manifestations: DataFrame) -> DataFrame:
    """Every path that is recorded anywhere, once."""
    both = citations.select(F.col("pdf_path").alias("path")).union(manifestations.select("path"))
    return both.where("path is not null and path <> ''").distinct()


def row_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def histogram(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: total, and a count for each value."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(v.replace("-", "_")) for v in values])


def summary(citations: DataFrame) -> DataFrame:
    return citations.select("doi", "title", "year", "journal", "verification_status")


def hits_of(*parts: DataFrame) -> DataFrame:
    """The best (least) rank of each citation over several rankings."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("citation_id").agg(F.min("rank").alias("rank"))


def best_passages(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first n passages of each citation by rank."""
    nth = F.row_number().over(W.partitionBy("citation_id").orderBy("rank", "chunk_id"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= n)


