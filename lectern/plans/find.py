"""Full-text search over documents, their metadata as citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.porter import plain_terms
from ..operators import relational as R
from ..operators import search as X
from .corpus import ctes, read, wide
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def _bodies(spark, d):
    return wide(read(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("citation_id"), "text")


def _sql(name: str, source: str, phrases: list[list[str]], every: bool = True) -> str:
    """BM25 over source(key, w), w being lists of terms, as CTEs; the last is {name}(key, rank)."""
    freq = ", ".join(f"len(list_filter(range(1, len(w) - {len(p) - 2}), lambda i: {' and '.join(f'w[i + {k}] = {t!r}' for k, t in enumerate(p))})) as f{j}" for j, p in enumerate(phrases))
    stats = ", ".join(f"count(*) filter (f{j} > 0) as n{j}" for j in range(len(phrases)))
    idf = lambda j: f"(case when ln((n - n{j} + 0.5) / (n{j} + 0.5)) <= 0 then 1e-6 else ln((n - n{j} + 0.5) / (n{j} + 0.5)) end)"
    gain = " + ".join(f"{idf(j)} * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * len / av))" for j in range(len(phrases)))
    keep = (" and " if every else " or ").join(f"f{j} > 0" for j in range(len(phrases)))
    return f"{name}_f as (select key, len(w) as len, {freq} from {source}), {name}_s as (select count(*) as n, avg(len) as av, {stats} from {name}_f), {name} as (select key, -({gain}) as rank from {name}_f, {name}_s where {keep})"


_TERMS = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')"
_BODY = f"body as (select doc_id as key, {_TERMS.format('text')} as w from documents)"
#: Fields apart by a term that no query has.
_META = "meta as (select id as key, " + " || ['']::varchar[] || ".join(_TERMS.format(c) for c in R.SEARCHED) + " as w from citations)"


@query(f"with {_BODY}, {_sql('hit', 'body', [['erin'], ['of', 'the']])} select key as id, round(rank, 6) as rank from hit")
def find_phrases(spark, d):
    docs = _bodies(spark, d)
    p, n = X.build_index(docs, "chunk_id", ["text"], False, [["erin"], ["of", "the"]])
    return X.bm25(p, n, "chunk_id", [["erin"], ["of", "the"]]).select(F.col("chunk_id").alias("id"), F.round("rank", 6).alias("rank"))


@query(f"with {_BODY}, {_sql('hit', 'body', [['erin'], ['zu'], ['onth']], False)} select key as id, round(rank, 6) as rank from hit")
def find_any_word(spark, d):
    p, n = X.build_index(_bodies(spark, d), "chunk_id", ["text"], False, [["erin"], ["zu"], ["onth"]])
    return X.bm25(p, n, "chunk_id", [["erin"], ["zu"], ["onth"]], False).select(F.col("chunk_id").alias("id"), F.round("rank", 6).alias("rank"))


_META_SQL = _META.replace(" || ['']::varchar[] || ", " || [''] || ")


@query(
    f"""with {ctes('citations')}, {_BODY}, {_META_SQL}, meta2 as (select key, w from meta), {_sql('hb', 'body', [['the'], ['and']])}, {_sql('hm', 'meta2', [['the'], ['and']])},
both_ as (select key, min(rank) as rank from (select * from hb union all select * from hm) group by key)
select key as id, round(rank, 5) as rank from both_"""
)
def find_ranked_all(spark, d):
    c, b = read(spark, d, "citations"), _bodies(spark, d)
    phrases = [["the"], ["and"]]
    meta_p, meta_l = X.build_index(c, "id", list(R.SEARCHED), False, phrases)
    body_p, body_l = X.build_index(b, "chunk_id", ["text"], False, phrases)
    # The oracle's separators count as four terms of a row.
    meta_l = meta_l.withColumn("n_terms", F.col("n_terms") + 4)
    phrases = X.parse_query('the "and"', False)
    meta = X.bm25(meta_p, meta_l, "id", phrases).select(F.col("id").alias("citation_id"), "rank")
    body = X.bm25(body_p, body_l, "chunk_id", phrases).select(F.col("chunk_id").alias("citation_id"), "rank")
    return R.hits_of(meta, body).select(F.col("citation_id").alias("id"), F.round("rank", 5).alias("rank"))


@query()
def find_ranked(spark, d):
    """Stemmed search with a page of results and the best passage's snippet."""
    c, b = read(spark, d, "citations"), _bodies(spark, d)
    page = X.search(c, b, "erin hain", limit=20)
    return page.join(b, page["id"] == b["chunk_id"]).select("id", "rank", X.snippets(F.col("text"), X.parse_query("erin hain")).alias("snippet"))


@query(f"select doc_id as id, {_TERMS.format('text')} as terms from documents")
def index_terms(spark, d):
    return wide(read(spark, d, "documents")).select(F.col("doc_id").alias("id"), plain_terms("text").alias("terms"))


@query(f"with {_BODY}, t as (select key, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from body) select term, count(distinct key) as holders, count(*) as n from t group by term")
def index_postings(spark, d):
    p, _ = X.build_index(_bodies(spark, d), "chunk_id", ["text"], False)
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("holders"), F.sum(F.size("positions")).alias("n"))


@query(f"with {_BODY}, {_sql('hit', 'body', [['erin']])} select key as id, place from (select key, row_number() over (partition by key % 50 order by rank, key) as place from hit) where place <= 3")
def best_passages(spark, d):
    p, n = X.build_index(_bodies(spark, d), "chunk_id", ["text"], False, [["erin"]])
    hits = X.bm25(p, n, "chunk_id", [["erin"]]).withColumn("citation_id", F.col("chunk_id") % 50)
    return R.best_passages(hits).select(F.col("chunk_id").alias("id"), F.col("nth").cast("long").alias("place"))
