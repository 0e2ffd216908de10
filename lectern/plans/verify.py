"""Quotes of the benchmark against the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verify as V
from .corpus import read, wide
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def _quotes(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


def _docs(spark, d):
    return wide(read(spark, d, "documents")).select("doc_id", (F.col("doc_id") % 28).alias("created_at"), "text")


_STEPS = [("\\x{00AD}", ""), ("-[ \\t]*\\n\\s*", ""), ("[\\x{2018}\\x{2019}\\x{201A}\\x{2032}]", "''"), ("[\\x{201C}\\x{201D}\\x{201E}\\x{2033}]", '"'), ("[\\x{2013}\\x{2014}\\x{2212}]", "-"), ("\\s+", " ")]


def _norm(c: str) -> str:
    for old, new in _STEPS:
        c = f"regexp_replace({c}, '{old}', '{new}', 'g')"
    return f"lower(trim({c}))"


_HITS = f"""n as (select item_id as quote_id, {_norm('text')} as needle from benchmark), t as (select doc_id, doc_id % 28 as created_at, {_norm('text')} as norm from documents),
hits as (select quote_id, doc_id, needle, norm, strpos(norm, needle) as pos, row_number() over (partition by quote_id order by created_at desc, doc_id desc) as nth from n join t on contains(norm, needle) where length(needle) >= 10)"""


@query(
    f"""with {_HITS} select quote_id, doc_id, nth, case when pos > 151 then '…' else '' end || substring(norm, greatest(1, pos - 150), least(length(norm), pos + length(needle) + 149) - greatest(1, pos - 150) + 1) || case when pos + length(needle) + 149 < length(norm) then '…' else '' end as snippet
from hits where nth <= 5"""
)
def quotes_exact(spark, d):
    return V.exact_matches(_quotes(spark, d), _docs(spark, d), compose=False).withColumn("nth", F.col("nth").cast("long"))


@query(f"with {_HITS} select n.quote_id, case when count(doc_id) > 0 then 'exact' else 'not-found' end as verdict, least(count(doc_id), 5) as n_matches from n left join hits using (quote_id) group by n.quote_id")
def quotes_verdicts(spark, d):
    return V.verdicts(_quotes(spark, d), _docs(spark, d), None, compose=False)


@query("select item_id as quote_id, 'quote-too-short' as verdict, cast(0 as bigint) as n_matches from benchmark")
def quotes_too_short(spark, d):
    short = _quotes(spark, d).withColumn("quote", F.substring("quote", 1, 9))
    return V.verdicts(short, _docs(spark, d), None, compose=False)


@query()
def quotes_close(spark, d):
    """Quotes with their fifth word replaced, against passages of documents."""
    words = F.split("quote", " ")
    wrong = _quotes(spark, d).withColumn("quote", F.array_join(F.concat(F.slice(words, 1, 4), F.array(F.lit("misquotedword")), F.slice(words, F.lit(6), F.size(words))), " "))
    from ..operators.chunker import chunked

    chunks = chunked(wide(read(spark, d, "documents")), "doc_id").withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("ordinal"))
    return V.close_matches(wrong, chunks)


@query()
def quotes_verdicts_full(spark, d):
    """Verdicts with compatibility composition, stemming and close matches."""
    from ..operators.chunker import chunked

    chunks = chunked(wide(read(spark, d, "documents")), "doc_id").withColumn("chunk_id", F.col("doc_id") * 1000 + F.col("ordinal"))
    return V.verdicts(_quotes(spark, d), _docs(spark, d), chunks)


@query(f"select doc_id, {_norm('text')} as norm from documents")
def texts_normalized(spark, d):
    from ..functions.text import normalized

    return wide(read(spark, d, "documents")).select("doc_id", normalized(F.col("text"), False).alias("norm"))


@query(
    """with w0 as (select doc_id, (list_filter(list_transform(string_split_regex(trim(lower(text)), '\\s+'), lambda x: regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')), lambda x: x <> '')) as t from documents),
q0 as (select item_id, (list_filter(list_transform(string_split_regex(trim(lower(text)), '\\s+'), lambda x: regexp_replace(regexp_replace(x, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')), lambda x: x <> '')) as t from benchmark),
w as (select doc_id, t[1] as k, list_distinct(t) as t from w0), q as (select item_id, t[1] as k, list_distinct(t) as t from q0)
select doc_id, item_id, floor(len(list_intersect(q.t, w.t)) / len(q.t) * 100 + 0.5) / 100 as similarity from w join q on w.k = q.k"""
)
def token_overlap(spark, d):
    from ..functions.text import quote_tokens, rounded, trimmed

    w = wide(read(spark, d, "documents")).select("doc_id", quote_tokens(trimmed(F.lower("text"))).alias("t")).withColumn("k", F.get("t", F.lit(0)))
    q = read(spark, d, "benchmark").select("item_id", quote_tokens(trimmed(F.lower("text"))).alias("q")).withColumn("k", F.get("q", F.lit(0)))
    return w.join(q, "k").select("doc_id", "item_id", rounded(F.size(F.array_intersect("q", "t")) / F.size("q"), 2).alias("similarity"))


_ASKED = "case doc_n % 4 when 0 then null when 1 then 'doi/' || cast(doc_n % 40 as varchar) when 2 then 'doi/none' else 'doi/' || cast(doc_n as varchar) end"


@query(
    f"""with n as (select item_id as quote_id, {_norm('text')} as needle, row_number() over (order by item_id) as doc_n from benchmark),
t as (select doc_id, doc_id % 28 as created_at, {_norm('text')} as norm from documents where doc_id % 5 > 0), q as (select *, {_ASKED} as doi from n),
one as (select quote_id, count(*) filter (contains(norm, needle)) as k from q join t on q.doi = 'doi/' || cast(t.doc_id as varchar) group by quote_id),
every as (select quote_id, least(count(*), 5) as k from q join t on contains(norm, needle) where q.doi is null group by quote_id)
select q.quote_id, case when q.doi is not null and not exists (select 1 from documents d where q.doi = 'doi/' || cast(d.doc_id as varchar)) then 'unknown-doi' when q.doi is not null and one.k is null then 'no-markdown' else 'ok' end as status,
cast(coalesce(one.k, every.k, 0) as bigint) as n_exact from q left join one using (quote_id) left join every using (quote_id)"""
)
def quotes_checked(spark, d):
    """Quotes with and without a DOI, in documents of which every fifth has no text."""
    from pyspark.sql import Window as W

    from ..operators.chunker import chunked

    nth = F.row_number().over(W.orderBy("item_id"))
    quotes = read(spark, d, "benchmark").withColumn("doc_n", nth).select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), F.expr(_ASKED.replace("varchar", "string")).alias("doi"))
    docs = wide(read(spark, d, "documents"))
    citations = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("doi/"), F.col("doc_id").cast("string")).alias("doi"), (F.col("doc_id") % 28).alias("created_at"))
    texts = docs.where("doc_id % 5 > 0").select(F.col("doc_id").alias("citation_id"), "text")
    chunks = chunked(texts, "citation_id").withColumn("chunk_id", F.col("citation_id") * 1_000_000 + F.col("ordinal"))
    got = V.checked(quotes, citations, texts, chunks, compose=False)
    exact = F.size(F.filter("matches", lambda m: m["similarity"] == 1.0)).cast("long")
    return got.select("quote_id", "status", exact.alias("n_exact"))
