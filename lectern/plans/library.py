"""Look-ups, windows, sets and mutations of the bibliography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files as X
from ..operators import relational as R
from ..operators import retrieval as G
from ..operators import store as S
from .corpus import ctes, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query(f"with {ctes('citations')} select id, doi, created_at, row_number() over (order by created_at desc, id desc) as place from citations qualify place <= 100")
def citations_newest(spark, d):
    from pyspark.sql import Window as W

    rows = R.newest_first(read(spark, d, "citations")).limit(100)
    return rows.select("id", "doi", "created_at", F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("id"))).cast("long").alias("place"))


@query(f"with {ctes('citations')} select id, doi, title, year from citations where doi = '10.1003/src17.17'")
def citation_by_doi(spark, d):
    return R.by_doi(read(spark, d, "citations"), "10.1003/src17.17").select("id", "doi", "title", "year")


@query(
    f"with {ctes('citations', 'manifestations')} select c.id, coalesce((select m.path from manifestations m where m.citation_id = c.id and m.kind = 'pdf' order by m.id desc limit 1), c.pdf_path) as pdf_path from citations c"
)
def citation_pdf_paths(spark, d):
    return R.with_pdf_path(read(spark, d, "citations"), read(spark, d, "manifestations")).select("id", "pdf_path")


@query(f"with {ctes('manifestations')} select citation_id, kind, id, path, content_hash, last_seen_at from manifestations qualify row_number() over (partition by citation_id, kind order by id desc) = 1")
def latest_manifestations(spark, d):
    return R.latest_manifestation(read(spark, d, "manifestations"))


@query(f"with {ctes('chunks')} select citation_id, manifestation_id, ordinal, section, text from chunks where citation_id = 7")
def passages_of_citation(spark, d):
    return R.passages(read(spark, d, "chunks"), 7).select("citation_id", "manifestation_id", "ordinal", "section", "text")


@query(f"with {ctes('chunks')} select manifestation_id, min(content_hash) as content_hash, min(chunker_version) as chunker_version from chunks group by manifestation_id")
def index_states(spark, d):
    return R.index_state(read(spark, d, "chunks"))


@query(f"with {ctes('citations', 'retrieval_log')} select l.* from retrieval_log l join citations c on c.id = l.citation_id where c.doi = '10.1005/src12.12'")
def retrieval_log_of_doi(spark, d):
    log = R.log_of(read(spark, d, "citations"), read(spark, d, "retrieval_log"), "10.1005/src12.12")
    return log.select("id", "citation_id", "source", "success", "duration", "created_at")


_AFTER = "(created_at > '2024-01-05T00:00:00.000Z' or created_at = '2024-01-05T00:00:00.000Z' and id > 200)"
_CURSOR = "replace(to_base64(cast('{\"createdAt\":\"' || created_at || '\",\"id\":' || cast(id as varchar) || '}' as blob)), chr(10), '')"


@query(
    f"""with {ctes('citations')}, p as (select *, row_number() over (order by created_at, id) as n from citations where {_AFTER})
select id, created_at, case when n = 40 and exists (select 1 from p where n = 41) then {_CURSOR} end as next_cursor from p where n <= 40"""
)
def citations_keyset_page(spark, d):
    at = R.encode_cursor(createdAt="2024-01-05T00:00:00.000Z", id=200)
    return R.keyset_page(read(spark, d, "citations"), at, 40).select("id", "created_at", "next_cursor")


_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIKE = " or ".join(f"coalesce({_ASCII.format(c)} like '%src1_%', false)" for c in R.SEARCHED)


@query(f"with {ctes('citations')} select id, doi, created_at from (select *, row_number() over (order by created_at, id) as n from citations where {_LIKE}) where n <= 200")
def citations_like_page(spark, d):
    return R.keyset_page(R.like_search(read(spark, d, "citations"), "SRC1_"), None, 999).select("id", "doi", "created_at")


@query(f"with {ctes('citations')} select id, list_filter(['title', 'authors', 'journal', 'bibtex_key', 'doi'], lambda n, i: len(list_filter(['src1', 'en'], lambda w: not contains(lower(coalesce([title, authors, journal, bibtex_key, doi][i], '')), w))) = 0) as fields from citations")
def matched_fields(spark, d):
    return read(spark, d, "citations").select("id", R.matched_fields("SRC1 en").alias("fields"))


@query(f"with {ctes('citations', 'manifestations')} select pdf_path as path from citations where pdf_path <> '' union select path from manifestations where path <> ''")
def stored_paths(spark, d):
    return R.stored_paths(read(spark, d, "citations"), read(spark, d, "manifestations"))


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {s}" for t, s in (("citations", "documents"), ("manifestations", "lineitem"), ("chunks", "conversations"), ("retrieval_log", "events"))))
def row_counts(spark, d):
    return R.row_counts(**{t: read(spark, d, t) for t in ("citations", "manifestations", "chunks", "retrieval_log")})


@query(f"with {ctes('citations')} select count(*) as total, count(*) filter (verification_status = 'verified') as verified, count(*) filter (verification_status = 'suspicious') as suspicious, count(*) filter (verification_status = 'error') as error from citations")
def status_histogram(spark, d):
    return R.histogram(read(spark, d, "citations"), "verification_status", ["verified", "suspicious", "error"])


@query(f"with {ctes('citations')} select doi, title, year, journal, verification_status from citations")
def citation_summaries(spark, d):
    return R.summary(read(spark, d, "citations"))


# Mutations: the whole table is stored; what arrives is made of another whole table, or of all rows under changed keys.

_IN = ("o_orderkey as seq", "case when o_orderkey % 11 = 0 then '' else '10.' || cast(1000 + o_custkey % 7 as string) || '/src' || cast(o_custkey % 20 as string) || '.' || cast(o_custkey as string) end as doi", "case when o_orderkey % 3 = 0 then '' else o_orderpriority end as title", "cast(o_orderkey % 4 as int) as year")


@query(
    f"""with {ctes('citations')}, incoming as (select {', '.join(_IN)} from orders),
new as (select *, row_number() over (partition by doi order by seq) as nth from incoming where doi <> '' and doi not in (select doi from citations))
select (select max(id) from citations) + row_number() over (order by seq) as id, doi, nullif(title, '') as title, cast(nullif(year, 0) as varchar) as year, 'unverified' as verification_status, '2024-02-01T00:00:00.000Z' as created_at from new where nth = 1"""
)
def citations_inserted(spark, d):
    incoming = read(spark, d, "orders").selectExpr(*_IN)
    new = S.insert_if_absent(read(spark, d, "citations"), incoming, "2024-02-01T00:00:00.000Z")
    return new.select("id", "doi", "title", F.col("year").cast("string").alias("year"), "verification_status", "created_at")


_KEYED = "case when id % 5 = 0 then path else path || '.' || cast(id % 3 as string) end"


@query(
    f"""with {ctes('manifestations')}, new as (select citation_id, kind, {_KEYED} as path, max(case when id % 2 = 0 then content_hash end) as content_hash, 99 as last_seen_at from manifestations group by all),
known as (select o.id, o.citation_id, o.kind, o.path, coalesce(n.content_hash, o.content_hash) as content_hash, coalesce(n.last_seen_at, o.last_seen_at) as last_seen_at from manifestations o left join new n on o.citation_id = n.citation_id and o.kind = n.kind and o.path = n.path)
select * from known union all
select (select max(id) from manifestations) + row_number() over (order by citation_id, kind, path), citation_id, kind, path, content_hash, last_seen_at from new n where not exists (select 1 from manifestations o where o.citation_id = n.citation_id and o.kind = n.kind and o.path = n.path)"""
)
def manifestations_upserted(spark, d):
    rows = read(spark, d, "manifestations")
    new = rows.withColumn("path", F.expr(_KEYED)).groupBy("citation_id", "kind", "path").agg(F.max(F.expr("case when id % 2 = 0 then content_hash end")).alias("content_hash")).withColumn("last_seen_at", F.lit(99))
    return S.upsert_manifestations(rows, new)


@query(f"with {ctes('chunks')} select manifestation_id, ordinal, text from chunks where manifestation_id not in (select manifestation_id * 2 from chunks) union all select manifestation_id * 2, ordinal, text || '!' from chunks")
def chunks_replaced(spark, d):
    rows = read(spark, d, "chunks").select("manifestation_id", "ordinal", "text")
    return S.replace_chunks(rows, rows.select((F.col("manifestation_id") * 2).alias("manifestation_id"), "ordinal", F.concat("text", F.lit("!")).alias("text")))


_CHANGED = "case when id % 6 = 0 then doi else doi || '.none' end"


@query(f"with {ctes('citations')} select id, case when id % 6 = 0 then 'fabricated' else verification_status end as verification_status, case when id % 6 = 0 then '2024-03-01' else updated_at end as updated_at from citations")
def statuses_updated(spark, d):
    rows = read(spark, d, "citations")
    changes = rows.select(F.expr(_CHANGED).alias("doi"), F.lit("fabricated").alias("verification_status"))
    return S.updated(rows, changes, "2024-03-01").select("id", "verification_status", "updated_at")


@query(f"with {ctes('citations')} select id, case when id % 6 = 0 then 'subscription' else access_type end as access_type, verification_status, case when id % 6 = 0 then '2024-03-02' else updated_at end as updated_at from citations")
def access_updated(spark, d):
    rows = read(spark, d, "citations")
    changes = rows.select(F.expr(_CHANGED).alias("doi"), F.lit("subscription").alias("access_type"))
    return S.updated(rows, changes, "2024-03-02").select("id", "access_type", "verification_status", "updated_at")


@query(f"with {ctes('citations', 'retrieval_log')} select id, citation_id from retrieval_log where citation_id in (select id * 2 from citations)")
def log_after_cascade(spark, d):
    left = read(spark, d, "citations").withColumn("id", F.col("id") * 2)
    return S.cascade(read(spark, d, "retrieval_log"), left).select("id", "citation_id")


_TRIED = ("id as seq", f"{_CHANGED} as doi", "'arxiv' as source", "case when id % 4 = 0 then null else '/new/' || bibtex_key || '.pdf' end as pdf_path", "'open-access' as access_type")
_LOGGED = f"""tried as (select {', '.join(_TRIED)} from citations), own as (select t.*, c.id as citation_id from tried t join citations c using (doi))"""


@query(
    f"""with {ctes('citations', 'retrieval_log')}, {_LOGGED} select id, citation_id, source, success from retrieval_log
union all select (select max(id) from retrieval_log) + row_number() over (order by seq), citation_id, source, pdf_path is not null from own"""
)
def attempts_logged(spark, d):
    c = read(spark, d, "citations")
    attempts = c.selectExpr(*_TRIED).withColumn("success", F.col("pdf_path").isNotNull())
    return S.attempts_logged(read(spark, d, "retrieval_log"), c, attempts, "1").select("id", "citation_id", "source", "success")


@query(
    f"""with {ctes('citations')}, {_LOGGED} select c.id, coalesce(o.pdf_path, c.pdf_path) as pdf_path, case when o.pdf_path is not null then 'open-access' else c.access_type end as access_type, case when o.pdf_path is not null then 'verified' else c.verification_status end as verification_status
from citations c left join own o on o.citation_id = c.id"""
)
def downloads_recorded(spark, d):
    """The citations after a round of downloads: path, access and status in one step."""
    c = read(spark, d, "citations")
    files = read(spark, d, "manifestations").withColumn("last_seen_at", F.col("last_seen_at").cast("string"))
    known, _, _ = S.downloads_recorded(c, files, read(spark, d, "retrieval_log"), c.selectExpr(*_TRIED), "2024-03-03")
    return known.select("id", "pdf_path", "access_type", "verification_status")


@query(f"with {ctes('manifestations', 'chunks')}, st as (select manifestation_id, min(content_hash) as h, min(chunker_version) as v from chunks group by 1) select m.id, m.content_hash from manifestations m where not exists (select 1 from st where st.manifestation_id = m.id and st.h = m.content_hash and st.v = 2)")
def manifestations_to_index(spark, d):
    return S.to_index(read(spark, d, "manifestations"), R.index_state(read(spark, d, "chunks")), 2).select("id", "content_hash")


# Files

_STEMMED = "regexp_replace(bibtex_key, '[^A-Za-z0-9._-]', '_')"
_LISTED = "case id % 4 when 0 then '/rec/' || cast(id as string) || '.md' when 1 then '/old/markdown/' || bibtex_key || '.md' when 2 then '/old/markdown/' || regexp_replace(doi, '[^A-Za-z0-9._-]', '_') || '.md' else '/else/' || bibtex_key || '.md' end"
_RECORDED = "id * 10 as id, id as citation_id, 'markdown-extracted' as kind, '/rec/' || cast(id as string) || '.md' as path"


@query(f"with {ctes('citations')} select id as citation_id, {_LISTED} as path, id % 4 > 0 as healed from citations where id % 4 < 3")
def markdown_paths(spark, d):
    c = read(spark, d, "citations").withColumn("pdf_path", F.expr("'/old/pdf/' || bibtex_key || '.pdf'"))
    return X.markdown_paths(c, c.selectExpr(*_RECORDED.split(", ")), c.selectExpr(f"{_LISTED} as path"))


@query("select regexp_replace(p_name, '[^A-Za-z]', '') || p_partkey as id, '/pdf/' || p_brand || '/' || regexp_replace(p_name, '[^A-Za-z]', '') || p_partkey || '.PDF' as pdf_path, case when p_size % 2 = 0 then '/md/' || p_brand || '/' || regexp_replace(p_name, '[^A-Za-z]', '') || p_partkey || '.md' else '/md/' || regexp_replace(p_name, '[^A-Za-z]', '') || p_partkey || '.md' end as markdown_path from part")
def folder_pairs(spark, d):
    stem = "regexp_replace(p_name, '[^A-Za-z]', '') || cast(p_partkey as string)"
    rows = read(spark, d, "part")
    pdfs = rows.selectExpr(f"'/pdf/' || p_brand || '/' || {stem} || '.PDF' as path")
    there = rows.selectExpr(f"case when p_size % 2 = 0 then '/md/' else '/no/' end || p_brand || '/' || {stem} || '.md' as path")
    return X.folder_pairs(pdfs, "/pdf", "/md/", there)


@query(f"with {ctes('citations')} select doi, case when id % 6 = 0 then pdf_path else '/p/' || {_STEMMED} || '.pdf' end as path from citations where id % 6 = 0 or id % 2 = 1")
def cached_downloads(spark, d):
    """Every file but those of even ids without a recorded path that is there."""
    c = read(spark, d, "citations")
    listing = c.selectExpr("case when id % 6 = 0 then pdf_path when id % 2 = 1 then '/p/' || bibtex_key || '.pdf' else '/q/' || doi end as path").withColumn("name", X.base_name(F.col("path")))
    return G.cached(c, listing)
