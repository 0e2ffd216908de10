"""Decisions of the retrieval cascade, the breaker, and answers of services, on recorded outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as G
from ..sources import bibliography as B
from .corpus import read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_STAGE = "case l_linenumber % 5 when 0 then 'cache' when 1 then 'unpaywall' when 2 then 'semantic-scholar' when 3 then 'arxiv' else 'authenticated' end"
_OUTCOMES = ["cast(l_orderkey as string) as doi", f"{_STAGE} as stage", "l_partkey % 3 = 0 as ok", "l_suppkey % 4 = 0 as throttled", "'a title of some length' as expected_title", "case when l_partkey % 2 = 0 then 'a title of some length' else 'another' end as upstream_title"]


@query(
    f"""with o as (select {', '.join(_OUTCOMES)} from lineitem),
g as (select doi, stage, throttled, ok and (stage not in ('arxiv', 'semantic-scholar') or upstream_title = expected_title) as good, list_position(['cache', 'unpaywall', 'semantic-scholar', 'arxiv', 'authenticated'], stage) as place from o),
w as (select *, min(case when good then place end) over (partition by doi) as won from g)
select doi, ['cache', 'unpaywall', 'semantic-scholar', 'arxiv', 'authenticated'][max(won)] as source, count(*) as n_attempts, max(won) is null and bool_or(throttled) as throttled from w where won is null or place <= won group by doi"""
)
def cascade_results(spark, d):
    return G.cascade(read(spark, d, "lineitem").selectExpr(*_OUTCOMES))


_EVENTS = ["cast(user_id % 20 as string) as source", "event_id as seq", "event_id * 900 as ts_ms", "case when event_id % 7 < 5 then '429' when event_id % 7 = 5 then 'ok' else '404' end as outcome"]


@query(
    f"""with recursive e as (select *, row_number() over (partition by source order by seq) as n from (select {', '.join(_EVENTS)} from events)),
f(source, n, seq, streak, until_ms, allowed) as (
 select source, cast(0 as bigint), cast(-1 as bigint), 0, cast(null as bigint), true from (select distinct source from e)
 union all
 select e.source, e.n, e.seq, case when f.until_ms is not null and e.ts_ms < f.until_ms then f.streak when e.outcome = '429' then f.streak + 1 else 0 end,
  case when f.until_ms is not null and e.ts_ms < f.until_ms then f.until_ms when e.outcome = '429' and (f.until_ms is not null or f.streak + 1 >= 3) then e.ts_ms + 30000 end,
  not (f.until_ms is not null and e.ts_ms < f.until_ms)
 from f join e on e.source = f.source and e.n = f.n + 1)
select source, seq, allowed, case when until_ms is not null then 'open' else 'closed' end as state from f where n > 0"""
)
def breaker_states(spark, d):
    return G.breaker(read(spark, d, "events").selectExpr(*_EVENTS))


@query("select event_id, retryable, delay_ms from (select event_id, case when event_id % 5 = 0 then null else cast(200 + (event_id % 4) * 100 + (case when event_id % 4 = 2 then 29 else 0 end) as int) end as status, status is null or status = 429 or status >= 500 as retryable, least(case when event_id % 3 = 0 then 2000.0 else pow(2, event_id % 7) * 1000 end, 30000.0) as delay_ms from events)")
def retries(spark, d):
    e = read(spark, d, "events")
    status = F.expr("case when event_id % 5 = 0 then null else cast(200 + (event_id % 4) * 100 + (case when event_id % 4 = 2 then 29 else 0 end) as int) end")
    wait = G.retry_delay_ms(F.col("event_id") % 7, F.expr("case when event_id % 3 = 0 then 2 end"))
    return e.select("event_id", G.retryable(status).alias("retryable"), wait.alias("delay_ms"))


@query("select o_orderkey as id, case when o_orderkey % 2 = 0 then case when o_orderkey % 3 = 0 then 'http://b/' || o_custkey else 'http://l/' || o_custkey end end as pdf_url from orders")
def unpaywall_answers(spark, d):
    best = F.expr("case when o_orderkey % 3 = 0 then concat('{\"url_for_pdf\":\"http://b/', o_custkey, '\"}') else 'null' end")
    body = F.concat(F.lit('{"is_oa":'), F.expr("case when o_orderkey % 2 = 0 then 'true' else 'false' end"), F.lit(',"best_oa_location":'), best, F.lit(',"oa_locations":[{"url_for_pdf":null},{"url_for_pdf":"http://l/'), F.col("o_custkey"), F.lit('"}]}'))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), B.unpaywall(body).alias("pdf_url"))


@query("select c_custkey as id, cast(1990 + c_custkey % 20 as int) as year, c_name as title, 'Ann ' || c_mktsegment || ' and Bo Lee' as authors from customer")
def crossref_answers(spark, d):
    when = F.expr("case when c_custkey % 2 = 0 then 'published-print' else 'published-online' end")
    body = F.concat(F.lit('{"message":{"title":["'), F.col("c_name"), F.lit('"],"author":[{"given":"Ann","family":"'), F.col("c_mktsegment"), F.lit('"},{"given":"Bo","family":"Lee"}],"'), when, F.lit('":{"date-parts":[['), F.lit(1990) + F.col("c_custkey") % 20, F.lit(",1]]}}}"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), B.crossref(body).alias("r")).select("id", "r.year", "r.title", "r.authors")


@query("select s_suppkey as id, '24' || s_suppkey || '.1' as arxiv_id, 'https://arxiv.org/pdf/24' || s_suppkey || '.1' as pdf_url, s_name || ' x' as title from supplier")
def atom_answers(spark, d):
    body = F.concat(F.lit("<feed><entry>\n<id>http://arxiv.org/abs/24"), F.col("s_suppkey"), F.lit(".1v3</id><title>"), F.col("s_name"), F.lit("\n  x</title></entry><entry><id>other</id></entry></feed>"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(B.atom_entries(body)).alias("e")).select("id", "e.*")


@query("select p_partkey as id, 'T {' || p_name || '}' as title, 'A. One and B. Two' as authors, cast(1990 + p_size as int) as year, p_brand as journal, 'k' || p_partkey as bibtex_key from part")
def bibtex_entries(spark, d):
    text = F.concat(F.lit("% comment\n@inproceedings{k"), F.col("p_partkey"), F.lit(",\n  title = {T {"), F.col("p_name"), F.lit('}},\n author = "A. One and B. Two", year = '), F.lit(1990) + F.col("p_size"), F.lit(",\n booktitle={"), F.col("p_brand"), F.lit("},\n}\n"))
    rows = B.entries(read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id")
    return rows.select("id", "title", "authors", "year", "journal", "bibtex_key")


@query("with r as (select o_orderkey % 3 = 0 as ins, case when o_orderkey % 4 = 0 then null else 'x' end as source, o_orderkey % 8 = 0 as sk from orders) select count(*) as total, count(*) filter (ins) as imported, count(source) as downloaded, count(*) filter (sk) as skipped, count(*) filter (source is null and not sk) as failed from r")
def import_report(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey as doi", "o_orderkey % 3 = 0 as inserted", "case when o_orderkey % 4 = 0 then null else 'x' end as source", "o_orderkey % 8 = 0 as skipped")
    return G.import_summary(rows)


@query("select o_orderkey as doi, case when o_orderkey % 8 = 0 then 'skipped' else 'failed' end as kind, 'why ' || o_orderpriority as reason from orders where o_orderkey % 8 = 0 or o_orderkey % 4 = 0")
def import_issues(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey as doi", "o_orderstatus as bibtex_key", "case when o_orderkey % 4 = 0 then null else 'x' end as source", "o_orderkey % 8 = 0 as skipped", "'why ' || o_orderpriority as reason")
    return G.import_issues(rows).select("doi", "kind", "reason")


_ASKED = ["event_type as source", "event_id as seq", "event_id * 300 + user_id % 50 * 40 as ts_ms"]


@query(
    f"""with r as (select *, row_number() over (partition by source order by seq) - 1 as n from (select {', '.join(_ASKED)} from events))
select source, seq, ts_ms, max(ts_ms - n * 3000) over (partition by source order by seq) + n * 3000 as start_ms from r"""
)
def limiter_tickets(spark, d):
    return G.tickets(read(spark, d, "events").selectExpr(*_ASKED), 3000)


_STEPS = ["user_id as entry_id", "event_id as seq", "event_type as stage", "event_id % 9 = 0 as final"]


@query(
    f"""with e as (select *, min(case when final then seq end) over (partition by entry_id) as last from (select {', '.join(_STEPS)} from events))
select entry_id, seq, stage, coalesce(seq = last, false) as settled from e where last is null or seq <= last"""
)
def import_progress(spark, d):
    return G.progress(read(spark, d, "events").selectExpr(*_STEPS))


@query(r"""select p_partkey as id, 'ti:"' || trim(regexp_replace('On {' || p_name || '}: 2nd  part', '\s+', ' ', 'g')) || '"' as strict, 'all:"' || trim(regexp_replace(regexp_replace('On {' || p_name || '}: 2nd  part', '[^a-zA-Z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) || '"' as broad, '24' || p_partkey || '.7' as arxiv_id from part""")
def arxiv_queries(spark, d):
    title = F.expr("'On {' || p_name || '}: 2nd  part'")
    url = F.expr("case when p_size % 2 = 0 then 'https://arxiv.org/abs/24' || cast(p_partkey as string) || '.7v2' else 'http://arxiv.org/pdf/24' || cast(p_partkey as string) || '.7.pdf' end")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), G.arxiv_query(title).alias("strict"), G.arxiv_query(title, True).alias("broad"), G.arxiv_id(url).alias("arxiv_id"))


_FOUND = "p_partkey as doi, p_size % 7 as pos, p_name as expected"


@query(
    f"""with p as (select {_FOUND}, p_size, p_brand from part) select doi, case when p_size % 3 = 0 then 'strict' else 'broad' end as step, cast(pos as bigint) as pos, expected as actual, cast(1.0 as double) as similarity from p
where pos < 5 and p_size % 4 > 0"""
)
def arxiv_matches(spark, d):
    """Strict answers where there are some, right or wrong; else broad ones."""
    rows = read(spark, d, "part").selectExpr(*_FOUND.split(", "), "p_size")
    right = F.when(F.col("p_size") % 4 > 0, F.col("expected")).otherwise("zzzz qqqq")
    answers = rows.withColumn("actual", right).select("doi", F.col("pos").cast("long").alias("pos"), "expected", "actual", "p_size")
    strict, broad = answers.where("p_size % 3 = 0").drop("p_size"), answers.drop("p_size")
    return G.two_step(strict, broad)
