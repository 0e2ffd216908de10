"""The operators' registered queries: thin digests of the operators' outputs, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, fmindex, katz, lcp, quality, shards, simhash, template, trie, urls
from .common import table


def op1_lcp_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.compared(table(spark, sf_dir, "documents"))


def op2_template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.counted(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_mph_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.tokenised(table(spark, sf_dir, "documents"))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op7_redirect_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op8_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fmindex.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.positions(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.get("positions", F.lit(0)).alias("first_position"))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL: dict[str, str] = {
    "op7_redirect_filters": r"""
with recursive p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
u as (select *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
 regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, case when contains(url, '://') then regexp_replace(url, '(?s)#.*', '') else '' end as node from p),
links as (select distinct node as a, regexp_replace(t, '(?s)#.*', '') as b from (select node, unnest(regexp_extract_all(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)) as t from u) where contains(t, '://')),
edges as (select a, b from links union select b, a from links),
reach as (select a as x, a as y from edges union select r.x, e.b from reach r join edges e on r.y = e.a),
nodes as (select node from u union select b from links),
parts as (select node, translate(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from nodes),
rules(rh, rp, rv) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit as (select node, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv from parts, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by node),
said as (select r.x as node, bool_or(f.rv = 'allow') as allowed from reach r join fit f on r.y = f.node group by r.x)
select u.page_id, u.host, u.path, fit.rule, coalesce(fit.rv, case when said.allowed then 'allow' when not said.allowed then 'block' else 'allow' end) as verdict
from u left join fit on u.node = fit.node left join said on u.node = said.node
""",
    "op8_fm_decontaminate": r"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select distinct coalesce(cast(item_id as varchar), 'null') as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[k : k + 9], ' ') as g from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
lens as (select distinct n from win),
pos as (select r, n, k, array_to_string(w[k : k + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, lens where len(w) >= n)),
hit as (select p.r, p.k, p.n, win.item from pos p join win on p.g = win.g and p.n = win.n),
covered as (select r, count(distinct x) as n_hit from (select distinct r, unnest(range(k, k + n)) as x from hit) group by r),
items as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct r, item from hit) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join items using (r)
""",
    "op9_curriculum_mix": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) - 1 as rk from d group by source),
w as (select *, cast([3, 1, 2][rk % 3 + 1] as bigint) as weight, cast([0.5, 0.0, -0.5][rk % 3 + 1] as double) as tilt from s),
l as (select *, coalesce(sum(source_size * 2) over (order by source_size / weight, rk rows between unbounded preceding and 1 preceding), 0) as before,
 sum(weight) over (order by source_size / weight, rk rows between current row and unbounded following) as rest, sum(source_size) over () as total from w),
v as (select *, (cast(total as double) * 1.5 - cast(before as double)) / cast(rest as double) as lv from l),
g as (select *, max(case when lv * weight <= source_size * 2 then lv end) over () as level from v),
t as (select source, source_size, tilt, coalesce(least(level * weight, cast(source_size * 2 as double)), cast(source_size * 2 as double)) as target from g),
q as (select d.doc_id, d.size, t.source_size, t.target, t.tilt, coalesce(sum(d.size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as place
 from d join t on d.source is not distinct from t.source),
c as (select *, case when target > 0 and place + size / 2 <= target then 1 else 0 end + case when target > 0 and place + source_size + size / 2 <= target then 1 else 0 end as copies,
 greatest(0.0, least(1.0, (cast(place as double) + size / 2) / target)) as sh from q)
select doc_id, size, source_size, target, cast(size * copies as bigint) as taken,
 case when copies > 0 then 2 * sh / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * sh)) end as first_position from c
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lcp_fingerprints,
        op2_template_extract,
        op3_trie_token_counts,
        op4_simhash_pivots,
        op5_mph_shards,
        op6_katz_scores,
        op7_redirect_filters,
        op8_fm_decontaminate,
        op9_curriculum_mix,
        op10_weak_label_quality,
    )
}
