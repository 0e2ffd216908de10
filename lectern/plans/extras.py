"""Filters, the citation graph and evaluation, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras as E
from .corpus import ctes, read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query(f"with {ctes('citations')} select id, doi from citations where year between 1995 and 2010 and verification_status in ('verified', 'suspicious') and access_type = 'open-access' and pdf_path <> ''")
def citations_filtered(spark, d):
    return E.filtered(read(spark, d, "citations"), (1995, 2010), ["verified", "suspicious"], ["open-access"], True).select("id", "doi")


#: References: every line of an order cites the document of its part's number, by DOI, some of which are unknown.
_CITES = "l_orderkey % 1000 as citation_id, '10.' || cast(1000 + (l_partkey % 1200) % 7 as string) || '/src' || cast((l_partkey % 1200) % 20 as string) || '.' || cast(l_partkey % 1200 as string) as doi"
_EDGES = f"refs as (select {_CITES} from lineitem), edges as (select distinct r.citation_id as citing, c.id as cited from refs r join citations c using (doi) where r.citation_id <> c.id)"


def _edges(spark, d):
    return E.links(read(spark, d, "lineitem").selectExpr(*_CITES.split(", ", 1)), read(spark, d, "citations"))


@query(f"with {ctes('citations')}, {_EDGES} select citing, cited from edges")
def citation_links(spark, d):
    return _edges(spark, d)


@query(f"with {ctes('citations')}, {_EDGES}, b as (select citing as id, 1 as r, 0 as c from edges union all select cited, 0, 1 from edges) select id, cast(sum(r) as bigint) as n_references, cast(sum(c) as bigint) as n_citing from b group by id")
def citation_counts(spark, d):
    return E.counts(_edges(spark, d))


@query(
    f"""with {ctes('citations')}, {_EDGES}, s as (select a.citing as id, b.citing as other, count(*) as shared from edges a join edges b on a.cited = b.cited and a.citing <> b.citing where a.citing % 20 = 0 and a.citing in (select id from citations) group by all)
select *, row_number() over (partition by id order by shared desc, other) as place from s qualify place <= 5"""
)
def citations_related(spark, d):
    """The nearest by shared references, for every citation whose id is divisible by 20."""
    asked = read(spark, d, "citations").where("id % 20 = 0")
    return E.related(_edges(spark, d), asked).withColumn("place", F.col("place").cast("long"))


@query(
    f"""with recursive {ctes('citations')}, {_EDGES}, r as (select cast(7 as bigint) as id, 0 as hop union select e.cited, r.hop + 1 from r join edges e on e.citing = r.id where r.hop < 2)
select id, min(hop) as hop from r group by id"""
)
def citation_frontier(spark, d):
    return E.frontier(_edges(spark, d), spark.createDataFrame([(7,)], "id long"), 2)


_BOTH = "select event_id as claim_id, 'fts' as system, event_id % 7 < 5 as hit from events union all select event_id, 'vector', event_id % 5 < 3 from events"


def _judged(spark, d):
    e = read(spark, d, "events")
    one = lambda name, rule: e.select(F.col("event_id").alias("claim_id"), F.lit(name).alias("system"), F.expr(rule).alias("right"))
    return one("fts", "event_id % 7 < 5").unionAll(one("vector", "event_id % 5 < 3"))


@query(f"with j as ({_BOTH}) select system, count(*) as n, count(*) filter (hit) as n_right, round(avg(hit::int), 9) as accuracy from j group by system")
def claim_accuracy(spark, d):
    return E.accuracy(_judged(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query(
    f"""with j as ({_BOTH}), c as (select claim_id, bool_or(hit and system = 'fts') as a, bool_or(hit and system = 'vector') as b from j group by claim_id),
k as (select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from c)
select only_a, only_b, round(case when only_a + only_b > 0 then power(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) else 0 end, 9) as statistic from k"""
)
def claim_mcnemar(spark, d):
    return E.mcnemar(_judged(spark, d), "fts", "vector").withColumn("statistic", F.round("statistic", 9))
