"""Pages of texts, passages and their heading trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunker as C
from ..operators import relational as R
from .corpus import read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query("select doc_id, substring(text, 501, 1000) as text, case when length(text) > 1500 then 1500 else -1 end as next_offset from documents")
def text_pages(spark, d):
    return read(spark, d, "documents").select("doc_id", R.text_page(F.col("text"), 500, 1000).alias("p")).select("doc_id", "p.text", F.coalesce("p.next_offset", F.lit(-1)).alias("next_offset"))


_SLICES = "with t as (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as x from documents), s as (select doc_id, unnest(range(0, greatest(length(x), 1), 2000)) as o, x from t), p as (select doc_id, o, regexp_replace(substring(x, o + 1, 2000), '^\\s+|\\s+$', '', 'g') as text from s)"


@query(f"{_SLICES} select doc_id, cast(row_number() over (partition by doc_id order by o) - 1 as integer) as ordinal, 0 as n_headings, text from p where text <> ''")
def passages_of_documents(spark, d):
    """No document has a heading or an empty line, so passages are slices."""
    return C.chunked(read(spark, d, "documents"), "doc_id").select("doc_id", "ordinal", F.size("section_path").alias("n_headings"), "text")


#: A small document with skipped levels; the trail keeps what stands above the level.
_LINES = ["### A", "x", "### B", "### C", "### D", "# E", "y", "## F", "z"]
_PATHS = ["A", "A", "A>B", "A>B>C", "A>B>D", "E", "E", "E>F", "E>F"]


@query(" union all ".join(f"select doc_id, {k} as line_no, '{p}' as trail from documents" for k, p in enumerate(_PATHS)))
def heading_trails(spark, d):
    lines = F.array(*map(F.lit, _LINES))
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return C.heading_trails(rows).select("doc_id", "line_no", F.array_join("section_path", ">").alias("trail"))


@query("select conv_id as manifestation_id, turn as ordinal, sha256(text) as content_hash from conversations")
def content_hashes(spark, d):
    return read(spark, d, "chunks").select("manifestation_id", "ordinal", F.sha2("text", 256).alias("content_hash"))


@query("select doc_id, to_base64(cast('{\"offset\":' || cast(doc_id as varchar) || '}' as blob)) as cursor from documents")
def offset_cursors(spark, d):
    return read(spark, d, "documents").select("doc_id", F.base64(F.to_json(F.struct(F.col("doc_id").alias("offset"))).cast("binary")).alias("cursor"))
