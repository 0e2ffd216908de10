"""Scoring and repairing Markdown; the documents stand for it, with headings and tables made from their lines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import equations as Q2
from ..operators import layout as L
from ..operators import passes as P
from ..operators import quality as Q
from ..operators import repair as R
from ..operators import vectors as V
from .corpus import read, wide
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Lines of a document become headings of level 1 to 4 by place and length, table rows if they have bars.
_MD = "replace(replace(text, chr(10), chr(10) || '## '), '. The ', chr(10) || '#### The ')"
_TABLES = "replace(text, chr(10), chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ')"


def _docs(spark, d, markdown: str = "text", layout: str = "cast(null as string)"):
    return wide(read(spark, d, "documents")).selectExpr("doc_id", f"{markdown} as markdown", f"{layout} as layout")


@query(
    """with l as (select doc_id, string_split_regex(text, '\\r?\\n') as ls, text from documents)
select doc_id, round(greatest(0.0, least(1.0, 1 - 0.15 * len(list_filter(ls, lambda x: length(x) > 250 and len(regexp_extract_all(x, '\\d+(?:\\.\\d+)?')) >= 12 and not regexp_matches(x, '^\\s*\\|'))) - 0.05 * len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) - 0.05)), 3) as score from l"""
)
def artifact_scores(spark, d):
    rows = wide(read(spark, d, "documents"))
    return rows.select("doc_id", F.round(Q.artifact_score(Q.lines_of(F.col("text")), F.col("text")), 3).alias("score"))


@query(
    f"""with h as (select doc_id, list_transform(list_filter(string_split_regex({_MD}, '\\r?\\n'), lambda x: regexp_matches(x, '^#{{1,6}}\\s+\\S')), lambda x: {{'l': length(regexp_extract(x, '^#+')), 't': trim(regexp_replace(x, '^#{{1,6}}\\s+', ''))}}) as h from documents)
select doc_id, len(h) as n_headings, round(greatest(0.0, least(1.0, 1 - 0.12 * len(list_filter(range(2, len(h) + 1), lambda i: h[i].l - h[i - 1].l > 1)) - least(0.2, 0.04 * len(list_filter(h, lambda x: not regexp_matches(x.t, '(?i)[a-z]{{3,}}')))))), 3) as score from h"""
)
def heading_flows(spark, d):
    rows = _docs(spark, d, _MD).select("doc_id", Q.headings(Q.lines_of(F.col("markdown"))).alias("h"))
    return rows.select("doc_id", F.size("h").cast("long").alias("n_headings"), F.round(Q.heading_flow(F.col("h")), 3).alias("score"))


@query(
    """with l as (select doc_id, unnest(string_split_regex(text, '\\r?\\n')) as x from documents), t as (select doc_id, trim(x) as t, len(regexp_extract_all(trim(x), '\\d+(?:\\.\\d+)?')) as n from l),
p as (select doc_id, sum(case when t = '' or regexp_matches(t, '^\\s*\\|.*\\|\\s*$') then 0 else case when length(t) > 260 then 0.15 when length(t) > 180 and n >= 8 then 0.08 else 0 end + case when regexp_matches(t, '(?i)\\b(?:Table|Tab\\.?|Figure|Fig\\.?|Chart)\\s+\\d+[:.]') and length(t) > 180 then 0.15 else 0 end end) as p from t group by doc_id)
select doc_id, round(greatest(0.0, least(1.0, 1 - p)), 2) as score from p"""
)
def readability_scores(spark, d):
    lines = Q.lines_of(F.col("text"))
    return wide(read(spark, d, "documents")).select("doc_id", F.round(Q.readability(lines, Q.reference_lines(lines)), 2).alias("score"))


@query(
    f"""with l as (select doc_id, {_TABLES} as text, len(regexp_extract_all(text, '\\n')) as n from documents), r as (select doc_id, n, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '| 1 | ')) as rows from l)
select doc_id, n as n_tables, len(list_filter(rows, lambda x: ends_with(trim(x), '|') and len(regexp_extract_all(trim(x), '\\|')) = 3 or not ends_with(trim(x), '|'))) as n_valid from r"""
)
def markdown_tables(spark, d):
    rows = _docs(spark, d, _TABLES).select("doc_id", Q.tables(Q.lines_of(F.col("markdown"))).alias("t"))
    return rows.select("doc_id", F.col("t.n").cast("long").alias("n_tables"), F.col("t.valid").cast("long").alias("n_valid"))


@query("select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) as n_words from documents")
def word_counts(spark, d):
    return wide(read(spark, d, "documents")).select("doc_id", Q.word_count(F.col("text")).cast("long").alias("n_words"))


class Word:
    """The k-th word of three to nine letters of a document, for Spark and for DuckDB; a made one where there are fewer."""

    def __init__(self, k: int) -> None:
        self.spark = f"coalesce(get(w, {k - 1}), 'zeta')"
        self.duck = f"coalesce(w[{k}], 'zeta')"

    def __format__(self, how: str) -> str:
        which, shape = how.split("-")
        word = getattr(self, which)
        first, rest = f"substring({word}, 1, 1)", f"substring({word}, 2, 20)"
        return {"T": f"(upper({first}) || lower({rest}))", "l": f"lower({word})"}[shape]


W = {f"w{k}": Word(k) for k in range(1, 9)}
#: The text itself as lines that can be no heading, table row, caption or equation: small letters and single spaces.
#: In Spark as what is kept, joined by spaces: replacing every gap takes seven times as long.
_BODY = {"spark": "lower(trim(regexp_replace(array_join(regexp_extract_all(text, '[A-Za-z\\\\n]+', 0), ' '), ' *\\\\n[ \\\\n]*', chr(10))))", "duck": "lower(trim(regexp_replace(regexp_replace(text, '[^A-Za-z\\n]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g')))"}
#: The text up to its eighth word; W names no later one.
_FIRST_WORDS = r"(?s)\\A(?:.*?[A-Za-z]{3,9}){0,8}"
_FROM = "(select *, regexp_extract_all(text, '[A-Za-z]{3,9}') as w from documents)"


def _both(template: str, which: str) -> str:
    """A template's expression: {w1-T} is a word with a capital, {w1-l} one in small letters, {body} the text, {n} its length."""
    out = re.sub(r"\{(w\d)-(\w)\}", lambda m: format(W[m[1]], f"{which}-{m[2]}"), template)
    return out.replace("{body}", _BODY[which]).replace("{n}", f"cast(length(text) as {'string' if which == 'spark' else 'varchar'})").replace("{nl}", "chr(10)").replace("{m}", f"cast(length(text) % 1000 as {'string' if which == 'spark' else 'varchar'})")


def _made(spark, d, markdown: str = "text", layout: str = "cast(null as string)"):
    rows = wide(read(spark, d, "documents")).withColumn("w", F.expr(f"regexp_extract_all(regexp_extract(text, '{_FIRST_WORDS}', 0), '[A-Za-z]{{3,9}}', 0)"))
    return rows.selectExpr("doc_id", f"{_both(markdown, 'spark')} as markdown", f"{_both(layout, 'spark')} as layout")


def _sql(template: str) -> str:
    return _both(template, "duck")


_LIST = "case doc_id % 3 when 0 then '[1] {w}' when 1 then '## References' || {nl} || '[1] ' || {w1-T} || {nl} || '[2] B [1]' || {nl} || '[3] ' || {w2-l} || {nl} || '# After' || {nl} || '[9] no' else 'References' || {nl} || '1. ' || {w3-T} || {nl} || ' 2. B' || {nl} || 'text' end"


@query("select doc_id, case doc_id % 3 when 0 then 0 when 1 then 3 else 2 end as n_refs from documents")
def reference_counts(spark, d):
    """Lists of references after the whole text."""
    rows = _made(spark, d, "{body} || {nl} || " + _LIST)
    return rows.select("doc_id", Q.reference_count(Q.reference_lines(Q.lines_of(F.col("markdown")))).alias("n_refs"))


@query()
def quality_scores(spark, d):
    """All measures, the document against itself as the layout."""
    return Q.scored(_docs(spark, d, f"case when doc_id % 10 = 0 then '' else {_MD} end", "case when doc_id % 7 = 0 then null else text end"))


@query()
def quality_summary(spark, d):
    return Q.summary(quality_scores(spark, d))


@query(
    """with t as (select doc_id, list_transform(string_split(text, chr(10)), lambda l: list_filter(string_split_regex(trim(l), '\\s+'), lambda w: length(w) >= 2)) as ls, string_split(text, chr(10)) as raw from documents),
b as (select doc_id, raw, list_transform(ls, lambda ws: {'n': len(ws), 'b': len(list_filter(ws, lambda w: not regexp_matches(w, '[a-z]') and regexp_matches(w, '[A-Z]') and (regexp_matches(w, '[$%''/*+&^]') or length(w) >= 5 and regexp_matches(w, '[0-9]'))))}) as k from t)
select doc_id, array_to_string(list_filter(raw, lambda x, i: not (k[i].n >= 3 and k[i].b >= 3 and k[i].b * 2 >= k[i].n)), chr(10)) as markdown from b"""
)
def garble_removed(spark, d):
    return wide(read(spark, d, "documents")).select("doc_id", R.glyph_garble(F.col("text")).alias("markdown"))


_PAGE = "'1. Topic ' || {w1-T} || ' ' || {w2-T} || {nl} || {body} || {nl} || '2.1 Topic ' || {w3-T} || ' and ' || {w4-T} || '    B. ' || {w5-T} || ' Part' || {nl} || 'Table 2: Numbers' || {nl} || {nl} || '  name     value' || {nl} || '  ' || {w6-l} || '   ' || {n} || {nl} || '  ' || {w7-l} || '   7' || {nl} || chr(12) || {body} || {nl} || '   y = a + ' || {n} || '       (4)' || {nl} || 'REFERENCES' || {nl} || '3. ' || {w8-T} || ' Last'"
_HEADS = ["'1. Topic ' || {w1-T} || ' ' || {w2-T}", "'2.1 Topic ' || {w3-T} || ' and ' || {w4-T}", "'B. ' || {w5-T} || ' Part'", "'REFERENCES'"]


@query(f"select doc_id, unnest([{_sql(', '.join(_HEADS))}]) as text, unnest([2, 3, 3, 2]) as level, unnest([1, 1, 1, 2]) as page from {_FROM}")
def layout_headings(spark, d):
    return _made(spark, d, "text", _PAGE).select("doc_id", F.explode(L.layout_headings(F.col("layout"))).alias("h")).select("doc_id", "h.*")


_GRID = "'| name | value |' || {nl} || '| --- | --- |' || {nl} || '| ' || {w6-l} || ' | ' || {n} || ' |' || {nl} || '| ' || {w7-l} || ' | 7 |'"


@query(f"select doc_id, '2' as number, 1 as page, {_sql(_GRID)} as markdown from {_FROM}")
def layout_tables(spark, d):
    return _made(spark, d, "text", _PAGE).select("doc_id", F.explode(L.layout_tables(F.col("layout"))).alias("t")).select("doc_id", "t.*")


@query(f"select doc_id, '4' as label, 2 as page, 'y = a + ' || {_sql('{n}')} as latex from {_FROM}")
def layout_equations(spark, d):
    return _made(spark, d, "text", _PAGE).select("doc_id", F.explode(L.layout_equations(F.col("layout"))).alias("e")).select("doc_id", "e.*")


@query(f"select doc_id, [{_sql(_HEADS[2])}, 'REFERENCES'] as missing from {_FROM}")
def missing_headings(spark, d):
    rows = _made(spark, d, "{body} || {nl} || '## topic ' || {w1-l} || ' ' || {w2-T} || {nl} || '### 2.1. Topic ' || {w3-T} || ' And ' || {w4-l}", _PAGE)
    return rows.select("doc_id", L.missing_headings(F.col("layout"), Q.section_headings(Q.lines_of(F.col("markdown")))).alias("missing"))


_TEXT = "{body} || {nl} || 'As Table 2 shows, all is well.' || {nl} || {nl} || 'Table 2: Numbers' || {nl} || {nl} || 'name value ' || {w6-l} || ' ' || {n} || ' ' || {w7-l} || ' 7 end' || {nl} || {nl} || 'Prose.'"


@query(f"select doc_id, {_sql("{body} || {nl} || 'As Table 2 shows, all is well.' || {nl} || {nl} || 'Table 2: Numbers' || {nl} || {nl} || ")}{_sql(_GRID)} || chr(10) || chr(10) || 'Prose.' as markdown from {_FROM}")
def tables_spliced(spark, d):
    """A table's remains below its caption give way to the layout's table."""
    return _made(spark, d, _TEXT, _PAGE).select("doc_id", L.with_layout_columns(L.tables_spliced, F.col("markdown"), F.col("layout")).alias("markdown"))


@query(f"select doc_id, {_sql("{body} || {nl} || '## 1. Topic ' || {w1-T} || ' ' || {w2-T} || {nl} || {nl} || 'goes on.' || {nl} || 'It ends.' || {nl} || {nl} || '### 2.1 Topic ' || {w3-T} || ' and ' || {w4-T}")} as markdown from {_FROM}")
def headings_promoted(spark, d):
    """Headings welded into prose, cut out of it and set at their level."""
    rows = _made(spark, d, "{body} || {nl} || '1. Topic ' || {w1-T} || ' ' || {w2-T} || ' goes on.' || {nl} || 'It ends. 2.1 Topic ' || {w3-T} || ' and ' || {w4-T}", _PAGE)
    return rows.select("doc_id", L.with_layout_columns(lambda m, x: L.headings_promoted(m, L.headings(x)[:2]), F.col("markdown"), F.col("layout")).alias("markdown"))


_SOURCE = "{body} || {nl} || {w1-l} || ' = b + c + d  (1)' || {nl} || 'x = y - z  (2)' || {nl} || 'p = q + r  (3)' || {nl} || 'u = v + w  (4)' || {nl} || 'k = 2 m + ' || {n} || '  (5)'"
_MATH = "{body} || {nl} || '$$' || {nl} || {w1-l} || ' = b + c + d \\\\tag{1}' || {nl} || '$$' || {nl} || 'x = y - z  (2)' || {nl} || '$$' || {nl} || 'f(g) h j ' || {n} || ' \\\\tag{3}' || {nl} || '$$' || {nl} || '$$ Equation not extracted \\\\tag{4} $$'"


@query("select doc_id, unnest(['1', '2', '3', '4', '5']) as label, unnest(['matched', 'format-issue', 'content-mismatch', 'placeholder', 'missing']) as status from documents")
def equation_statuses(spark, d):
    """Equations after the whole text, each in another state."""
    return Q2.compared(_made(spark, d, _MATH, _SOURCE)).select("doc_id", "label", "status")


_LINES = "len(string_split({}, chr(10)))"


@query(f"with t as (select doc_id, {_LINES.format(_BODY['duck'])} as n from {_FROM}) select doc_id, cast(n + unnest([2, 4, 4, 5, 8]) as integer) as line, unnest(['row ends at the equals sign', 'fraction stacked in rows', 'superscript without a base or exponent', 'row begins with an operator', 'display math is not closed']) as message from t")
def render_issues(spark, d):
    """Faults of display math after the whole text."""
    text = "{body} || {nl} || '$$' || {nl} || 'y = \\\\\\\\' || {nl} || 'a = b' || {nl} || 'k ^' || {nl} || '+ 2' || {nl} || 'z = 1' || {nl} || '$$' || {nl} || '$$' || {nl} || {w1-l}"
    return _made(spark, d, text).select("doc_id", F.explode(Q2.render_issues(F.col("markdown"))).alias("i")).select("doc_id", "i.*")


_NOTED = "'Some text that goes on and on. Figure 3: a caption' || chr(10) || text || chr(10) || 'as we see in Table 4: not this'"


@query("select doc_id, 'Some text that goes on and on.' || chr(10) || chr(10) || 'Figure 3: a caption' || chr(10) || text || chr(10) || 'as we see in Table 4: not this' as markdown from documents")
def captions_apart(spark, d):
    return _docs(spark, d, _NOTED).select("doc_id", R.block_pass("captions_apart", F.col("markdown")).alias("markdown"))


@query(f"select doc_id, {_sql("{body} || {nl} || '| a | ' || {w1-l} || ' |' || {nl} || '| --- | --- |' || {nl} || '| 1 | ' || {n} || ' |' || {nl} || 'end'")} as markdown from {_FROM}")
def tables_ruled(spark, d):
    return _made(spark, d, "{body} || {nl} || 'a   ' || {w1-l} || {nl} || '1    ' || {n} || {nl} || 'end'").select("doc_id", R.block_pass("tables_ruled", F.col("markdown")).alias("markdown"))


@query(f"select doc_id, {_sql("{body} || {nl} || '## References' || {nl} || {nl} || '1. One ' || {n} || {nl} || '2. ' || {w1-T} || ' three'")} as markdown from {_FROM}")
def references_listed(spark, d):
    refs = "case doc_id % 3 when 0 then '[1] One ' || {n} || ' [2] ' || {w1-T} || {nl} || 'three' when 1 then '1. One ' || {n} || {nl} || '2. ' || {w1-T} || ' three' else '- One ' || {n} || {nl} || '* ' || {w1-T} || {nl} || ' three' end"
    return _made(spark, d, "{body} || {nl} || '# 7. References' || {nl} || " + refs).select("doc_id", R.block_pass("references_listed", F.col("markdown")).alias("markdown"))


_TABLE = "'| a | ' || {w1-l} || ' |' || {nl} || '|---|---|' || {nl} || '| 1 | ' || {n} || ' |' || {nl}"


@query(f"select doc_id, {_sql("'x' || {nl} || " + _TABLE + " || {nl} || {w2-l} || {nl} || 'end'")} as markdown from {_FROM}")
def tables_once(spark, d):
    return _made(spark, d, f"'x' || {{nl}} || {_TABLE} || {{nl}} || {{w2-l}} || {{nl}} || replace({_TABLE}, ' 1', '  1') || 'end'").select("doc_id", R.block_pass("tables_once", F.col("markdown")).alias("markdown"))


_HEADED = "'# ' || {w1-T} || ' ' || {w2-T} || {nl} || '### ' || {w3-T} || ' University' || {nl} || '## ABSTRACT' || {nl} || {body} || {nl} || '#### II. ' || {w4-T} || {nl} || '# 2.1 ' || {w5-T} || {nl} || '##### wrapped line of prose in ' || {w6-l} || {nl} || '### METHOD AND DATA' || {nl} || '## = ' || {w7-l}"
_REHEADED = "'# ' || {w1-T} || ' ' || {w2-T} || {nl} || {w3-T} || ' University' || {nl} || '## Abstract' || {nl} || {body} || {nl} || '## II. ' || {w4-T} || {nl} || '### 2.1 ' || {w5-T} || {nl} || 'wrapped line of prose in ' || {w6-l} || {nl} || '## METHOD AND DATA' || {nl} || '= ' || {w7-l}"


@query(f"select doc_id, {_sql(_REHEADED)} as markdown from {_FROM}")
def headings_repaired(spark, d):
    return _made(spark, d, _HEADED).select("doc_id", R.block_pass("headings_repaired", F.col("markdown")).alias("markdown"))


_INLINE = "{body} || {nl} || '## Next' || {nl} || 'as is shown by the loss L = a + ' || {n} || ' (3) and so on' || {nl} || 'x = y - ' || {n} || ', (4)'"
_BLOCKED = "{body} || {nl} || '## Next' || {nl} || 'as is shown by the loss' || {nl} || {nl} || '$$' || {nl} || 'L = a + ' || {n} || {nl} || '\\tag{3}' || {nl} || '$$' || {nl} || {nl} || 'and so on' || {nl} || {nl} || '$$' || {nl} || 'x = y - ' || {n} || {nl} || '\\tag{4}' || {nl} || '$$' || {nl}"


@query(f"select doc_id, {_sql(_BLOCKED)} as markdown from {_FROM}")
def equations_blocked(spark, d):
    return _made(spark, d, _INLINE).select("doc_id", R.block_pass("equations_blocked", F.col("markdown")).alias("markdown"))


_FIGURED = "{body} || {nl} || 'Figure 2: The ' || {w1-l} || {nl} || 'as in Fig. 2 here'"
_FIGURE_PAGES = "{body} || chr(12) || 'Figure 2: The ' || {w1-l} || {nl} || {nl} || 'Figure 3. A long-' || {nl} || 'er ' || {w2-l}"


@query(f"select doc_id, {_sql("{body} || {nl} || 'Figure 2: The ' || {w1-l} || {nl} || {nl} || '> Figure source: [PDF page 2](../pdf/a%20b.pdf#page=2)' || {nl} || 'as in Fig. 2 here'")} as markdown from {_FROM}")
def figures_linked(spark, d):
    return _made(spark, d, _FIGURED, _FIGURE_PAGES).select("doc_id", L.with_layout_columns(lambda m, x: P.figures_linked(m, x, "/p/a b.pdf"), F.col("markdown"), F.col("layout")).alias("markdown"))


@query(f"select doc_id, {_sql(_FIGURED + " || {nl} || {nl} || 'Figure 3. A longer ' || {w2-l} || {nl} || {nl} || '> Figure source: [PDF page 2](../pdf/a%20b.pdf#page=2) — source image not extracted' || {nl}")} as markdown from {_FROM}")
def placeholders_added(spark, d):
    return _made(spark, d, _FIGURED, _FIGURE_PAGES).select("doc_id", L.with_layout_columns(lambda m, x: P.placeholders_added(m, x, "/p/a b.pdf"), F.col("markdown"), F.col("layout")).alias("markdown"))


@query(f"select doc_id, {_sql("{w1-T} || ' goes on' || {nl} || 'and on.' || {nl} || {nl} || {w2-T} || ' begins' || {nl} || {nl} || '- item' || {nl} || {nl} || {body}")} as markdown from {_FROM}")
def spacing_closed(spark, d):
    return _made(spark, d, "{w1-T} || ' goes on' || {nl} || {nl} || 'and on.' || {nl} || {nl} || {w2-T} || ' begins' || {nl} || {nl} || '- item' || {nl} || {nl} || {body}").select("doc_id", R.block_pass("spacing_closed", F.col("markdown")).alias("markdown"))


_STUMBLES = f"""with l as (select doc_id, string_split({_BODY['duck']}, chr(10)) as l from {_FROM}),
i as (select doc_id, unnest(range(1, len(l) + 1)) as k, unnest(l) as x, 'high' as severity, 'very long line is hard for an agent to scan and quote precisely' as message from l),
a as (select doc_id, k, severity, message from i where length(trim(x)) > 260 union all select doc_id, len(l) + 1, 'medium', 'wrapped body text was emitted as a deep heading' from l)"""


@query(f"{_STUMBLES} select doc_id, cast(k as integer) as line, severity, message from a qualify row_number() over (partition by doc_id order by k) <= 50")
def readability_issues(spark, d):
    rows = Q.issue_rows(_made(spark, d, "{body} || {nl} || '#### wrapped line of prose in ' || {w1-l}"))
    return rows.select("doc_id", "line", "severity", "message")


@query()
def documents_repaired(spark, d):
    """All passes over the documents."""
    return wide(read(spark, d, "documents")).select("doc_id", R.all_passes(F.col("text")).alias("markdown"))


_LAYOUT = "'Journal of ' || {w1-T} || ' ' || {m} || {nl} || {body} || chr(12) || '12 Journal of ' || {w1-T} || ' ' || {m} || {nl} || 'b' || chr(12) || 'Journal of  ' || {w1-T} || ' 14'"


@query(f"select doc_id, {_sql("'Journal of ' || {w1-T}")} as header from {_FROM}")
def running_headers(spark, d):
    return R.running_headers(_made(spark, d, "text", _LAYOUT))


@query("select doc_id, replace(text, '. ', chr(10)) as markdown from documents")
def headers_removed(spark, d):
    rows = _made(spark, d, "'3 Journal of ' || {w1-T} || {nl} || replace(text, '. ', {nl})", _LAYOUT)
    return R.without_headers(rows.select("doc_id", "markdown"), R.running_headers(rows))


@query("select doc_id, regexp_replace(replace(text, '. ', chr(10) || chr(10) || ' ' || chr(10) || 'X'), '\\n[ \\t]*\\n([ \\t]*\\n)+', chr(10) || chr(10), 'g') as markdown from documents")
def blank_lines_compacted(spark, d):
    return wide(read(spark, d, "documents")).select("doc_id", R.blank_runs(F.expr("replace(text, '. ', chr(10) || chr(10) || ' ' || chr(10) || 'X')")).alias("markdown"))


@query("with q as (select embedding as q from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) as similarity from embeddings, q")
def cosine_similarities(spark, d):
    rows = read(spark, d, "embeddings")
    q = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return rows.join(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query(
    """with r as (select 'a' as ranking, vec_id as id, cast(vec_id * 7919 % 1009 as double) as score from embeddings union all select 'b', vec_id, cast(vec_id * 104729 % 997 as double) from embeddings),
p as (select id, row_number() over (partition by ranking order by score desc, id) as p from r) select id, round(sum(1.0 / (60 + p)), 9) as score from p group by id"""
)
def fused_rankings(spark, d):
    e = read(spark, d, "embeddings")
    one = lambda name, k, m: e.select(F.lit(name).alias("ranking"), F.col("vec_id").alias("id"), (F.col("vec_id") * k % m).cast("double").alias("score"))
    return V.fused(one("a", 7919, 1009).unionByName(one("b", 104729, 997))).select("id", F.round("score", 9).alias("score"))


