"""Splitting Markdown into passages that carry the trail of headings above them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import sliced

VERSION = 1
MOST = 2000
HEADING = re.compile(r"(#{1,6})\s+(.*)\Z")
SPACE = " \t\n\r\x0b\x0c\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
CHUNK = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))


def packed(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters: whole paragraphs together as far as they fit; longer ones are cut, and
    a cut's rest may take up the next paragraph."""
    if len(text) <= most:
        return [text]
    out, held = [], ""
    for paragraph in re.split(r"\n{2,}", text):
        joined = f"{held}\n\n{paragraph}" if held else paragraph
        if len(joined) <= most:
            held = joined
            continue
        if held:
            out.append(held)
        full = max(0, -(-len(paragraph) // most) - 1)
        out += [paragraph[k * most : (k + 1) * most] for k in range(full)]
        held = paragraph[full * most :]
    return [p for p in (x.strip(SPACE) for x in [*out, held]) if p]


def chunks_of(markdown: str | None, most: int = MOST) -> list[dict]:
    sections: list[tuple[list[str], list[str]]] = [([], [])]
    trail: list[str] = []
    for line in (markdown or "").split("\n"):
        m = HEADING.match(line)
        if m and "\r" not in m[2]:
            trail = [*trail[: len(m[1]) - 1], m[2].strip(SPACE)]
            sections.append((list(trail), []))
        sections[-1][1].append(line)
    out: list[dict] = []
    for path, lines in sections:
        text = "\n".join(lines).strip(SPACE)
        for piece in packed(text, most) if text else []:
            out.append({"ordinal": len(out), "section_path": path, "text": piece})
    return out


@sliced(CHUNK)
def chunk_arrays(markdown: str | None) -> list[dict]:
    return chunks_of(markdown)


def chunked(documents: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, ordinal, section_path, text) of each document's passages; whole documents, one task each."""
    rows = documents.select(*keys, F.explode(chunk_arrays(F.col(text))).alias("_c"))
    return rows.select(*keys, "_c.ordinal", "_c.section_path", "_c.text")


def heading_trails(lines: DataFrame, key: str = "doc_id", at: str = "line_no", line: str = "line") -> DataFrame:
    """lines with section_path, relationally: headings of a document folded in order (one document's headings
    together, not its text), and joined to the lines below each by a running count."""
    from pyspark.sql import Window as W

    level = F.length(F.regexp_extract(line, r"\A(#{1,6})\s+[^\r]*\z", 1))
    w = W.partitionBy(key).orderBy(at)
    marked = lines.withColumns({"_level": level, "_title": F.regexp_replace(F.regexp_extract(line, r"\A#{1,6}\s+(.*)\z", 1), r"(?U)\A\s+|\s+\z", "")})
    marked = marked.withColumn("_section", F.sum((F.col("_level") > 0).cast("int")).over(w))
    heads = marked.where("_level > 0").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_section", "_level", "_title"))).alias("h"))
    empty = F.array().cast("array<struct<s:bigint,p:array<string>>>")

    def step(acc, x):
        above = F.coalesce(F.try_element_at(acc, F.lit(-1))["p"], F.array().cast("array<string>"))
        return F.concat(acc, F.array(F.struct(x["_section"].alias("s"), F.concat(F.slice(above, F.lit(1), x["_level"] - 1), F.array(x["_title"])).alias("p"))))

    trails = heads.select(key, F.explode(F.aggregate("h", empty, step)).alias("t")).select(key, F.col("t.s").alias("_section"), F.col("t.p").alias("section_path"))
    out = marked.join(trails, [key, "_section"], "left")
    return out.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>"))).drop("_level", "_title", "_section")
