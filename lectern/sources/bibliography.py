"""Reading bibliographies and the answers of bibliographic services, from text columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

ENTRY = "doi string, url string, title string, authors string, year int, journal string, bibtex_key string"


def _value(text: str, at: int) -> tuple[str, int]:
    """A field's value from a place on - braced, quoted or bare pieces joined by # - and the place after it."""
    out = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        if text[at] == "{":
            depth, start = 1, at + 1
            at += 1
            while at < len(text) and depth:
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
            out.append(text[start : at - 1])
        elif text[at] == '"':
            depth, start = 0, at + 1
            at += 1
            while at < len(text) and (text[at] != '"' or depth):
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
            out.append(text[start:at])
            at += 1
        else:
            m = re.compile(r"[^\s,#})]+").match(text, at)
            if not m:
                break
            out.append(m[0])
            at = m.end()
        m = re.compile(r"\s*#").match(text, at)
        if not m:
            break
        at = m.end()
    return "".join(out), at


def parse_bibtex(text: str | None) -> list[dict]:
    """The entries of a BibTeX text; a text that cannot be read has none."""
    text = text or ""
    out, at = [], 0
    for m in re.finditer(r"@\s*(\w+)\s*[{(]", text):
        if m.start() < at or m[1].lower() in ("comment", "preamble", "string"):
            continue
        k = re.compile(r"\s*([^,\s}]*)\s*,?").match(text, m.end())
        key, at, fields = k[1], k.end(), {}
        closed = False
        while at < len(text):
            f = re.compile(r"[\s,]*([^\s=,{}]+)\s*=").match(text, at)
            if not f:
                e = re.compile(r"[\s,]*[})]").match(text, at)
                closed, at = bool(e), e.end() if e else at
                break
            value, at = _value(text, f.end())
            fields.setdefault(f[1].upper(), " ".join(value.split()))
        if not closed:
            return []
        get = lambda *names: next((fields[n] for n in names if fields.get(n)), None)  # noqa: B023, E731
        year = re.match(r"\s*([+-]?\d+)", get("YEAR") or "")
        out.append({"doi": get("DOI"), "url": get("URL"), "title": get("TITLE"), "authors": get("AUTHOR", "AUTHORS"), "year": int(year[1]) if year else None, "journal": get("JOURNAL", "BOOKTITLE", "PUBLISHER"), "bibtex_key": key or None})
    return out


class BibtexSource(DataSource):
    """spark.read.format("bibtex").load(path): one row an entry, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _BibtexReader(self.options["path"])


class _BibtexReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, encoding="utf-8") as f:
            for e in parse_bibtex(f.read()):
                yield tuple(e[c.split()[0]] for c in ENTRY.split(", "))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all BibTeX files under a path that Spark can read, with the file and the place in it."""
    return entries(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), "file")


def entries(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, entry fields) of BibTeX texts(keys, text)."""
    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in ENTRY.split(', '))}>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(parse_bibtex)

    return texts.select(*keys, F.posexplode(parse("text")).alias("seq", "e")).select(*keys, "seq", "e.*")


def pdf_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length and modification time of the PDF files under a folder, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", "length", "modificationTime").orderBy("path")


def text_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, stem and text of the text files under a folder, each whole."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.col("value").alias("text"))


# Answers of services


def atom_entries(xml: Column) -> Column:
    """array<struct<arxiv_id, pdf_url, title>> of an Atom feed."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))

    def one(e: Column) -> Column:
        id_ = F.regexp_extract(e, r"(?s)<id>\s*https?://arxiv\.org/abs/([^<\s]+?)(?:v\d+)?\s*</id>", 1)
        title = F.trim(F.regexp_replace(F.regexp_extract(e, r"(?s)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
        return F.struct(id_.alias("arxiv_id"), F.concat(F.lit("https://arxiv.org/pdf/"), id_).alias("pdf_url"), title.alias("title"))

    return F.filter(F.transform(parts, one), lambda e: e["arxiv_id"] != "")


CROSSREF = "struct<message:struct<title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>>>"
UNPAYWALL = "struct<is_oa:boolean,best_oa_location:struct<url_for_pdf:string>,oa_locations:array<struct<url_for_pdf:string>>>"
SCHOLAR = "struct<title:string,openAccessPdf:struct<url:string>>"


def crossref(body: Column) -> Column:
    """struct(title, authors, year, journal): the year of print, else of online publication."""
    m = F.from_json(body, CROSSREF)["message"]
    year = lambda c: F.get(F.get(m[c]["date-parts"], F.lit(0)), F.lit(0))
    names = F.transform(m["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return F.struct(F.get(m["title"], F.lit(0)).alias("title"), F.array_join(names, " and ").alias("authors"), F.coalesce(year("published-print"), year("published-online")).alias("year"), F.get(m["container-title"], F.lit(0)).alias("journal"))


def unpaywall(body: Column) -> Column:
    """The best PDF URL of an open-access work: the best location's, else the first that any location has."""
    r = F.from_json(body, UNPAYWALL)
    first = F.get(F.filter(F.transform(r["oa_locations"], lambda x: x["url_for_pdf"]), lambda u: u.isNotNull() & (u != "")), F.lit(0))
    return F.when(r["is_oa"], F.coalesce(F.nullif(r["best_oa_location"]["url_for_pdf"], F.lit("")), first))


def scholar(body: Column) -> Column:
    """struct(pdf_url, title)."""
    r = F.from_json(body, SCHOLAR)
    return F.struct(F.nullif(r["openAccessPdf"]["url"], F.lit("")).alias("pdf_url"), r["title"].alias("title"))
