"""Where a citation's files are: resolution against listings, pairing of folders, and writing texts.

A listing is a table of paths that any file source gives; look-ups are equi-joins on the candidates' paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, file_stem
from .relational import latest_manifestation
from .store import upsert_manifestations


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def markdown_paths(citations: DataFrame, manifestations: DataFrame, listing: DataFrame) -> DataFrame:
    """(citation_id, path, healed) of the citations(id, doi, bibtex_key, pdf_path) whose Markdown is in listing(path).

    The newest recorded Markdown file if it is there; else, in the folder `markdown` beside the PDF's, the file of the
    citation's stem, else that of its DOI. healed marks files that no manifestation records.
    """
    there = listing.select("path").distinct()
    newest = latest_manifestation(manifestations.select("id", "citation_id", "kind", "path").where("kind = 'markdown-extracted'")).select("citation_id", "path")
    recorded = newest.join(citations.select(F.col("id").alias("citation_id")), "citation_id", "left_semi").join(there, "path", "left_semi").select("citation_id", "path", F.lit(False).alias("healed"))
    folder = F.regexp_extract("pdf_path", r"\A(.*?)/?[^/]*/[^/]*\z", 1)
    names = F.array_distinct(F.array(F.concat(file_stem(F.col("bibtex_key"), F.col("doi")), F.lit(".md")), F.concat(file_name(F.col("doi")), F.lit(".md"))))
    rest = citations.where("pdf_path like '%/%'").select(F.col("id").alias("citation_id"), "doi", "bibtex_key", "pdf_path").join(recorded, "citation_id", "left_anti")
    offered = rest.select("citation_id", folder.alias("folder"), F.posexplode(names).alias("place", "name")).withColumn("path", F.concat("folder", F.lit("/markdown/"), "name"))
    beside = offered.join(there, "path", "left_semi").groupBy("citation_id").agg(F.min_by("path", "place").alias("path")).withColumn("healed", F.lit(True))
    return recorded.unionByName(beside)


def healed(manifestations: DataFrame, found: DataFrame, texts: DataFrame, now: str) -> DataFrame:
    """manifestations with those that markdown_paths found unrecorded, by the hash of texts(path, text); nothing is claimed
    about who extracted them."""
    new = found.where("healed").join(texts.select("path", F.sha2("text", 256).alias("content_hash")), "path")
    return upsert_manifestations(manifestations, new.select("citation_id", F.lit("markdown-extracted").alias("kind"), "path", "content_hash", F.lit(now).cast(dict(manifestations.dtypes)["last_seen_at"]).alias("last_seen_at")))


def folder_pairs(pdfs: DataFrame, pdf_root: str, markdown_root: str, listing: DataFrame) -> DataFrame:
    """(id, pdf_path, markdown_path) of each PDF of pdfs(path): the Markdown file at its relative path if listing(path) has it,
    else the file of its sanitised name at the top."""
    a, b = pdf_root.rstrip("/"), markdown_root.rstrip("/")
    relative = F.regexp_replace(F.substring("path", len(a) + 2, 1 << 20), r"(?i)\.pdf\z", ".md")
    stem = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*\z", "")
    rows = pdfs.select(stem.alias("id"), F.col("path").alias("pdf_path"), F.concat(F.lit(b + "/"), relative).alias("own"), F.concat(F.lit(b + "/"), file_name(stem), F.lit(".md")).alias("other"))
    there = listing.select(F.col("path").alias("own")).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "own", "left").select("id", "pdf_path", F.when(F.col("_there"), F.col("own")).otherwise(F.col("other")).alias("markdown_path"))


def write_texts(texts: DataFrame, root: str) -> None:
    """Writes texts(name, text), each whole, below a folder of its name; a name that is there is replaced."""
    rows = texts.select(F.coalesce("text", F.lit("")).alias("value"), "name")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("name").text(root)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(name, text) as write_texts wrote them."""
    rows = spark.read.schema("value string, name string").option("wholetext", "true").format("text").load(root)
    return rows.select("name", F.regexp_replace("value", r"\n\z", "").alias("text"))
