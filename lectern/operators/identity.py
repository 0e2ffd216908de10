"""Whether two records are one work: titles, and the evidence for a bibliography entry in a local file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import compared_titles, doi, last_names, significant_words, title, title_similarity, valid_doi
from .relational import histogram

#: Least similarity for a search by title, and for a look-up by DOI.
SEARCH_THRESHOLD, LOOKUP_THRESHOLD = 0.9, 0.5


def best_title(pairs: DataFrame, key: str, threshold: float = SEARCH_THRESHOLD) -> DataFrame:
    """For each key of pairs(key, pos, expected, actual), the first candidate of highest similarity that reaches
    the threshold and is over zero."""
    rows = pairs.withColumn("similarity", title_similarity(F.col("expected"), F.col("actual"))).where((F.col("similarity") >= threshold) & (F.col("similarity") > 0))
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("similarity"), "pos"))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def similar_titles(entries: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """(key, pos, similarity) of all pairs of entries(key, title, by) and candidates(pos, title, by) with equal, not null, by.

    Titles are normalised once a row, and an entry is compared once with each distinct title of its group. There are as
    many rows as pairs, so they grow with the square of a group; no task holds more than one title's candidates.
    """
    titles = candidates.select(*by, title(F.col("title")).alias("_y"), "pos").groupBy(*by, "_y").agg(F.collect_list(F.struct("pos")).alias("_all"))
    rows = entries.select("key", *by, title(F.col("title")).alias("_x")).join(titles, by)
    rows = rows.select("key", compared_titles(F.col("_x"), F.col("_y")).alias("similarity"), "_all")
    return rows.select("key", "similarity", F.inline("_all")).select("key", "pos", "similarity")


def best_in_group(rows: DataFrame, by: list[str], threshold: float = SEARCH_THRESHOLD) -> DataFrame:
    """(key, pos, similarity) of rows(key, title, by): each key's most similar other key of its group, the least among
    equals, if it reaches the threshold and is over zero; the same rows as best_title over all pairs.

    Only distinct titles of a group are compared. Of a title's keys the two least can be best, as a key rules out none
    but itself; of all that a title finds, the two best.
    """
    t = rows.select("key", *by, title(F.col("title")).alias("_x"))
    known = t.select(*by, "_x", "key").distinct()
    first = known.where("key is not null").withColumn("_nth", F.row_number().over(W.partitionBy(*by, "_x").orderBy("key"))).where("_nth <= 2")
    theirs = first.select(*by, F.col("_x").alias("_y"), F.col("key").alias("pos")).groupBy(*by, "_y").agg(F.sort_array(F.collect_list("pos")).alias("_two"))
    pairs = known.select(*by, "_x").distinct().join(theirs, by).withColumn("similarity", compared_titles(F.col("_x"), F.col("_y")))
    pairs = pairs.where((F.col("similarity") >= threshold) & (F.col("similarity") > 0)).select(*by, "_x", "similarity", F.explode("_two").alias("pos"))
    pairs = pairs.groupBy(*by, "_x", "pos").agg(F.max("similarity").alias("similarity"))
    nth = F.row_number().over(W.partitionBy(*by, "_x").orderBy(F.desc("similarity"), "pos"))
    best = pairs.withColumn("_nth", nth).where("_nth <= 2").groupBy(*by, "_x").agg(F.sort_array(F.collect_list(F.struct("_nth", "pos", "similarity"))).alias("_two"))
    other = F.filter("_two", lambda c: c["pos"] != F.col("key"))
    found = t.join(best, [*by, "_x"]).select("key", F.get(other, F.lit(0)).alias("c")).where("c is not null")
    one = found.groupBy("key").agg(F.min_by("c", F.struct(-F.col("c.similarity"), F.col("c.pos"))).alias("c"))
    return one.select("key", F.col("c.pos").alias("pos"), F.col("c.similarity").alias("similarity"))


def title_in_body(title_: Column, body: Column) -> Column:
    """A title of ten characters or more is in a comparable body whole, or seven in ten of its three or more
    significant words are."""
    words = significant_words(title_)
    present = F.size(F.filter(words, lambda w: F.contains(body, w)))
    return (F.length(title(title_)) >= 10) & (F.contains(body, title(title_)) | (F.size(words) >= 3) & (present >= F.ceil(F.size(words) * 0.7)))


def evidence(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry_id, file_id, has_doi, has_title, has_year, n_authors, strong) for entries and files that share anything
    a strong match needs.

    A strong match has the DOI as a substring of the text, or the title and the year or an author. Entries and
    files meet over the first eight characters of the DOI, or over the title's significant words: each is matched
    once with the distinct words of all texts that contain it, and a file with enough of an entry's words (seven in
    ten; all of fewer than three) is looked at. A title without significant words is offered by all its words.
    """
    e = entries.select("entry_id", doi(F.col("doi")).alias("doi"), "title", F.col("year").cast("string").alias("year"), "authors")
    t = files.select("file_id", F.lower("text").alias("raw"), title(F.col("text")).alias("body"))
    piece = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda k: F.substring(c, k, F.lit(n))))
    by_doi = e.where("doi like '10.%'").select("entry_id", F.substring(F.lower("doi"), 1, 8).alias("g"))
    starts = F.regexp_extract_all("raw", F.lit(r"(?s)(?=(10\..{5}))"), F.lit(1))
    of_raw = t.where(F.contains("raw", F.lit("10."))).select("file_id", F.explode(F.array_distinct(starts)).alias("g"))
    long = F.size(significant_words(F.col("title"))) > 0
    offered = F.when(long, significant_words(F.col("title"))).otherwise(F.split(title(F.col("title")), " "))
    words = e.select("entry_id", long.alias("long"), F.size(offered).alias("n"), F.explode(offered).alias("w")).where("w <> ''")
    words = words.groupBy("entry_id", "long", "n", "w").agg(F.count(F.lit(1)).alias("times"))
    of_body = t.select("file_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    pieces = of_body.select("word").distinct().select("word", F.explode(piece(F.col("word"), 4)).alias("g"))
    asked = words.select("w", F.substring("w", 1, 4).alias("g")).distinct()
    inside = pieces.join(asked, "g").where(F.contains("word", F.col("w"))).select("word", "w").distinct()
    held = of_body.join(inside, "word").select("file_id", "w").distinct().join(words, "w")
    held = held.groupBy("entry_id", "file_id", "long", "n").agg(F.sum("times").alias("got"))
    enough = F.when(~F.col("long"), F.lit(1)).when(F.col("n") < 3, F.col("n")).otherwise(F.ceil(F.col("n") * 0.7))
    pairs = of_raw.join(by_doi, "g").select("entry_id", "file_id").unionByName(held.where(F.col("got") >= enough).select("entry_id", "file_id")).distinct()
    rows = pairs.join(e, "entry_id").join(t, "file_id")
    names = last_names(F.col("authors"))
    rows = rows.select(
        "entry_id",
        "file_id",
        ((F.col("doi") != "") & F.contains("raw", F.lower("doi"))).alias("has_doi"),
        title_in_body(F.col("title"), F.col("body")).alias("has_title"),
        F.coalesce(F.contains("raw", F.col("year")), F.lit(False)).alias("has_year"),
        F.size(F.filter(names, lambda a: F.contains("body", a))).alias("n_authors"),
    )
    return rows.withColumn("strong", F.col("has_doi") | F.col("has_title") & (F.col("has_year") | (F.col("n_authors") > 0)))


def local_check(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry_id, status) of each entry: skipped without a valid DOI, matched by one file, ambiguous by several,
    mismatch if only a file of an expected name is there, else missing."""
    found = evidence(entries, files).where("strong").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    from ..functions.text import file_name, file_stem

    names = entries.select("entry_id", F.explode(F.array_distinct(F.array(F.concat(file_stem(F.col("bibtex_key"), F.col("doi")), F.lit(".pdf")), F.concat(file_name(doi(F.col("doi"))), F.lit(".pdf"))))).alias("name"))
    expected = names.join(files.select("name"), "name", "left_semi").select("entry_id").distinct().withColumn("expected", F.lit(True))
    rows = entries.join(found, "entry_id", "left").join(expected, "entry_id", "left")
    status = (
        F.when(~F.coalesce(valid_doi(F.col("doi")), F.lit(False)), "skipped").when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").when(F.col("expected"), "mismatch").otherwise("missing")
    )
    return rows.select("entry_id", status.alias("status"))


STATUSES = ["matched", "missing", "mismatch", "ambiguous", "skipped"]


def local_summary(result: DataFrame) -> DataFrame:
    """One row: entries in all and by status."""
    return histogram(result, "status", STATUSES)
