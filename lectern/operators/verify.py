"""Checking quotes: verbatim up to typography in a document, close to a passage, or not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalized, quote_tokens, rounded
from .search import build_index, candidates

LEAST_LENGTH = 10
MOST_MATCHES = 5
RADIUS = 150
CLOSE = 0.8


def snippet(text: Column, at: Column, length: Column) -> Column:
    """The match (from 1) with up to RADIUS characters on each side."""
    start = F.greatest(F.lit(1), at - RADIUS)
    stop = F.least(F.length(text), at + length - 1 + RADIUS)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, stop - start + 1), F.when(stop < F.length(text), "…").otherwise(""))


def excerpt(text: Column) -> Column:
    return F.when(F.length(text) <= 2 * RADIUS, text).otherwise(F.concat(F.substring(text, 1, 2 * RADIUS), F.lit("…")))


def needles(quotes: DataFrame, compose: bool = True) -> DataFrame:
    """quotes(quote_id, quote) with `needle`, the normalised quote."""
    return quotes.select("quote_id", normalized(F.col("quote"), compose).alias("needle"))


def containing(needled: DataFrame, texts: DataFrame, key: str, text: str = "norm") -> DataFrame:
    """Pairs (quote_id, needle, key, text, at) of normalised texts that contain a needle.

    No text is compared with every needle. A text with the needle has each of the needle's inner words whole; the
    one that fewest texts have (its anchor) is joined with the texts' distinct words, and only pairs that share it are
    searched; a needle with an inner word that no text has is in none. Needles of one or two words have no inner
    word: their longest half is compared with the words' own substrings only if there are any such needles, by a join
    on the word's letters.
    """
    words = F.split("needle", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    each = texts.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("anchor"))
    offered = needled.select("quote_id", "needle", F.explode(F.array_distinct(inner)).alias("anchor"))
    # Dealt by word once; the count and the join below read the same shuffle.
    near = each.join(offered.select("anchor").distinct(), "anchor", "left_semi").repartition("anchor")
    holders = near.groupBy("anchor").agg(F.count(F.lit(1)).alias("held"))
    rated = offered.join(holders, "anchor", "left").groupBy("quote_id", "needle").agg(F.min_by("anchor", F.struct("held", "anchor")).alias("anchor"), F.bool_and(F.col("held").isNotNull()).alias("known"))
    long = rated.where("known").drop("known")
    pairs = near.join(long, "anchor").select("quote_id", "needle", key)
    marked = needled.withColumn("anchor", F.get(inner, F.lit(0)))
    short = marked.where("anchor is null").select("quote_id", "needle")
    # The first word of a short needle ends a word of the text, the last begins one: join on suffixes of its length.
    head = F.element_at(F.split("needle", " "), 1)
    grams = texts.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word"))
    first3 = short.withColumn("gram", F.substring(head, 1, 3))
    spread = grams.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda k: F.substring("word", k, F.lit(3))))))
    some = spread.join(first3, "gram").where(F.contains("word", head)).select("quote_id", "needle", key).distinct()
    both = pairs.unionByName(some) if not short.isEmpty() else pairs
    found = both.join(texts, key).withColumn("at", F.expr(f"locate(needle, `{text}`)"))
    return found.where("at > 0")


def exact_matches(quotes: DataFrame, documents: DataFrame, compose: bool = True, most: int = MOST_MATCHES) -> DataFrame:
    """(quote_id, doc_id, nth, snippet): for each quote the first documents that have it, newest first.

    documents(doc_id, created_at, text); quotes(quote_id, quote). Quotes under LEAST_LENGTH characters match none.
    """
    n = needles(quotes, compose).where(F.length("needle") >= LEAST_LENGTH)
    texts = documents.select("doc_id", "created_at", normalized(F.col("text"), compose).alias("norm"))
    hits = containing(n, texts, "doc_id")
    nth = F.row_number().over(W.partitionBy("quote_id").orderBy(F.desc("created_at"), F.desc("doc_id")))
    return hits.withColumn("nth", nth).where(F.col("nth") <= most).select("quote_id", "doc_id", "nth", snippet(F.col("norm"), F.col("at"), F.length("needle")).alias("snippet"))


def _rated(quotes: DataFrame, chunks: DataFrame, compose: bool, stemmed: bool, index, only: DataFrame | None) -> DataFrame:
    """Candidates of each quote with their similarity and normalised text: the ten passages of best rank (of those that
    only(quote_id, chunk_id) names, where it names any) for any of the quote's first eight distinct words of four
    characters or more."""
    from ..functions.porter import plain_terms, stemmed_terms

    postings, lengths = index or build_index(chunks, "chunk_id", ["text"], stemmed)
    n = needles(quotes, compose).where(F.length("needle") >= LEAST_LENGTH)
    first8 = F.slice(F.array_distinct(F.filter(F.split("needle", " "), lambda w: F.length(w) >= 4)), 1, 8)
    asked = n.select(F.col("quote_id").alias("query_id"), (stemmed_terms if stemmed else plain_terms)(F.array_join(first8, " ")).alias("terms"))
    within = only.withColumnRenamed("quote_id", "query_id") if only is not None else None
    top = candidates(asked, postings, lengths, "chunk_id", within=within).withColumnRenamed("query_id", "quote_id")
    rows = top.join(n, "quote_id").join(chunks.withColumn("norm", normalized(F.col("text"), compose)).drop("text"), "chunk_id")
    own, other = quote_tokens(F.col("needle")), quote_tokens(F.col("norm"))
    rows = rows.withColumn("similarity", rounded(F.size(F.array_intersect(own, other)) / F.size(own), 2))
    rows = rows.where((F.col("similarity") >= CLOSE) & (F.col("similarity") < 1))
    nth = F.row_number().over(W.partitionBy("quote_id").orderBy(F.desc("similarity"), "nth"))
    return rows.withColumn("place", nth).where(F.col("place") <= MOST_MATCHES)


def close_matches(quotes: DataFrame, chunks: DataFrame, compose: bool = True, stemmed: bool = True, index=None, only: DataFrame | None = None) -> DataFrame:
    """(quote_id, chunk_id, nth, similarity): passages with most, but not all, of a quote's words; similarity is the share
    of the quote's distinct words they have, to two places."""
    rows = _rated(quotes, chunks.select("chunk_id", "text"), compose, stemmed, index, only)
    return rows.select("quote_id", "chunk_id", F.col("place").alias("nth"), "similarity")


def verdicts(quotes: DataFrame, documents: DataFrame, chunks: DataFrame | None = None, compose: bool = True, stemmed: bool = True) -> DataFrame:
    """(quote_id, verdict, n_matches) for every quote: exact, close-match, not-found or quote-too-short."""
    n = needles(quotes, compose)
    exact = exact_matches(quotes, documents, compose).groupBy("quote_id").agg(F.count(F.lit(1)).alias("exact"))
    out = n.join(exact, "quote_id", "left")
    if chunks is None:
        out = out.withColumn("close", F.lit(None).cast("long"))
    else:
        out = out.join(close_matches(quotes, chunks, compose, stemmed).groupBy("quote_id").agg(F.count(F.lit(1)).alias("close")), "quote_id", "left")
    verdict = F.when(F.length("needle") < LEAST_LENGTH, "quote-too-short").when(F.col("exact") > 0, "exact").when(F.col("close") > 0, "close-match").otherwise("not-found")
    return out.select("quote_id", verdict.alias("verdict"), F.coalesce("exact", "close", F.lit(0)).alias("n_matches"))


def provenance(hits: DataFrame, chunks: DataFrame, compose: bool = True) -> DataFrame:
    """hits(quote_id, needle, doc_id) with chunk_ordinal and section_path of the document's first passage that has
    the needle whole; nulls if it straddles two."""
    texts = chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "ordinal", "section_path", normalized(F.col("text"), compose).alias("_n"))
    own = hits.select("quote_id", "needle", "doc_id").join(texts, "doc_id").where("contains(_n, needle)")
    first = own.groupBy("quote_id", "doc_id").agg(F.min_by(F.struct("ordinal", "section_path"), "ordinal").alias("c"))
    return hits.join(first, ["quote_id", "doc_id"], "left").select(*hits.columns, F.col("c.ordinal").alias("chunk_ordinal"), F.col("c.section_path").alias("section_path"))


MATCH = "struct<doi: string, similarity: double, snippet: string, section_path: array<string>, chunk_ordinal: int>"


def checked(quotes: DataFrame, citations: DataFrame, texts: DataFrame, chunks: DataFrame, compose: bool = True, stemmed: bool = True, index=None) -> DataFrame:
    """(quote_id, status, verdict, matches array<MATCH>) for every row of quotes(quote_id, quote, doi).

    citations(id, doi, created_at), texts(citation_id, text) are the documents, chunks(chunk_id, citation_id, ordinal,
    section_path, text) their passages. A quote with a DOI is looked for in that document, or in its passages if it
    has no text: its status is unknown-doi without such a citation, no-markdown without either. Other quotes are
    looked for in all documents, and the five newest that have it are told. Without an exact match, close passages
    are. Quotes under LEAST_LENGTH normalised characters are quote-too-short.
    """
    n = quotes.select("quote_id", "doi", normalized(F.col("quote"), compose).alias("needle")).withColumn("short", F.length("needle") < LEAST_LENGTH)
    who = citations.select(F.col("id").alias("doc_id"), F.col("doi").alias("of"), "created_at")
    asked = n.where("doi is not null and not short").join(who.withColumnRenamed("of", "doi"), "doi", "left")
    with_text = texts.select(F.col("citation_id").alias("doc_id")).distinct().withColumn("has_text", F.lit(True))
    with_chunks = chunks.select(F.col("citation_id").alias("doc_id")).distinct().withColumn("has_chunks", F.lit(True))
    asked = asked.join(with_text, "doc_id", "left").join(with_chunks, "doc_id", "left")

    norm = texts.join(who, texts["citation_id"] == who["doc_id"]).select("doc_id", "of", "created_at", normalized(F.col("text"), compose).alias("norm"))
    every = containing(n.where("doi is null and not short").select("quote_id", "needle"), norm, "doc_id")
    nth = F.row_number().over(W.partitionBy("quote_id").orderBy(F.desc("created_at"), F.desc("doc_id")))
    every = every.withColumn("place", nth).where(F.col("place") <= MOST_MATCHES)
    one = asked.where("has_text").select("quote_id", "needle", "doc_id").join(norm, "doc_id").withColumn("at", F.expr("locate(needle, norm)")).where("at > 0").withColumn("place", F.lit(1))
    of_text = every.select("quote_id", "needle", "doc_id", "of", "norm", "at", "place").unionByName(one.select("quote_id", "needle", "doc_id", "of", "norm", "at", "place"))
    of_text = of_text.select("quote_id", "needle", "doc_id", "of", "place", snippet(F.col("norm"), F.col("at"), F.length("needle")).alias("snippet"))
    parts = chunks.withColumnRenamed("citation_id", "doc_id")
    of_text = provenance(of_text, parts, compose)

    bare = asked.where("has_text is null and has_chunks").select("quote_id", "needle", "doc_id", F.col("doi").alias("of"))
    own = bare.join(parts.select("doc_id", "ordinal", "section_path", normalized(F.col("text"), compose).alias("norm")), "doc_id").withColumn("at", F.expr("locate(needle, norm)")).where("at > 0")
    first = own.groupBy("quote_id", "needle", "doc_id", "of").agg(F.min_by(F.struct("norm", "at", "ordinal", "section_path"), "ordinal").alias("c"))
    of_parts = first.select("quote_id", "of", F.lit(1).alias("place"), snippet(F.col("c.norm"), F.col("c.at"), F.length("needle")).alias("snippet"), F.col("c.ordinal").alias("chunk_ordinal"), F.col("c.section_path").alias("section_path"))
    names = ["quote_id", "of", "place", "snippet", "chunk_ordinal", "section_path"]
    exact = of_text.select(*names).unionByName(of_parts.select(*names)).withColumn("similarity", F.lit(1.0))

    only = asked.where("doc_id is not null").select("quote_id", "doc_id").join(parts.select("doc_id", "chunk_id"), "doc_id").select("quote_id", "chunk_id")
    lost = n.where("not short").join(exact.select("quote_id").distinct(), "quote_id", "left_anti").join(asked.where("has_text is null and has_chunks is null").select("quote_id"), "quote_id", "left_anti")
    near = _rated(lost.select("quote_id", F.col("needle").alias("quote")), chunks.select("chunk_id", "citation_id", "ordinal", "section_path", "text"), compose, stemmed, index, only)
    near = near.join(who, near["citation_id"] == who["doc_id"]).select("quote_id", "of", "place", excerpt(F.col("norm")).alias("snippet"), F.col("ordinal").alias("chunk_ordinal"), "section_path", "similarity")
    found = exact.withColumn("verdict", F.lit("exact")).unionByName(near.withColumn("verdict", F.lit("close-match")))
    match = F.struct(F.col("of").alias("doi"), "similarity", "snippet", "section_path", F.col("chunk_ordinal").cast("int").alias("chunk_ordinal"))
    held = found.groupBy("quote_id").agg(F.first("verdict").alias("verdict"), F.transform(F.sort_array(F.collect_list(F.struct("place", match.alias("m")))), lambda x: x["m"]).alias("matches"))
    status = F.when(F.col("short"), "quote-too-short").when(F.col("unknown"), "unknown-doi").when(F.col("no_text"), "no-markdown").otherwise("ok")
    flags = asked.select("quote_id", F.col("doc_id").isNull().alias("unknown"), (F.col("has_text").isNull() & F.col("has_chunks").isNull()).alias("no_text"))
    out = n.join(flags, "quote_id", "left").join(held, "quote_id", "left").withColumn("status", status)
    empty = F.array().cast(f"array<{MATCH}>")
    return out.select("quote_id", "status", F.when(F.col("status") == "ok", F.coalesce("verdict", F.lit("not-found"))).alias("verdict"), F.coalesce(F.col("matches").cast(f"array<{MATCH}>"), empty).alias("matches"))
