"""Full-text search: an inverted index as tables, phrases, BM25, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import sliced
from ..functions.porter import WORD, found_terms, plain, plain_terms, stem, stemmed_terms, terms

K1, B = 1.2, 0.75
#: Parts that each term's postings are dealt to.
SALTS = 8
#: Positions of a text's columns lie this far apart, so that no phrase spans two.
COLUMN_GAP = 1 << 40


def parse_query(query: str, stemmed: bool = True) -> list[list[str]]:
    """The phrases that a row must have, as term lists. A query that is quoted as a whole is one phrase; otherwise
    every word parted by white space is one. Phrases without a term are dropped."""
    q = query.strip()
    whole = len(q) > 1 and q[0] == q[-1] == '"' and '"' not in q[1:-1]
    parts = [q[1:-1]] if whole else [w.replace('"', "") for w in q.split()]
    return [t for t in (terms(p, stemmed) for p in parts) if t]


def build_index(docs: DataFrame, key: str, columns: list[str], stemmed: bool = True, only: list[list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """postings(term, key, positions) and lengths(key, n_terms) of docs' columns; rows without terms have length 0.

    only: phrases whose terms alone are wanted, for a search without a kept index; other terms are then never dealt out.
    """
    if only is not None:
        cut = found_terms(sorted({t for p in only for t in p}), stemmed)
        count, numbered = F.col("terms.n"), F.col("terms.found")
    else:
        cut = stemmed_terms if stemmed else plain_terms
        count, numbered = F.size("terms"), F.transform("terms", lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    texts = docs.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.col(c).alias("text")) for k, c in enumerate(columns)])).alias("t"))
    tokens = texts.select(key, F.col("t.col").alias("col"), cut(F.coalesce(F.col("t.text"), F.lit(""))).alias("terms"))
    lengths = tokens.groupBy(key).agg(F.sum(count).cast("long").alias("n_terms"))
    each = tokens.select(key, "col", F.explode(numbered).alias("x")).select(key, "col", "x.pos", "x.term")
    place = F.col("pos") + F.col("col").cast("long") * COLUMN_GAP
    postings = each.groupBy("term", key).agg(F.sort_array(F.collect_list(place)).alias("positions"))
    return postings, lengths


def _frequency(positions: Column, phrase: list[str]) -> Column:
    """How often a phrase's terms stand side by side, from a map of term to positions."""
    at = F.element_at(positions, F.lit(phrase[0]))
    rest = [F.element_at(positions, F.lit(t)) for t in phrase[1:]]

    def here(p: Column) -> Column:
        ok = F.lit(True)
        for k, r in enumerate(rest, 1):
            ok = ok & F.array_contains(r, p + k)
        return ok

    return F.size(F.filter(at, here)) if rest else F.size(at)


def bm25(postings: DataFrame, lengths: DataFrame, key: str, phrases: list[list[str]], every: bool = True) -> DataFrame:
    """(key, rank) of rows with every phrase (else any); lower ranks are better.

    Only the query's postings are read, so the term filter reaches the scan; a row's postings for one query are as
    few as its terms.
    """
    if not phrases:
        return lengths.where(F.lit(False)).select(key, F.lit(0.0).alias("rank"))
    wanted = sorted({t for p in phrases for t in p})
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("avg"))
    found = postings.where(F.col("term").isin(wanted)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p"))
    f = [F.coalesce(F.when(F.forall(F.array(*map(F.lit, p)), lambda t: F.map_contains_key("p", t)), _frequency(F.col("p"), p)), F.lit(0)).alias(f"f{k}") for k, p in enumerate(phrases)]
    rows = found.select(key, *f)
    counts = rows.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(phrases))])
    hit = [F.col(f"f{k}") > 0 for k in range(len(phrases))]
    keep = hit[0]
    for h in hit[1:]:
        keep = keep & h if every else keep | h
    rows = rows.where(keep).join(lengths, key).join(F.broadcast(counts)).join(F.broadcast(stats))  # one row each
    rank = F.lit(0.0)
    for k in range(len(phrases)):
        rank = rank - _gain(F.col(f"f{k}"), F.col(f"n{k}"), F.col("n"), F.col("n_terms"), F.col("avg"))
    return rows.select(key, rank.alias("rank"))


def _gain(f: Column, holders: Column, n: Column, length: Column, avg: Column) -> Column:
    idf = F.log((n - holders + 0.5) / (holders + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / avg))


def candidates(queries: DataFrame, postings: DataFrame, lengths: DataFrame, key: str, n: int = 10, within: DataFrame | None = None) -> DataFrame:
    """For each of queries(query_id, terms array<string>), the n rows of best rank with any of its terms.

    One equi-join on terms serves all queries; ranks are summed before they are compared. A term's postings are dealt
    to SALTS parts, so that a common term does not meet its queries in one task. within(query_id, key) names the rows
    that some queries are about; the others are about all.
    """
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("avg"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    own = postings.join(asked.select("term").distinct(), "term", "left_semi")
    holders = own.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    spread = asked.join(holders, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = own.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    pairs = dealt.join(spread, ["term", "salt"])
    if within is not None:
        only = within.select("query_id", key, F.lit(True).alias("_in"))
        about = within.select("query_id").distinct().withColumn("_some", F.lit(True))
        pairs = pairs.join(about, "query_id", "left").join(only, ["query_id", key], "left").where("_some is null or _in")
    gain = _gain(F.size("positions"), F.col("holders"), F.col("n"), F.col("n_terms"), F.col("avg"))
    ranked = pairs.join(lengths, key).join(F.broadcast(stats)).groupBy("query_id", key).agg(F.sum(-gain).alias("rank"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank", key))
    return ranked.withColumn("nth", nth).where(F.col("nth") <= n)


def snippets(text: Column, phrases: list[list[str]], size: int = 12, stemmed: bool = True) -> Column:
    """The window of at most `size` words with most phrases, query words in <b>, cut ends marked by an ellipsis."""
    wanted = {t for p in phrases for t in p}

    def one(s: str | None) -> str:
        s = s or ""
        spans = [m.span() for m in re.finditer("[\\w\\u0300-\\u036f]+", s) if WORD.search(m[0])]
        hit = [bool(wanted & set(terms(s[a:b], stemmed))) for a, b in spans]
        if not spans:
            return ""
        start = max(range(max(1, len(spans) - size + 1)), key=lambda k: (sum(hit[k : k + size]), -k))
        if not any(hit[start : start + size]):
            start = 0
        stop = min(len(spans), start + size)
        head = 0 if start == 0 else spans[start][0]
        tail = len(s) if stop == len(spans) else spans[stop - 1][1]
        out, at = [], head
        for k in range(start, stop):
            a, b = spans[k]
            out += [s[at:a], f"<b>{s[a:b]}</b>" if hit[k] else s[a:b]]
            at = b
        return ("" if start == 0 else "…") + "".join(out) + s[at:tail] + ("" if stop == len(spans) else "…")

    return sliced(T.StringType())(one)(text)


def ranked(citations: DataFrame, chunks: DataFrame, query: str, stemmed: bool = True, index=None) -> DataFrame:
    """(id, rank) of citations by the better of their metadata's and their best passage's rank.

    index: (metadata postings, lengths, passage postings, lengths) as they are kept; built here if None.
    """
    from .relational import SEARCHED, hits_of

    phrases = parse_query(query, stemmed)
    meta_p, meta_l, body_p, body_l = index or (*build_index(citations, "id", list(SEARCHED), stemmed, phrases), *build_index(chunks, "chunk_id", ["text"], stemmed, phrases))
    meta = bm25(meta_p, meta_l, "id", phrases).select(F.col("id").alias("citation_id"), "rank")
    body = bm25(body_p, body_l.select("chunk_id", "n_terms"), "chunk_id", phrases).join(chunks.select("chunk_id", "citation_id"), "chunk_id").select("citation_id", "rank")
    return hits_of(meta, body).withColumnRenamed("citation_id", "id")


def search(citations: DataFrame, chunks: DataFrame, query: str, limit: int = 50, offset: int = 0, stemmed: bool = True, index=None) -> DataFrame:
    """One page of ranked citations."""
    from .relational import offset_page

    return offset_page(ranked(citations, chunks, query, stemmed, index), limit, offset)


def matches(chunks: DataFrame, index: tuple[DataFrame, DataFrame], query: str, citations: DataFrame, n: int = 3, stemmed: bool = True) -> DataFrame:
    """(citation_id, matches array<struct<chunk_ordinal, section_path, snippet>>): the n best passages of some citations(citation_id)."""
    from .relational import best_passages

    phrases = parse_query(query, stemmed)
    own = chunks.join(citations, "citation_id", "left_semi")
    hits = bm25(index[0], index[1].select("chunk_id", "n_terms"), "chunk_id", phrases).join(own.select("chunk_id", "citation_id"), "chunk_id")
    best = best_passages(hits, n).join(own.select("chunk_id", "ordinal", "section_path", "text"), "chunk_id")
    one = F.struct("nth", F.struct(F.col("ordinal").alias("chunk_ordinal"), "section_path", snippets(F.col("text"), phrases, stemmed=stemmed).alias("snippet")).alias("m"))
    return best.groupBy("citation_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["m"]).alias("matches"))


__all__ = ["bm25", "build_index", "candidates", "matches", "parse_query", "plain", "ranked", "search", "snippets", "stem"]
