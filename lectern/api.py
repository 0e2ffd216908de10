"""The library as one object over versioned tables: import, list, search, read, verify, index, download, score.

Work that a service or a file format would do is passed in as data (texts, outcomes of retrieval) or as a Python
callable, which runs as a pandas function over batches.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import doi, valid_doi
from .operators import chunker, files, identity, quality, relational, retrieval, search, store, verify
from .sources.bibliography import entries

CITATIONS = "id long, doi string, url string, title string, authors string, year int, journal string, bibtex_key string, pdf_path string, verification_status string, access_type string, last_verified string, created_at string, updated_at string"
MANIFESTATIONS = "id long, citation_id long, kind string, path string, content_hash string, extractor_name string, extractor_version string, created_at string, last_seen_at string"
TEXTS = "citation_id long, text string, content_hash string"
CHUNKS = "chunk_id long, citation_id long, ordinal int, section_path array<string>, text string, content_hash string, chunker_version int"
LOG = "id long, citation_id long, source string, url string, success boolean, error_message string, created_at string"
#: The kept index: postings and lengths of the metadata and of the passages.
POSTINGS = "term string, positions array<long>"
INDEX = {"meta_postings": f"id long, {POSTINGS}", "meta_lengths": "id long, n_terms long", "body_postings": f"citation_id long, chunk_id long, {POSTINGS}", "body_lengths": "citation_id long, chunk_id long, n_terms long"}
TABLES = {"citations": CITATIONS, "manifestations": MANIFESTATIONS, "texts": TEXTS, "chunks": CHUNKS, "retrieval_log": LOG} | INDEX
KEYS = {n: "id" if n in ("citations", "meta_postings", "meta_lengths") else "citation_id" for n in TABLES}
SORTED = {"meta_postings": ["term"], "body_postings": ["term"]}


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")


class Library:
    """A corpus in a folder that Spark reaches. Every change is one new version, of the buckets that it touches; two
    writers cannot commit the same version (the later one gets store.Conflict and may try again)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, store.Snapshots(spark, root)
        if not self.store.version():
            self.store.commit(keys=KEYS, sort=SORTED, **{n: spark.createDataFrame([], kind) for n, kind in TABLES.items()})

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # Citations

    def import_bibtex(self, texts: DataFrame) -> int:
        """Adds the entries of texts(text) that have a valid, new DOI; returns how many."""
        base = self.store.version()
        got = entries(texts.select("text").withColumn("_n", F.monotonically_increasing_id()), "_n")
        got = got.withColumns({"doi": doi(F.col("doi")), "seq": F.col("_n") * 100_000 + F.col("seq")}).where(valid_doi(F.col("doi")))
        new = store.insert_if_absent(self.table("citations"), got.drop("_n"), _now())
        n = new.count()
        if n:
            self._put(base, new)
        return n

    def _put(self, base: int, new: DataFrame, update: bool = False) -> None:
        """Adds or replaces citations, and their part of the index with them."""
        postings, lengths = search.build_index(new, "id", list(relational.SEARCHED))
        ids = new.select("id")
        fresh = {"citations": new, "meta_postings": postings.select("id", "term", "positions"), "meta_lengths": lengths}

        def rows(name: str, old: DataFrame) -> DataFrame:
            kept = old.join(ids, "id", "left_anti").select(*old.columns) if update else old
            return kept.unionByName(fresh[name].select(*old.columns))

        self.store.change({n: ids for n in fresh}, rows, base)

    def get_citation(self, doi_: str) -> DataFrame:
        return relational.with_pdf_path(relational.by_doi(self.table("citations"), doi_), self.table("manifestations"))

    def list_citations(self, cursor: str | None = None, limit: int | None = None) -> DataFrame:
        return relational.keyset_page(self.table("citations"), cursor, limit)

    def set_status(self, doi_: str, status: str) -> None:
        if status not in store.STATUSES:
            raise ValueError(f"unknown status {status}")
        self._update(doi_, verification_status=status, last_verified=_now())

    def set_access(self, doi_: str, access: str) -> None:
        if access not in store.ACCESS:
            raise ValueError(f"unknown access {access}")
        self._update(doi_, access_type=access)

    def _update(self, doi_: str, **values: str) -> None:
        base, now = self.store.version(), _now()
        change = self.spark.createDataFrame([(doi_, *values.values())], ", ".join(f"{c} string" for c in ("doi", *values)))
        ids = relational.by_doi(self.table("citations"), doi_).select("id")
        self.store.change({"citations": ids}, lambda _, old: store.updated(old, change, now), base)

    def reset(self, confirmed: bool = False, remove: Callable[[str], None] | None = None) -> DataFrame:
        """Row counts and, in row `files`, how many files are recorded. If confirmed, the files go first - remove(path) is
        called for each, and an error leaves the tables as they are - and then all rows, in one version."""
        counts = relational.row_counts(**{n: self.table(n) for n in ("citations", "manifestations", "chunks", "retrieval_log")})
        paths = relational.stored_paths(self.table("citations"), self.table("manifestations"))
        counts = self.spark.createDataFrame(counts.unionByName(paths.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("name"), "n")).collect(), counts.schema)
        if confirmed:
            if remove:
                for r in paths.toLocalIterator():
                    remove(r.path)
            self.store.commit(**{n: self.spark.createDataFrame([], kind) for n, kind in TABLES.items()})
        return counts

    # Retrieval

    def record_downloads(self, results: DataFrame) -> None:
        """Records results(seq, doi, source, pdf_path, access_type) - path null for a failure - as one version."""
        base, now = self.store.version(), _now()
        own = self.table("citations").join(results.select("doi"), "doi", "left_semi")
        known, paths, log = store.downloads_recorded(own, self.table("manifestations").join(own.select(F.col("id").alias("citation_id")), "citation_id", "left_semi"), self.table("retrieval_log"), results, now)
        top = self.table("manifestations").agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m")).first()[0]
        held = self.table("manifestations").select("id").withColumn("_old", F.lit(True))
        paths = paths.join(held, "id", "left").withColumn("id", F.when(F.col("_old"), F.col("id")).otherwise(F.col("id") + top)).drop("_old")
        new = {"citations": known, "manifestations": paths, "retrieval_log": log.join(self.table("retrieval_log").select("id"), "id", "left_anti")}
        ids = own.select("id")

        def rows(name: str, old: DataFrame) -> DataFrame:
            if name == "retrieval_log":
                return old.unionByName(new[name].select(*old.columns))
            key = KEYS[name]
            return old.join(ids.withColumnRenamed("id", key), key, "left_anti").select(*old.columns).unionByName(new[name].select(*old.columns))

        self.store.change({n: ids.withColumnRenamed("id", KEYS[n]) for n in new}, rows, base)

    def retrieval_log(self, doi_: str) -> DataFrame:
        return relational.log_of(self.table("citations"), self.table("retrieval_log"), doi_)

    def downloaded(self, listing: DataFrame) -> DataFrame:
        """(doi, path) of the citations whose PDF is in listing(path, name)."""
        return retrieval.cached(relational.with_pdf_path(self.table("citations"), self.table("manifestations")), listing)

    # Texts

    def texts_of(self, markdown: DataFrame) -> DataFrame:
        """(doi, text) of the citations whose Markdown is among markdown(path, text): by the newest recorded file, else by
        the names beside their PDF."""
        found = files.markdown_paths(relational.with_pdf_path(self.table("citations"), self.table("manifestations")), self.table("manifestations"), markdown.select("path"))
        return found.join(markdown, "path").join(self.table("citations").select(F.col("id").alias("citation_id"), "doi"), "citation_id").select("doi", "text")

    def index_summary(self, texts: DataFrame) -> DataFrame:
        """One row: what indexing texts(doi, text) would do - scanned, indexed, unchanged, missing_markdown, errors (rows of
        unknown DOIs or without text)."""
        c = self.table("citations").select("id", "doi")
        rows = c.join(texts.select("doi", F.sha2("text", 256).alias("content_hash")), "doi", "left")
        same = self._same().withColumn("_same", F.lit(True))
        rows = rows.join(same, (rows["id"] == same["citation_id"]) & (rows["content_hash"] == same["_hash"]), "left")
        lost = texts.join(c, "doi", "left_anti").agg(F.count(F.lit(1)).alias("errors"))
        out = rows.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("_same").isNull() & F.col("content_hash").isNotNull()).alias("indexed"), F.count("_same").alias("unchanged"), F.count_if(F.col("content_hash").isNull()).alias("missing_markdown"))
        return out.join(F.broadcast(lost))

    def _same(self) -> DataFrame:
        return self.table("chunks").where(F.col("chunker_version") == chunker.VERSION).select("citation_id", F.col("content_hash").alias("_hash")).distinct()

    def index(self, texts: DataFrame) -> int:
        """Keeps texts(doi, text), and cuts into passages and indexes those whose text or chunker changed; returns how many
        did. Only buckets with such documents are written."""
        base = self.store.version()
        own = self.table("citations").select("id", "doi").join(texts.where("text is not null"), "doi").select(F.col("id").alias("citation_id"), "text", F.sha2("text", 256).alias("content_hash"))
        fresh = own.join(self._same().withColumnRenamed("_hash", "content_hash"), ["citation_id", "content_hash"], "left_anti").select("citation_id", "text", "content_hash")
        n = fresh.count()
        if not n:
            return 0
        cut = chunker.chunked(fresh, "citation_id", "content_hash").select((F.col("citation_id") * 1_000_000 + F.col("ordinal")).alias("chunk_id"), "citation_id", "ordinal", "section_path", "text", "content_hash", F.lit(chunker.VERSION).alias("chunker_version"))
        postings, lengths = search.build_index(cut, "chunk_id", ["text"])
        of = F.floor(F.col("chunk_id") / 1_000_000).alias("citation_id")
        new = {"texts": fresh, "chunks": cut, "body_postings": postings.select(of, "chunk_id", "term", "positions"), "body_lengths": lengths.select(of, "chunk_id", "n_terms")}
        ids = fresh.select("citation_id")
        self.store.change({t: ids for t in new}, lambda name, old: old.join(ids, "citation_id", "left_anti").select(*old.columns).unionByName(new[name].select(*old.columns)), base)
        return n

    def reextract(self, documents: DataFrame, extract: Callable[[pd.Series], pd.Series]) -> DataFrame:
        """One row: processed, extracted, failed, indexed. extract turns the column `content` of documents(doi, content) into
        Markdown, batch by batch; a null is a failure."""
        made = documents.select("doi", F.pandas_udf(extract, "string")("content").alias("text"))
        counts = made.agg(F.count(F.lit(1)).alias("processed"), F.count("text").alias("extracted"), F.count_if(F.col("text").isNull()).alias("failed")).first()
        return self.spark.createDataFrame([(*counts, self.index(made.where("text is not null")))], "processed long, extracted long, failed long, indexed long")

    # Find, read, check

    def has_index(self) -> bool:
        return all(self.store.has(n) for n in INDEX)

    def _index(self) -> tuple[DataFrame, ...]:
        return tuple(self.table(n) for n in INDEX)

    def search_citations(self, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """Ranked citations from the kept index; substring matches, oldest first, if no word matches."""
        c = self.table("citations")
        if self.has_index():
            page = search.search(c, self.table("chunks"), query, limit, offset, index=self._index())
            if offset or not page.isEmpty():
                return relational.summary(c.join(page.select("id", "rank"), "id").orderBy("rank", "id"))
        return relational.summary(relational.like_search(c, query).orderBy("created_at", "id").limit(limit))

    def search_page(self, query: str, cursor: str | None = None, limit: int | None = None) -> dict:
        """A page of results and the cursor of the next. Ranked pages go by offset, substring pages by (created_at, id): a
        cursor says which it continues."""
        n = min(max(50 if limit is None else limit, 1), 200)
        c = self.table("citations")
        offset = relational.offset_of(cursor)
        if self.has_index() and (cursor is None or offset is not None):
            at = offset or 0
            ranked = search.ranked(c, self.table("chunks"), query, index=self._index())
            found = ranked.orderBy("rank", "id").offset(at).limit(n + 1).collect()
            if found or at:
                own = self.spark.createDataFrame([(r.id, k) for k, r in enumerate(found[:n])], "id long, place int")
                shown = search.matches(self.table("chunks"), self._index()[2:], query, own.select(F.col("id").alias("citation_id")))
                rows = own.join(c, "id").join(shown.withColumnRenamed("citation_id", "id"), "id", "left").withColumn("fields", relational.matched_fields(query))
                return {"results": [self._result(r) for r in rows.orderBy("place").collect()], "next_cursor": relational.encode_cursor(offset=at + n) if len(found) > n else None}
        page = relational.keyset_page(relational.like_search(c, query), cursor, n).withColumn("fields", relational.matched_fields(query)).withColumn("matches", F.lit(None)).orderBy("created_at", "id").collect()
        return {"results": [self._result(r) for r in page], "next_cursor": page[-1].next_cursor if page else None}

    def _result(self, r) -> dict:
        return {"doi": r.doi, "title": r.title, "year": r.year, "journal": r.journal, "verification_status": r.verification_status, "matched_fields": r.fields, "matches": [m.asDict() for m in r.matches] if r.matches else []}

    def read_content(self, doi_: str, cursor: str | None = None, max_chars: int = 20_000) -> dict | None:
        """A page of a document's text and the cursor of the next; None without a text."""
        at = relational.decode_cursor(cursor, "offset")["offset"] if cursor else 0
        own = self.table("texts").join(relational.by_doi(self.table("citations"), doi_).select(F.col("id").alias("citation_id"), "title"), "citation_id")
        row = own.select("title", relational.text_page(F.col("text"), at, max_chars).alias("p")).select("title", "p.*").first()
        return row and {"doi": doi_, "title": row.title, "text": row.text, "next_cursor": relational.encode_cursor(offset=row.next_offset) if row.next_offset else None}

    def verify_quotes(self, quotes: DataFrame) -> DataFrame:
        """(quote_id, status, verdict, matches) for quotes(quote_id, quote[, doi]) over all documents, or one by its DOI."""
        rows = quotes if "doi" in quotes.columns else quotes.withColumn("doi", F.lit(None).cast("string"))
        body = (self.table("body_postings"), self.table("body_lengths").select("chunk_id", "n_terms"))
        return verify.checked(rows, self.table("citations"), self.table("texts"), self.table("chunks"), index=body)

    def check_local_papers(self, bib: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entry_id, status) of the entries of bib(text) against papers(file_id, name, text), and one row of counts."""
        got = entries(bib.select("text").withColumn("_n", F.monotonically_increasing_id()), "_n")
        rows = got.withColumn("entry_id", F.concat_ws(":", "_n", "seq"))
        result = identity.local_check(rows, papers)
        return result, identity.local_summary(result)

    def score(self, layouts: DataFrame) -> DataFrame:
        """Quality of the kept texts against layouts(doi, layout)."""
        c = self.table("citations").select(F.col("id").alias("citation_id"), "doi")
        d = c.join(self.table("texts"), "citation_id", "left").join(layouts, "doi", "left")
        return quality.scored(d.select(F.col("citation_id").alias("doc_id"), F.col("text").alias("markdown"), "layout"))
