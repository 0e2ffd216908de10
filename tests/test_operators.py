"""Semantics that the tables do not reach."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.porter import stem, terms
from lectern.operators import chunker, relational, search, store, verify
from lectern.operators.retrieval import breaker
from lectern.sources import bibliography as B
from lectern.streaming.incremental import breaker_stream, follow_passages


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_normalized(spark):
    raw = "ﬁrst­  “exam-\n  ple” — it’s ok "
    assert col(spark, raw, T.normalized) == "first \"example\" - it's ok"


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("classifiers", "classifi"), ("classification", "classif"), ("agreed", "agre"), ("happy", "happi"), ("electricity", "electr"), ("controlling", "control"), ("sky", "sky"), ("is", "is")])
def test_stems(word, want):
    assert stem(word) == want


def test_terms():
    assert terms("Généralisation don't x² straß a_b") == ["generalis", "don", "t", "x²", "straß", "a", "b"]


@pytest.mark.parametrize("query", ["quick fox", '"lazy dog"', "running", "fox-hunt", "the", "nothing here", "dogs OR"])
def test_rank_matches_fts5(spark, query):
    texts = ["The quick brown fox", "a lazy dog sleeps, lazy dogs run", "quick quick fox runs over the lazy dog", "", "fox hunt: the fox hunts", "running water and a hunt", "other words only here"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, text) values (?, ?)", enumerate(texts, 1))
    q = query.strip()
    match = q if q[0] == q[-1] == '"' else " ".join('"' + w.replace('"', "") + '"' for w in q.split())
    want = {r: s for r, s in con.execute("select rowid, rank from t where t match ?", (match,))}
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    p, n = search.build_index(docs, "id", ["text"])
    got = {r.id: r["rank"] for r in search.bm25(p, n, "id", search.parse_query(query)).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_empty_query_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    p, n = search.build_index(docs, "id", ["text"])
    assert search.bm25(p, n, "id", search.parse_query(' "" - ')).count() == 0


def test_snippet(spark):
    text = " ".join(f"w{k}" for k in range(30)) + " needle " + " ".join(f"v{k}" for k in range(30))
    got = col(spark, text, lambda c: search.snippets(c, [["needl"]]))
    assert "<b>needle</b>" in got and got.startswith("…") and got.endswith("…") and len(got.split()) <= 12


def test_chunks():
    text = "intro\n### A\nx\n# B\n## C\r\n" + "p" * 30 + "\n\n" + "q" * 45 + "\n\nrr\n\n" + "s" * 10
    got = chunker.chunks_of(text, 20)
    assert [c["ordinal"] for c in got] == list(range(len(got)))
    assert got[0] == {"ordinal": 0, "section_path": [], "text": "intro"}
    assert got[1] == {"ordinal": 1, "section_path": ["A"], "text": "### A\nx"}
    assert all(c["section_path"] == ["B"] for c in got[2:])
    assert all(len(c["text"]) <= 20 for c in got)
    assert [c["text"] for c in got[-2:]] == ["qqqqq\n\nrr", "s" * 10]
    assert chunker.chunks_of(None) == [] and chunker.chunks_of("  \n ") == []


def test_verdict_kinds(spark):
    docs = spark.createDataFrame([(1, 1, "The cat sat on the mat, and then it slept all day."), (2, 2, "Another text entirely.")], "doc_id long, created_at int, text string")
    quotes = spark.createDataFrame([(1, "cat SAT on the"), (2, "the cat sat on the mat and then it slept the whole day"), (3, "short"), (4, "never written anywhere at all"), (5, "t on the mat, and th"), (6, "entirely. another")], "quote_id long, quote string")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    got = {r.quote_id: r.verdict for r in verify.verdicts(quotes, docs, chunks).collect()}
    assert got == {1: "exact", 2: "close-match", 3: "quote-too-short", 4: "not-found", 5: "exact", 6: "not-found"}


def test_short_needles_without_inner_word(spark):
    docs = spark.createDataFrame([(1, 1, "some extraordinary wording"), (2, 2, "unextraordinary wordings")], "doc_id long, created_at int, text string")
    quotes = spark.createDataFrame([(1, "extraordinary word"), (2, "aordinary wor"), (3, "extraordinary")], "quote_id long, quote string")
    got = sorted((r.quote_id, r.doc_id) for r in verify.exact_matches(quotes, docs).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_cursor_round_trip_and_errors():
    c = relational.encode_cursor(createdAt="x", id=3)
    assert relational.decode_cursor(c, "createdAt", "id") == {"createdAt": "x", "id": 3}
    for bad in ("???", relational.encode_cursor(offset=1)):
        with pytest.raises(ValueError, match="invalid cursor"):
            relational.decode_cursor(bad, "createdAt", "id")


def test_bibtex():
    text = '@comment{x}\n@article{k1, title = {A {Nested} "T"}, author="X and Y", year = 2020a, journal = {}, booktitle = "B" # {C}, doi={10.1/x}}\n@misc(k2, publisher = P, year = nope)'
    got = B.parse_bibtex(text)
    assert [(e["bibtex_key"], e["title"], e["journal"], e["year"]) for e in got] == [("k1", 'A {Nested} "T"', "BC", 2020), ("k2", None, "P", None)]
    assert B.parse_bibtex("@article{broken, title = {x") == [] and B.parse_bibtex(None) == []


def test_breaker_batch_and_stream_agree(spark, tmp_path):
    events = [("s", k, k * 12_000, o) for k, o in enumerate(["429", "429", "429", "ok", "429", "429", "429", "404", "429"])]
    df = spark.createDataFrame(events, "source string, seq long, ts_ms long, outcome string")
    want = sorted(map(tuple, breaker(df).collect()))
    assert [w[2:] for w in want[:6]] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (False, "open"), (True, "open")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = breaker_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("breaker").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("breaker").collect())) == want


def test_snapshots_follow_a_stream(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "manifestation_id long, ordinal int, text string")
    for k, part in enumerate((rows, rows.where("manifestation_id = 1 and ordinal = 0").withColumn("text", F.lit("new")))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        follow_passages(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), s, str(tmp_path / "c")).awaitTermination()
        assert s.version() == k + 1
    assert sorted(map(tuple, s.read("chunks").collect())) == [(1, 0, "new"), (2, 0, "c")]
    assert s.read("chunks", 1).count() == 3


def test_bootstrap_holds_the_accuracy(spark):
    from lectern.operators import extras

    rows = spark.createDataFrame([(k, "a", k % 4 > 0) for k in range(400)], "claim_id long, system string, right boolean")
    a, b = (extras.bootstrap(rows.repartition(n)).first() for n in (1, 4))
    assert a == b and a.low < 0.75 < a.high and 0.03 < a.high - a.low < 0.15


def test_texts_are_written_and_read(spark, tmp_path):
    from lectern.operators import files

    root = f"file://{tmp_path}/md"
    files.write_texts(spark.createDataFrame([("a", "# A\n\ntext"), ("b", "x"), ("c", None)], "name string, text string"), root)
    files.write_texts(spark.createDataFrame([("b", "new\nlines\n")], "name string, text string"), root)
    assert {tuple(r) for r in files.read_texts(spark, root).collect()} == {("a", "# A\n\ntext"), ("b", "new\nlines\n"), ("c", "")}


def test_migrations_run_once(spark, tmp_path):
    s, ran = store.Snapshots(spark, f"file://{tmp_path}/m"), []
    steps = {1: lambda _: ran.append(1), 2: lambda x: ran.append(2)}
    assert s.migrated({1: steps[1]}) == 1 and s.migrated(steps) == 2 and s.migrated(steps) == 2
    assert ran == [1, 2]


def test_healed_manifestations(spark):
    from lectern.operators import files

    old = spark.createDataFrame([(1, 5, "pdf", "/p/pdf/k.pdf", None, "t0")], "id long, citation_id long, kind string, path string, content_hash string, last_seen_at string")
    cited = spark.createDataFrame([(5, "10.1/x", "k", "/p/pdf/k.pdf")], "id long, doi string, bibtex_key string, pdf_path string")
    texts = spark.createDataFrame([("/p/markdown/k.md", "# T")], "path string, text string")
    found = files.markdown_paths(cited, old, texts)
    assert [tuple(r) for r in found.collect()] == [(5, "/p/markdown/k.md", True)]
    new = files.healed(old, found, texts, "t1")
    assert {(r.id, r.kind, r.path) for r in new.collect()} == {(1, "pdf", "/p/pdf/k.pdf"), (2, "markdown-extracted", "/p/markdown/k.md")}
    assert [r.healed for r in files.markdown_paths(cited, new, texts).collect()] == [False]


def test_tickets_in_parts(spark, monkeypatch):
    """A source's requests, cut into parts, against a limiter that serves them one by one; and far over an int's range."""
    import random

    from lectern.operators import retrieval

    monkeypatch.setattr(retrieval, "PART", 40)
    draw = random.Random(3)
    rows = [(draw.choice("aab") if k % 50 else None, k if k else None, k * 900 + draw.randrange(40) * 1000) for k in range(500)]
    got = {r.seq: r.start_ms for r in retrieval.tickets(spark.createDataFrame(rows, "source string, seq long, ts_ms long"), 3000).collect()}
    free, want = {}, {}
    for source, seq, ts in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        want[seq] = max(ts, free.get(source, ts))
        free[source] = want[seq] + 3000
    assert got == want
    many = spark.range(3).selectExpr("'s' as source", "id as seq", "0L as ts_ms")
    assert [r.start_ms for r in retrieval.tickets(many, 2_000_000_000).orderBy("seq").collect()] == [0, 2_000_000_000, 4_000_000_000]
    assert retrieval.tickets(many.limit(0), 3000).count() == 0


def test_titles_of_groups_as_over_pairs(spark):
    """Best and all similar titles of groups, against all pairs; repeated titles, keys, nulls and empty titles."""
    import random

    from lectern.operators import identity

    draw = random.Random(5)
    words = ["red ring", "red rings", "{Red} ring", "blue bolt", "blue bolts", "bolt blue", "", "ü", None]
    rows = [(draw.randrange(60) if k % 25 else None, draw.choice(words), draw.choice(["a", "b", None]), draw.randrange(2)) for k in range(160)]
    t = spark.createDataFrame(rows, "key long, title string, brand string, size int")
    by = ["brand", "size"]
    pairs = t.withColumnRenamed("title", "expected").join(t.select(*by, F.col("key").alias("pos"), F.col("title").alias("actual")), by)
    bag = lambda df: sorted(map(tuple, df.select("key", "pos", F.round("similarity", 9)).collect()), key=repr)
    want = pairs.withColumn("similarity", T.title_similarity(F.col("expected"), F.col("actual")))
    assert bag(identity.similar_titles(t, t.withColumnRenamed("key", "pos"), by)) == bag(want)
    for least in (0.5, 0.9):
        assert bag(identity.best_in_group(t, by, least)) == bag(identity.best_title(pairs.where("key <> pos"), "key", least))


def test_titles_are_compared_once(spark):
    """4,000 rows of one group with three titles: some pairs of titles, not 16 million of rows."""
    from lectern.operators import identity

    t = spark.range(4000).selectExpr("id as key", "concat('a title ', id % 3) as title", "0 as g")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return x

    got = identity.best_in_group(t.withColumn("title", seen("title")), ["g"], 0.5)
    assert got.where("similarity = 1").count() == 4000 and calls.value <= 40_000


def test_python_columns_hold_a_slice():
    """A batch of 6.4 MB with 1.3 million words: Python holds those of a slice at a time, and makes the same of them."""
    import tracemalloc

    import pyarrow as pa

    from lectern.functions import batches, porter

    words = " ".join(f"w{k}" for k in range(1000, 1320))
    texts = pa.array([words, None, "", *[words] * 4000])
    tracemalloc.start()
    made = porter.plain_terms.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == len(texts) and made[0].as_py() == made[-1].as_py() == words.split() and made[1].as_py() == made[2].as_py() == []
    assert peak < 40e6
    assert [n for _, n in batches.cuts((pa.array(["x" * 3_000_000, "y", None]),))] == [1, 2] and batches.cuts((texts.slice(0, 0),)) == []
    found = porter.found_terms(["w1001", "w1003"], False).func(texts)
    assert found[0].as_py() == {"n": 320, "found": [{"pos": 1, "term": "w1001"}, {"pos": 3, "term": "w1003"}]} and found[1].as_py() == {"n": 0, "found": []}


def test_words_and_typography_character_by_character():
    """Every character, and texts of odd ones, as the plain definitions have them."""
    import random
    import re
    import unicodedata

    from lectern.functions import porter

    def unmarked(text):
        out = []
        for c in text.lower():
            d = unicodedata.normalize("NFD", c)
            out.append(d[0] if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) else c)
        return "".join(c for c in out if not unicodedata.combining(c))

    def typography(text):
        space = "[\t-\r \x85\xa0  -     　]"
        for old, new in (("­", ""), (f"-[ \t]*\n{space}*", ""), ("[‘’‚′]", "'"), ("[“”„″]", '"'), ("[–—−]", "-"), (f"{space}+", " ")):
            text = re.sub(old, new, text)
        return text.strip(" ")

    draw = random.Random(2)
    odd = "ab_1 \t\n\x1c\x85\xa0​　-–−­’″éßΣ中²½́\U0001f600"
    texts = ["".join(draw.choice(odd) for _ in range(draw.randrange(40))) for _ in range(3000)] + ["".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))]
    for text in texts:
        assert porter.plain(text) == unmarked(text) and porter.words_of(text) == porter.WORD.findall(text)
        assert T.plain_typography(text, False) == typography(text) and T.plain_typography(text) == typography(unicodedata.normalize("NFKC", text))
    long = "café " + "the word à la carte, " * 20_000
    assert porter.NON_ASCII.subn("", long)[1] < len(long) / 10  # only these are looked up one by one


def test_titles_and_bodies_as_gap_replacements(spark):
    """Titles, and the quality queries' bodies and words, are what replacing every gap gave."""
    import random

    from lectern.plans.quality import _BODY, _FIRST_WORDS

    draw = random.Random(1)
    rows = [("".join(draw.choice("ab1 \n\n.{}\\-éABCÉ\tß") for _ in range(draw.randrange(80))),) for _ in range(3000)] + [(None,), ("",)]
    d = spark.createDataFrame(rows, "text string")
    title = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[{}\\]", "")), "[^a-z0-9]+", " "))
    body = F.expr("lower(trim(regexp_replace(regexp_replace(text, '[^A-Za-z\\\\n]+', ' '), ' *\\\\n[ \\\\n]*', chr(10))))")
    words = F.expr("slice(regexp_extract_all(text, '[A-Za-z]{3,9}', 0), 1, 8)")
    first = F.expr(f"regexp_extract_all(regexp_extract(text, '{_FIRST_WORDS}', 0), '[A-Za-z]{{3,9}}', 0)")
    for want, got in ((title, T.title(F.col("text"))), (body, F.expr(_BODY["spark"])), (words, first)):
        assert d.where(~want.eqNullSafe(got)).count() == 0
