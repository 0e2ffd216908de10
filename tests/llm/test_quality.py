"""The weak-label classifier: EM on known labellers, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pandas as pd

from lectern.llm import quality

SF = "/root/testdata/sf0.01"


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(60_000) < 0.2
    right = [0.95, 0.9, 0.8, 0.7]
    cast = [np.where(rng.random(truth.size) < 0.3, "-", np.where((rng.random(truth.size) < r) == truth, "y", "n")) for r in right]
    patterns, counts = np.unique(["".join(x) for x in zip(*cast)], return_counts=True)
    model = quality.LabelModel.fitted(list(patterns), counts.astype(float), 500)
    assert abs(model.prior - 0.2) < 0.02
    for g, r in zip(model.given, right):
        assert abs(g[1, 1] / (g[1, 0] + g[1, 1]) - r) < 0.05 and abs(g[0, 0] / (g[0, 0] + g[0, 1]) - r) < 0.05


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = pd.read_parquet(f"{SF}/labels.parquet")
    held = known.doc_id.map(lambda i: zlib.crc32(f"{i} held".encode()) % 3 == 0)
    fitted = spark.createDataFrame(known[~held])
    got = quality.judged(docs, fitted).toPandas().merge(known[held], on="doc_id")
    bad, clean = got[(got.quality == 0) | (got.toxic == 1)], got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.rejected.mean() < 0.03
    assert bad[bad.quality == 0].rejected.mean() > 0.8
    assert quality.judged(docs).count() == docs.count()


def test_odd_rows(spark):
    rows = [(None, "the 3 quick brown fox number 8 jumps over lazy dogs"), (1, None), (2, ""), (3, "word $$$ &&& " * 40), (3, "word $$$ &&& " * 40), (4, "x " * 90_000), (5, "You stupid idiot, you pathetic moron. " * 3)]
    rows += [(k, f"the {k} quick brown fox number {k * 7} jumps over lazy dogs {k % 5} near river {k % 11}") for k in range(10, 60)]
    docs = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, votes string")
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = {(r.doc_id, r.rejected) for r in quality.judged(docs, labels).collect()}
    assert {(None, False), (1, False), (2, False), (3, True), (4, True), (5, True), (10, False)} <= got
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (3, 4, 5)").count() == 0 and kept.where("text is null").count() == 1
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.judged(docs, labels.limit(0)).count() == len(rows)


def test_sample_is_of_all_lengths(spark, monkeypatch):
    """A sample that is a small share of the table has the lengths of the table."""
    rows = [(k, " ".join(f"w{k * 31 + i}" for i in range(1 + k % 100))) for k in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, fitted = [], quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda features, *rest: (sizes.append([f.size for f in features]), fitted(features, *rest))[1])
    quality.fit(docs, sample=300)
    n_bins = len(quality.statistics(b"")[0])
    words = np.array(sizes[0]) - n_bins
    assert words.size == 300
    assert abs(words.mean() - 50.5) < 7 and abs((words < 34).mean() - 0.33) < 0.1 and abs((words > 67).mean() - 0.33) < 0.1


def test_em_matches_plain_version():
    """Expectation-maximisation written out vote by vote."""
    rng = np.random.default_rng(11)
    patterns = ["".join(x) for x in rng.choice(list("yn-"), (12, 3))]
    patterns, counts = list(dict.fromkeys(patterns)), rng.integers(1, 400, 12)[: len(set(patterns))].astype(float)
    start = {1: {"n": 0.03, "y": 0.72, "-": 0.25}, 0: {"n": 0.72, "y": 0.03, "-": 0.25}}
    given = [{t: dict(start[t]) for t in (0, 1)} for _ in range(3)]
    prior, trust = 0.1, 1 + 0.02 * counts.sum()

    def posterior(p):
        yes, no = prior, 1 - prior
        for k, c in enumerate(p):
            if c != "-":
                yes, no = yes * given[k][1][c], no * given[k][0][c]
        return yes / (yes + no)

    for _ in range(30):
        q = [posterior(p) for p in patterns]
        prior = min(0.5, max(0.01, sum(a * n for a, n in zip(q, counts)) / counts.sum()))
        for k in range(3):
            for t in (0, 1):
                got = {c: trust * start[t][c] + sum(n * (a if t else 1 - a) for p, a, n in zip(patterns, q, counts) if p[k] == c) for c in "ny-"}
                given[k][t] = {c: v / sum(got.values()) for c, v in got.items()}
    model = quality.LabelModel.fitted(patterns, counts, 30)
    assert abs(model.prior - prior) < 1e-9
    assert np.allclose(model.posterior(patterns), [posterior(p) for p in patterns])


def test_scorer_matches_plain_descent():
    rng = np.random.default_rng(2)
    n_bins, size = 3, (1 << quality.BITS) + 1
    features = [np.concatenate([rng.choice(50, rng.integers(0, 9), replace=False), rng.integers(100, 110, n_bins)]) for _ in range(25)]
    labels = rng.random(25)
    rows = []
    for f in features:
        x = np.zeros(size)
        for at in f[:-n_bins]:
            x[at] += 1 / np.sqrt(f.size - n_bins + 1)
        for at in f[-n_bins:]:
            x[at] += 1
        x[-1] += 1
        rows.append(x)
    x, w, speed = np.array(rows), np.zeros(size), np.zeros(size)
    for _ in range(40):
        slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - labels) / 25 + 1e-5 * w
        speed = 0.9 * speed - 8.0 / (n_bins + 2) * slope
        w = w + speed
    assert np.allclose(quality.fit_scorer(features, labels, n_bins, 40), w)


def test_query_matches_plain_scores(spark):
    """The registered query's scores, document by document, from the fitted models."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    made = quality.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for doc_id, text in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        raw = (text or "").encode()
        stats, words = quality.statistics(raw, made.mined)
        place = lambda b: zlib.crc32(b) % (1 << quality.BITS)
        score = {}
        for task, weights in made.weights.items():
            weights = weights.astype(np.float32)
            kinds = set(words)
            total = float(weights[-1]) + sum(float(weights[place(w)]) for w in kinds) / np.sqrt(len(kinds) + 1)
            score[task] = 1 / (1 + np.exp(-(total + sum(float(weights[place(f" {k} {v}".encode())]) for k, v in stats.items()))))
        r = got[doc_id]
        assert r.votes == quality.votes(stats)
        assert abs(r.junk_score - score["junk"]) < 1e-4 and abs(r.abuse_score - score["abuse"]) < 1e-4
        assert r.rejected == (r.junk_score > 0.5 or r.abuse_score > 0.5)


def test_stems_keep_whole_characters():
    assert quality.stem("ééééé".encode()) == "ééé".encode() and quality.stem(b"stupidity") == b"stupid"
    assert quality.stem("abcdeéx".encode()) == b"abcde"
