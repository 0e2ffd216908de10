"""FM-index against plain search."""

import numpy as np
import pytest

from lectern.llm import fmindex


@pytest.mark.parametrize("seed", range(6))
def test_counts_and_places(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, (2, 4, 40, 3000, 5, 9)[seed], 700)
    s[300:400] = s[100:200]
    index = fmindex.FMIndex(s)
    phrases = [s[k : k + n] for k, n in zip(rng.integers(0, 690, 60), rng.integers(1, 11, 60))] + [np.array([9999]), np.array([1, 1, 1])]
    table = np.zeros((len(phrases), 10), np.int64)
    for row, p in zip(table, phrases):
        row[10 - len(p) :] = p
    lo, hi = index.intervals(table, np.array([len(p) for p in phrases]))
    for p, x, y in zip(phrases, lo, hi):
        want = [k for k in range(len(s) - len(p) + 1) if (s[k : k + len(p)] == p).all()]
        assert sorted(index.located(np.arange(x, y))) == want


def plain(text, items):
    w = fmindex.words((text or "").encode())
    hit, names = set(), set()
    for name, t in items:
        b = fmindex.words((t or "").encode())
        for k in range(max(1, len(b) - 9) if b else 0):
            g = b[k : k + 10]
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit |= set(range(at, at + len(g)))
                    names.add("null" if name is None else str(name))
    return len(w), sorted(hit), sorted(names)


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_rows_match_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(list("abc") + ["é1", "Zz"], n))
    items = [(1, text(14)), (2, text(12)), (10, "a b"), (None, text(11)), (5, None), (6, "--"), (7, text(10)), (7, text(10))]
    rows = [(k, text(rng.integers(0, 80))) for k in range(30)] + [(None, "A, b! " * 40), (3, None), (3, ""), (4, items[0][1].upper()), (4, items[0][1].upper())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, items string")
    got = fmindex.spans(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"], "z_", 50).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = plain(r.text, items)
        assert (r.z_n_words, r.z_items) == (n, names)
        assert sorted(x for s in r.z_spans for x in range(s.start, s.stop)) == hit
    clean = fmindex.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert clean.count() == sum(not plain(t, items)[1] for _, t in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.spans(docs, none).collect()[0][2:] == (3, [], [])
    assert fmindex.spans(docs.limit(0), none).count() == 0
