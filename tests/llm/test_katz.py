"""Katz backoff against a plain model, and its probabilities' sums."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from lectern.llm import katz
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
END = b"\n"


class Plain:
    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = [*t, END]
            self.c1.update(w)
            self.c2.update(zip([END, *w], w))
        n = lambda c: np.array([0, *(sum(v == r for v in c.values()) for r in range(1, katz.K + 2))], float)
        self.d1, self.d2 = katz.discounts(n(self.c1)), katz.discounts(n(self.c2))
        self.total = sum(self.c1.values())
        self.left = 1 - sum(self.d(self.d1, c) for c in self.c1.values()) / self.total
        self.after = defaultdict(dict)
        for (h, w), c in self.c2.items():
            self.after[h][w] = c

    def d(self, d, c):
        return (d[c] if c <= katz.K else 1.0) * c

    def one(self, w):
        return self.d(self.d1, self.c1[w]) / self.total if self.c1[w] else self.left

    def p(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.one(w)
        own = {x: self.d(self.d2, c) / self.c1[h] for x, c in seen.items()}
        s = self.c1[h] / (self.c1[h] + 1) if 1 - sum(own.values()) < 1e-9 else 1.0
        if w in own:
            return s * own[w]
        return (1 - s * sum(own.values())) / (1 - sum(map(self.one, seen))) * self.one(w)


def words(t):
    return (t or "").encode().lower().split()


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def check(got, rows):
    model = Plain([words(t) for i, t in rows if not held(i)])
    want = []
    for i, t in rows:
        w = [*words(t), END]
        score = sum(math.log10(model.p(h, x)) for h, x in zip([END, *w], w))
        base = sum(math.log10((model.c1[x] + 0.5) / (model.total + 0.5 * (len(model.c1) + 1))) for x in w)
        want.append((-1 if i is None else i, held(i), len(w), sum(model.c1[x] > 0 for x in w), model.total, round(base, 6), round(score, 6)))
    have = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)
    return model


def test_query_matches_plain_model(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op6_katz_scores"](spark, SF).collect()
    model = check(got, list(zip(docs.doc_id, docs.text)))
    known = list(model.c1)
    for h in [END, *known[:30]]:
        assert sum(model.p(h, w) for w in known) + model.p(h, b"never seen") == pytest.approx(1, abs=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("hot", [250_000, 3])
def test_odd_rows_and_split_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT_TOKENS", hot)
    monkeypatch.setattr(katz, "RANGE_ENTRIES", 10)
    rows = [(k, f"a b a c {'abcd'[k % 4]} d a b unseen{k}") for k in range(40)] + [(None, "a b"), (3, None), (3, ""), (4, "A  B\n c"), (4, "A  B\n c"), (50, "z " * 3000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")
    check(katz.scores(docs).collect(), rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz.scores(docs).count() == 0
    lone = spark.createDataFrame([(next(k for k in range(99) if held(k)), "only held out")], "doc_id long, text string")
    r = katz.scores(lone).collect()[0]
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 4) and r.score == 0


def test_pack():
    for a in (np.zeros(0, np.uint64), np.arange(5, dtype=np.uint32), np.array([2**63], np.uint64), np.array([1.5, -2])):
        assert (katz.unpack(katz.pack(a)) == a).all()
