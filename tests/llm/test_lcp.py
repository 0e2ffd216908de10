"""Locally consistent parsing: equal insides, the order of documents, odd rows."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from lectern.llm import lcp
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(1, 9))) for _ in range(n))


ALL = 2**64 - 1
GOLD = 0x9E3779B97F4A7C15


def mix(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * times & ALL
    return x ^ x >> 31


def plain_labels(s):
    """Coin tossing, symbol by symbol: labels 0 to 5 by rounds, then 0 to 2."""
    label = s
    for _ in range(4):
        new = [0]
        for a, b in zip(label, label[1:]):
            k = 0
            while a != b and (a ^ b) >> k & 1 == 0:
                k += 1
            new.append(2 * k + (b >> k & 1))
        label = new
    for v in (5, 4, 3):
        before = list(label)
        for i in range(1, len(label) - 1):
            if before[i] == v:
                label[i] = next(x for x in (0, 1, 2) if x not in (before[i - 1], before[i + 1]))
    return label


def plain_levels(text):
    """The phrase names of one text, level by level, by the definition in the operator's docstring."""
    names, pad, level = [mix(ord(c) + 1) for c in text], [mix(k << 40) for k in range(1, lcp.PAD + 1)], 0
    while names and (level == 0 or len(names) > 1):
        level += 1
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix((x + n * GOLD) & ALL) for x, n in runs]
        label = plain_labels(pad + names + pad)
        phrases = []
        for k, x in enumerate(names):
            here = k + lcp.PAD
            if k == 0 or label[here - 1] < label[here] > label[here + 1]:
                phrases.append([])
            phrases[-1].append(x)
        names = []
        for phrase in phrases:
            name = level * GOLD & ALL
            for x in phrase:
                name = mix((name * 0x100000001B3 + x) & ALL)
            names.append(name)
        yield level, names


def plain_sketch(text):
    bins, whole = {}, None
    for level, names in plain_levels(text):
        whole = names[-1]
        for x in names if level >= lcp.LEVEL else []:
            bins[x >> 58] = min(bins.get(x >> 58, ALL), mix(x))
    if whole is not None and not bins:
        bins = {whole >> 58: mix(whole)}
    return [max(1, bins[k] >> 20 & 0xFFFF) if k in bins else 0 for k in range(lcp.BINS)]


def plain_likeness(a, b):
    either = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def test_query_matches_plain_version(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    texts = docs.text.fillna("").tolist()
    after = texts[1:] + texts[:1]
    got = QUERIES["op1_lcp_fingerprints"](spark, SF).toPandas().sort_values("doc_id")
    small = [k for k, t in enumerate(texts) if len(t) + len(after[k]) < 8_000]
    assert len(small) > 100
    for k, r in enumerate(got.itertuples()):
        if k in small:
            a, b = texts[k], after[k]
            own, edited, following = (plain_sketch(t) for t in (a, a[: len(a) - len(a) // 2] + b[: len(a) // 2], b))
            assert r.fingerprint == "".join(f"{x:04x}" for x in own) and r.edited_fingerprint == "".join(f"{x:04x}" for x in edited)
            assert r.near_edited == pytest.approx(plain_likeness(own, edited)) and r.near_next == pytest.approx(plain_likeness(own, following))


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa", "abab" * 9, "x" * 100 + "y", "\U0001f600é z", "the quick brown fox " * 7])
def test_plain_version_of_odd_texts(text):
    assert lcp.sketches([text])[0].tolist() == plain_sketch(text)


def test_ids_that_doubles_cannot_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(lcp, "ROWS_A_RANGE", 3)
    rows = [((1 << 60) + k, f"text {k * k} of row {k}") for k in range(40)] + [(None, f"{k:03d} x {k:03d}") for k in range(40)]
    got = {r.edited_sha256 for r in lcp.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = [t for _, t in rows[:40]]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(ordered, ordered[1:])]
    assert len(got) == 80 and {hashlib.sha256(e.encode()).hexdigest() for e in edited} <= got


@pytest.mark.parametrize("seed", range(4))
def test_equal_insides_share_names(seed):
    inner = words(200, seed)
    a, b = words(50, seed + 100) + " " + inner + words(9, seed + 7), words(133, seed + 200) + inner
    for level, (owner, names) in enumerate(lcp.phrase_names([inner, a, b]), 1):
        if level > 5:
            break
        core = [set(names[owner == k].tolist()) for k in range(3)]
        share = len(core[0] & core[1] & core[2]) / len(core[0])
        assert share >= 1 - 14 / (owner == 0).sum()


def test_batching_does_not_matter():
    texts = [words(n, n) for n in (0, 1, 2, 3, 40, 400)] + ["", "a", "aaaa" * 5000, "ab" * 3000, "\U0001f600x", "a" * 3]
    one = np.concatenate([lcp.sketches([t]) for t in texts])
    assert (lcp.sketches(texts) == one).all()
    assert (lcp.sketches(texts[::-1])[::-1] == one).all()
    assert lcp.likeness(one, one).tolist() == [1.0] * len(texts)
    assert not one[0].any() and one[1].any()


def test_likeness_follows_overlap():
    base = words(600, 1).split()
    got = []
    for keep in (600, 500, 300, 100, 0):
        other = " ".join(base[:keep] + words(600 - keep, 9).split())
        s = lcp.sketches([" ".join(base), other])
        got.append(float(lcp.likeness(s[:1], s[1:])[0]))
    assert got[0] == 1 and got[-1] < 0.05
    assert all(abs(g - k / (1200 - k)) < 0.2 for g, k in zip(got, (600, 500, 300, 100, 0)))


@pytest.mark.parametrize("rows", [4096, 7])
def test_query(spark, monkeypatch, rows):
    monkeypatch.setattr(lcp, "ROWS_A_RANGE", rows)
    got = QUERIES["op1_lcp_fingerprints"](spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    texts = docs.text.fillna("").tolist()
    after = texts[1:] + texts[:1]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, after)]
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    s, e, n = lcp.sketches(texts), lcp.sketches(edited), lcp.sketches(after)
    assert got.fingerprint.tolist() == lcp.written_out(s) and got.edited_fingerprint.tolist() == lcp.written_out(e)
    assert np.allclose(got.near_edited, lcp.likeness(s, e)) and np.allclose(got.near_next, lcp.likeness(s, n))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lcp, "ROWS_A_RANGE", 2)
    rows = [(None, "zz"), (None, "aaa bbb"), (5, None), (5, "x y"), (5, "x y"), (7, ""), (9, "long " * 50_000), (-3, "é" * 7)]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = lcp.compared(docs).collect()
    assert len(got) == len(rows) and sorted(r.n_chars for r in got) == [0, 0, 2, 3, 3, 7, 7, 250_000]
    lone = lcp.compared(docs.where("doc_id = -3")).collect()
    assert lone[0].edited_sha256 == hashlib.sha256(("é" * 7).encode()).hexdigest() and lone[0].near_next == 1
    assert lcp.compared(docs.limit(0)).count() == 0
    assert {len(r.fingerprint) for r in lcp.fingerprints(docs, ["doc_id"]).collect()} == {4 * lcp.BINS}
