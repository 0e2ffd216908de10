"""SimHash groups against a plain version over all pairs."""

import re

import numpy as np
import pandas as pd
import xxhash

from lectern.llm import simhash
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, ids, radius=4):
    fps = np.array(fps, np.uint64)
    group = np.arange(len(fps))
    while True:
        new = np.array([group[np.bitwise_count(fps ^ f) <= radius].min() for f in fps])
        if (new == group).all():
            break
        group = new
    return [min((ids[j] for j in range(len(ids)) if group[j] == group[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_query_matches_all_pairs(spark):
    got = QUERIES["op4_simhash_pivots"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == plain_groups(fps, docs.doc_id.tolist())


def test_links_random_and_dense(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:  # chains and balls around some of them, one of them large
        for _ in range(400 if b == base[0] else 6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    want = plain_groups(fps, list(range(len(fps))))
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for load in (16, 0.0001):  # few large blocks, many small ones
        root = simhash.connected_components(simhash.links(rows, 4, load)).toPandas()
        named = dict(zip(root.node, root.root))
        got = pd.Series([named.get(x, x) for x in rows.toPandas().fp])
        assert got.groupby(got).transform(lambda s: s.index.min()).tolist() == want


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, None), (6, ""), (7, " \n"), (None, "q w e r t y"), (9, "x " * 70_000), (10, "X " * 70_000)]
    docs = spark.createDataFrame([(i, t, "z", "y") for i, t in rows], "doc_id long, text string, fp string, root string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id or -1) for r in simhash.near_groups(docs).collect()))
    assert got == [(False, 3, 3), (False, 3, 3), (False, 5, 5), (False, 6, 5), (False, 7, 5), (False, 9, 9), (False, 10, 9), (True, 0, -1), (True, 0, 3)]
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect()) == [(0, "q w"), (3, "a b"), (5, ""), (9, "x x")]
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0
