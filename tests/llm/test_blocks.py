"""Buckets that are searched in blocks give the components of all pairs."""

import random

import numpy as np
import pytest

from lectern.llm import similar, simhash

from .test_simhash import plain_groups
from .test_similar import plain_kept


@pytest.mark.parametrize("block", [3, 40])
def test_similar_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "DENSE", 4)
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for size in (1, 60, 90):
        text = [word() for _ in range(100)]
        for _ in range(size):
            x = list(text)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(100)] = word()
            rows.append((len(rows), " ".join(x)))
    text = [word() for _ in range(150)]
    for _ in range(60):  # a chain: neighbours are similar, its ends are not
        text[rng.randrange(150)] = word()
        rows.append((len(rows), " ".join(text)))
    got = similar.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


@pytest.mark.parametrize("block", [3, 25])
def test_fingerprints_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = set()
    for b in base:  # walks: each step is near the one before, not the first
        x = int(b)
        for _ in range(60):
            for k in rng.integers(0, 24, 2):
                x ^= 1 << int(k)
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)}
    ordered = sorted(fps)
    distinct = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in ordered], "fp long")
    from lectern.llm.graph import connected_components

    root = {r.node: r.root for r in connected_components(simhash.links(distinct)).collect()}
    got = [root.get(int(np.uint64(x).astype(np.int64)), x) for x in ordered]
    want = plain_groups(ordered, list(range(len(ordered))))
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))
