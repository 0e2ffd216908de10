"""The mix against a plain version that shares the excess round by round."""

import hashlib
import re
from collections import defaultdict

import pytest

from lectern.llm import curriculum

SF = "/root/testdata/sf0.001"


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(rows, factor=1.5, most=2):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, free = factor * sum(sizes.values()), [s for s in order if sizes[s]]
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if target[s] + share * weight[s] > most * sizes[s]]
        if not over:
            for s in free:
                target[s] += share * weight[s]
            break
        for s in free:
            new = min(target[s] + share * weight[s], most * sizes[s])
            left -= new - target[s]
            target[s] = new
        free = [s for s in free if target[s] < most * sizes[s] - 1e-9]
    return sizes, target


def plain_mix(rows):
    """How often each row is taken, rows in their order in the source's queue."""
    sizes, target = plain_targets(rows)
    out = []
    for s in sizes:
        own = sorted((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i is not None, i or 0, size(t), t) for i, x, t in rows if x == s)
        place = 0
        for _, known, i, n, t in own:
            copies = sum(place + p * sizes[s] + n / 2 <= target[s] + 1e-9 for p in (0, 1)) if target[s] > 0 else 0
            out.append((i if known else None, s, n, copies, t))
            place += n
    return out


ODD = [(1, "a", "x y z"), (2, "a", "p q"), (3, "b", "w " * 50), (3, "b", "w " * 50), (None, "b", "n m"), (5, None, "u v w"), (6, "c", None), (7, "c", ""), (8, "d", "z " * 9000), (9, "é", "k l m"), (10, "Z", "one two three four")]


@pytest.mark.parametrize("ranges", [1 << 14, 2])
def test_odd_rows(spark, monkeypatch, ranges):
    monkeypatch.setattr(curriculum, "ROWS_A_RANGE", ranges)
    docs = spark.createDataFrame([(*r, "v") for r in ODD], "doc_id long, source string, text string, lang string")
    got = curriculum.positions(docs).collect()
    _, target = plain_targets(ODD)
    assert sorted((r.doc_id or 0, r.size, r.copies) for r in got) == sorted((i or 0, n, c) for i, _, n, c, _ in plain_mix(ODD))
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.copies == len(r.positions) and all(0 <= p <= 1 for p in r.positions)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and all(not r.positions for r in got[len(first) :])
    mixed = curriculum.mixed(docs)
    assert mixed.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in mixed.collect()) == sorted((i or 0, t or "") for i, _, _, c, t in plain_mix(ODD) for _ in range(c))
    assert curriculum.positions(docs.limit(0)).count() == 0 and curriculum.mixed(docs.limit(0)).count() == 0


def test_reruns_agree_and_come_near_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ([tuple(r) for r in curriculum.positions(docs.repartition(k)).select("doc_id", "target", "copies", "positions").collect()] for k in (1, 5))
    assert a == b
    rows = curriculum.positions(docs).toPandas()
    for _, own in rows.groupby("source"):
        assert abs((own["size"] * own.copies).sum() - own.target.iloc[0]) <= own["size"].max()
        assert own.copies.max() <= 2


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x / 10, t) for x in range(11) for t in curriculum.TILTS], "share double, tilt double")
    for r in rows.withColumn("at", curriculum._position(F.col("share") * 40, F.lit(40.0), F.col("tilt"))).collect():
        assert (1 - r.tilt) * r["at"] + r.tilt * r["at"] ** 2 == pytest.approx(r.share)
