"""Stages return the user's own columns unchanged, whatever their names."""

import pytest

from lectern.llm import curriculum, fmindex, quality, similar, simhash

NAMES = ["_row", "_id", "_nth", "_key", "_junk", "junk_", "_abuse", "_votes", "_spans", "n_words", "size", "target", "copies", "place", "key", "m1", "m2", "row", "range", "at", "n", "s", "fp", "root", "_t", "Mark", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, "ab"[k % 2], f"the {k} quick brown fox number {k * 7} jumps over lazy dogs {k % 5} near river {k % 11}", *([70 + k] * len(NAMES))) for k in range(30)]
    kind = "doc_id long, source string, text string, " + ", ".join(f"`{n}` long" for n in NAMES)
    return spark.createDataFrame(rows, kind)


STAGES = {
    "mixed": curriculum.mixed,
    "simhash": simhash.deduplicated,
    "similar": similar.deduplicated,
    "accepted": quality.accepted,
    "decontaminated": lambda d: fmindex.decontaminated(d, d.sparkSession.createDataFrame([("x", "none of these")], "item_id string, text string")),
}


@pytest.mark.parametrize("name", STAGES)
def test_stage(docs, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all(r[3:] == (70 + r[0],) * len(NAMES) for r in rows)


def test_positions_name_their_own(docs):
    out = curriculum.positions(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["size_", "source_size", "target_", "copies_", "positions"]
    for r in out.collect():
        assert r["size"] == r["at"] == r["a.b"] == 70 + r["doc_id"] and r["size_"] == 15


def test_maps_in_rows(spark):
    docs = spark.createDataFrame([(1, "a", "one two three", {"x": 1}), (1, "a", "one two three", {"x": 1})], "doc_id long, source string, text string, more map<string, int>")
    assert simhash.deduplicated(docs).collect() == similar.deduplicated(docs).collect() == docs.collect()[:1]
    assert {r.more["x"] for r in curriculum.mixed(docs).collect()} == {1}


def test_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "ROWS_A_RANGE", 20)
    rows = [(None, "s", " ".join(["w"] * (1 + k % 7))) for k in range(300)] + [(None, "s", "same text here")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a, b = ([tuple(r) for r in curriculum.positions(docs.repartition(k)).select("size", "copies", "positions").collect()] for k in (1, 6))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == 500
    total = sum(len(r[2].split()) for r in rows)
    assert abs(sum(n * c for n, c, _ in a) - 1.5 * total) <= 7
