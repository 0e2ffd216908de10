"""Token shards: the perfect hash, and exact round trips against the tokenizer itself."""

import sys
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from lectern.llm import shards
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ids_of(text):
    t = Tokenizer.from_file(shards.default_vocabulary())
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.zeros(n, shards.KEY)
    keys["id"] = rng.choice(10**9, n, replace=False) - 5 * 10**8
    keys["nth"][: n // 2] = 1
    data = shards.built_index(keys, np.arange(n), np.arange(n) * 2)
    mph, _ = shards.PerfectHash.from_bytes(data)
    assert sorted(mph.slots(keys)) == list(range(n))
    offset, length = shards.looked_up(data, keys)
    assert offset.tolist() == list(range(n)) and length.tolist() == list(range(0, 2 * n, 2))
    other = keys.copy()
    other["nth"] += 7
    assert (shards.looked_up(data, other)[0] >= 0).sum() <= 1


def test_encoder_forgets():
    encode = shards.Encoder(shards.default_vocabulary(), 20)
    texts = [f"word{k % 13} other{k} the" for k in range(200)]
    for k in range(0, 200, 10):
        got = encode([t.encode() for t in texts[k : k + 10]])
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [ids_of(t) for t in texts[k : k + 10]]
    assert len(encode.new) + len(encode.old) < 100


def test_remembered_words_leave_room():
    """Two workers' words beside an executor's JVM: 1.4 million of them took 207 MB a worker."""
    encode = shards.Encoder(shards.default_vocabulary())
    encode.encoded = lambda word: word[-6:]
    held = 0
    for k in range(0, 1_500_000, 50_000):
        encode([b" ".join(b"word%d" % x for x in range(k, k + 50_000))])
        kept = (encode.new, encode.old)
        held = max(held, sum(map(sys.getsizeof, kept)) + 88 * sum(map(len, kept)))
    assert held < 130e6


def test_query_matches_tokenizer(spark):
    got = QUERIES["op5_mph_shards"](spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = [ids_of(t) for t in docs.text]
    sizes = [len(x) for x in want]
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.n_tokens.tolist() == sizes
    assert got.start.tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_odd_rows_and_fetch(spark):
    texts = ["It's <|endoftext|>a TEST of white\x0bspace é ́x ΑΣ Σ İ", None, "", "x" * 50_000, "don't we'll 12,345", "same", "same", "<|endof text|> <|startoftext|>"]
    rows = list(zip([4, 2, 3, None, 4, 9, 9, None], texts))
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keys string")
    records = shards.written(shards.shards(docs, shard_ids=200)).cache()
    assert records.count() > 2
    got = shards.read_back(records).toPandas().sort_values("start")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = [ids_of(t) for _, t in order]
    assert [None if pd.isna(x) else int(x) for x in got.doc_id] == [i for i, _ in order]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    found = {r.doc_id: r.ids for r in shards.fetch(records, spark.createDataFrame([(4,), (9,), (77,), (None,)], "doc_id long")).collect()}
    assert found == {4: want[[i for i, _ in order].index(4)], 9: ids_of("same")}
    assert shards.tokenised(docs.limit(0)).count() == 0
