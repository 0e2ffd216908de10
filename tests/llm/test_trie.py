"""Trie-shared counts against a plain dynamic program over each pre-token."""

import random

import pandas as pd

from lectern.llm import trie
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCORES, LONGEST = trie.pieces(trie.default_vocabulary())


def plain(word):
    best = [(0.0, 0)]
    for k in range(1, len(word) + 1):
        options = [(best[j][0] + SCORES[word[j:k]], -(best[j][1] + 1)) for j in range(max(0, k - LONGEST), k) if word[j:k] in SCORES]
        if word[k - 1] not in SCORES:
            m = len(word[k - 1].encode())
            options.append((best[k - 1][0] + trie.BYTE_SCORE * m, -(best[k - 1][1] + m)))
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


def test_words():
    r = random.Random(3)
    words = ["", "a", "the", "internationalisation", "日本語テキスト", "\U0001f600\U0001f600", "é" * 40] + ["".join(r.choice("theinraoé猫") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    t = trie.Trie(SCORES, LONGEST)
    for w in sorted(words):
        assert t.count(trie.MARK + w) == plain(trie.MARK + w)
    assert len(t.best) < sum(map(len, words))


def test_query(spark):
    got = QUERIES["op3_trie_token_counts"](spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    split = [(t or "").encode().split() for t in docs.text]
    assert got.n_words.tolist() == [len(w) for w in split]
    assert got.n_tokens.tolist() == [sum(plain(trie.MARK + x.decode()) for x in w) for w in split]


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x" * 200_000), (4, " \n\t"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_words) for r in trie.counted(docs, ["doc_id"]).collect()}
    assert got == {(None, 2), (1, 0), (2, 0), (3, 1), (4, 0), (5, 1)}
    assert trie.counted(docs.limit(0), ["doc_id"]).count() == 0
