"""Token counts by dynamic programming shared along a trie.

A text's tokens are those of the best segmentation of its pre-tokens by unigram scores. Distinct pre-tokens go
into a trie; the forward score of a place in a pre-token - the best score of any segmentation up to it, and the
pieces of that segmentation - depends on the characters before it only, so it is computed once for each trie
node, however many pre-tokens share the prefix. A pre-token's node keeps its terminal count.

The pieces are those of a public SentencePiece vocabulary. It stores merge ranks, not probabilities; a piece's
score is that of Zipf's law at its rank, -ln(rank + 1). Characters without a piece cost one token for each of
their UTF-8 bytes, as byte fallback would have it. Pre-tokens are words at ASCII white space, each with the
word-start mark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_lists, session, take, text_bytes

MARK = "▁"
BYTE_SCORE = -14.0
#: Nodes that a worker's trie may have before it starts a new one, and pre-tokens whose counts it remembers.
NODES = 300_000
REMEMBERED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def pieces(path: str) -> tuple[dict[str, float], int]:
    """Scores of a vocabulary's pieces, and the length of the longest."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [k for k in range(p.vocab_size()) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k))]
    scores = {p.id_to_piece(k): -float(np.log(rank + 1)) for rank, k in enumerate(sorted(own, key=lambda k: (-p.get_score(k), k)), 1)}
    return scores, max(map(len, scores))


class Trie:
    """Forward scores and token counts of prefixes; node 0 is the empty one."""

    def __init__(self, scores: dict[str, float], longest: int) -> None:
        self.scores, self.longest = scores, longest
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of a word; fewer tokens win ties, then the longer last piece."""
        if len(self.best) > NODES:
            self.clear()
        child, best, tokens, scores = self.child, self.best, self.tokens, self.scores
        node, path = 0, [0]
        for k, c in enumerate(word, 1):
            after = child[node].get(c)
            if after is None:
                top, n = best[path[-1]] + BYTE_SCORE * (m := len(c.encode("utf-8", "surrogatepass"))), tokens[path[-1]] + m
                if c in scores:
                    top, n = -1e300, 0
                low = max(0, k - self.longest)
                for start in range(low, k):
                    score = scores.get(word[start:k])
                    if score is not None:
                        before = path[start]
                        score += best[before]
                        if score > top or score == top and tokens[before] + 1 < n:
                            top, n = score, tokens[before] + 1
                after = len(best)
                child[node][c] = after
                child.append({})
                best.append(top)
                tokens.append(n)
            path.append(after)
            node = after
        return tokens[node]


def counted(docs: DataFrame, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """The kept columns of each row of docs(text, ...), n_words and n_tokens.

    Each task counts its own documents, whole, without a shuffle; tries and remembered counts are bounded and
    only save time. Null or empty texts have no tokens; rows may repeat; no rows give no rows. vocabulary: a
    SentencePiece file, at the same path on all hosts.
    """
    session(docs)
    path = vocabulary or default_vocabulary()
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*pieces(path))
        known: dict[bytes, int] = {}
        get = known.__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in byte_lists(batch):
                words = text.split()
                if len(known) > REMEMBERED:
                    known.clear()
                for w in sorted(set(words).difference(known)):
                    known[w] = trie.count(MARK + w.decode())
                n_words.append(len(words))
                n_tokens.append(sum(map(get, words)))
            yield take(batch, keep, {"n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    made = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return text_bytes(docs, *keep).mapInArrow(run, f"{made}, n_words long, n_tokens long")
