"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents from one task. Its words are numbered by the test set's vocabulary; words
that no test item has become one separator, and so does a document's end. Runs of numbered words that are
shorter than the shortest test phrase cannot hold one and stay out of the index. The rest is indexed: suffix
array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks, suffix positions sampled every
`SAMPLE` words. All test phrases are searched backward at once, each step narrowing every phrase's interval by
two ranks; occurrences are located by walking the transform back to a sampled position. Their spans are merged
per document.

Test items reach the tasks in blocks of bounded size; each block is one pass over the documents, so that no
broadcast grows with the test set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, byte_lists, numbered, session, take, written

SAMPLE = 16
WINDOW = 10
#: Bytes of test text in a block, and indexed words in a shard (a longer document is a shard of its own).
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1 << 20


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z lower-cased."""
    return text.translate(ALNUM).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order; s holds numbers from 0 and ends with its only 0."""
    n, width = s.size, max(1, int(s.max()).bit_length())
    many = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(many):
        key <<= width
        key[: max(0, n - k)] |= s[k:]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[sa]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = first
    step = many
    while True:
        # Only suffixes whose rank is shared are sorted again, by the rank of what follows.
        shared = ~head | ~np.concatenate([head[1:], [True]])
        at = np.flatnonzero(shared)
        if not at.size:
            return sa
        own = sa[at]
        after = np.minimum(own + step, n - 1)
        order = np.argsort(rank[own] * n + rank[after], kind="stable")
        own = own[order]
        sa[at] = own
        group, after = rank[own], rank[np.minimum(own + step, n - 1)]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        head[at] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2


class FMIndex:
    """Counts and places of phrases in a sequence of numbers from 1."""

    def __init__(self, symbols: np.ndarray) -> None:
        s = np.concatenate([symbols.astype(np.int64), [0]])
        self.n = s.size
        sa = suffix_array(s)
        last = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(s.max()).bit_length())
        at = last
        for b in range(self.bits - 1, -1, -1):
            one = (at >> b & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((ones, self.n - int(ones[-1])))
            at = np.concatenate([at[~one], at[one]])
        self.last = last
        kept = sa % SAMPLE == 0
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.samples = sa[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place of the transform."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, zeros + lo1, lo - lo1)
            hi = np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def intervals(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that begin with each phrase; phrases are padded on the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(1, phrases.shape[1] + 1):
            live = live[(hi[live] > lo[live]) & (lengths[live] >= k)]
            if not live.size:
                break
            c = phrases[live, -k]
            known = c < self.before.size - 1
            hi[live[~known]] = lo[live[~known]]
            x, c = live[known], c[known]
            start = self.before[c]
            lo[x], hi[x] = start + self.rank(c, lo[x]), start + self.rank(c, hi[x])
        return lo, hi

    def located(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row of the suffix array."""
        out, steps = np.zeros(rows.size, np.int64), 0
        index = np.arange(rows.size)
        while index.size:
            found = self.kept[rows]
            out[index[found]] = self.samples[self.kept_rank[rows[found]]] + steps
            index, rows = index[~found], rows[~found]
            c = self.last[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The distinct windows of one block of test items, and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.items)}
        for name, text in items:
            w = [self.number.setdefault(x, len(self.number) + 2) for x in words(text)]
            for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
                found.setdefault(tuple(w[k : k + WINDOW]), set()).add(place[name])
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.table = np.zeros((len(found), WINDOW), np.int64)
        for row, x in zip(self.table, found):
            row[WINDOW - len(x) :] = x
        owners = [sorted(x) for x in found.values()]
        self.first_owner = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([y for x in owners for y in x], np.int64)
        self.least = int(self.lengths.min()) if found else 0


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def occurrences(phrases: Phrases, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word place, phrase) of all occurrences in a shard; docs hold each document's word numbers, 1 for others."""
    none = np.zeros(0, np.int64)
    sizes = np.array([d.size for d in docs], np.int64)
    flat = np.concatenate([none, *docs])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    known = np.concatenate([[False], flat > 1, [False]])
    turn = known[1:] != known[:-1]
    turn[ends] |= known[ends] | known[ends + 1]
    edges = np.flatnonzero(turn)
    lo, hi = edges[:-1], edges[1:]
    run = (hi - lo >= phrases.least) & known[lo + 1] if lo.size else none.astype(bool)
    lo, n = lo[run], (hi - lo)[run]
    if not n.size:
        return none, none, none
    place = spread(lo, n)
    gap = np.cumsum(n) + np.arange(n.size)  # a separator after each run
    symbols = np.ones(place.size + n.size, np.int64)
    origin = np.zeros_like(symbols)
    inside = np.ones(symbols.size, bool)
    inside[gap] = False
    symbols[inside], origin[inside] = flat[place], place
    index = FMIndex(symbols)
    first, last = index.intervals(phrases.table, phrases.lengths)
    count = last - first
    phrase = np.repeat(np.arange(count.size), count)
    at = origin[index.located(spread(first, count))]
    doc = np.searchsorted(ends, at, side="right") - 1
    return doc, at - ends[doc], phrase


def spans(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, prefix: str = "", shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs' rows (the columns in keep, else all) with n_words, spans array<struct<start, stop>>, items array<string>.

    spans are the merged runs [start, stop) of words inside occurrences of test windows: 10 consecutive words
    of an item, or all words of a shorter item. items are the items with occurring windows, as sorted strings
    (a null item_id as "null"; rows that repeat an id are one item). Null or empty texts and items have no
    words; long texts are searched whole; an empty test set hits nothing; rows may repeat. A prefix for the
    three names avoids a clash with columns of docs.
    """
    session(docs)
    name = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    tests = written(benchmark.select(name.alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct())
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = 1 if total <= BLOCK_BYTES else -(-3 * total // (2 * BLOCK_BYTES))  # dealt by hash, with room to spare
    blocks = [tests.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) for k in range(parts)]
    out = docs
    for k, block in enumerate(blocks):
        phrases = Phrases([(r.item, r.text.encode()) for r in block.select("item", "text").collect()])
        out = _pass(out, phrases, docs.columns if k + 1 < len(blocks) else keep or docs.columns, prefix, k == 0, shard_words)
    return out


def _pass(rows: DataFrame, phrases: Phrases, kept: list[str], prefix: str, first: bool, shard_words: int) -> DataFrame:
    """One pass over rows with one block of test items; later passes merge what earlier ones found."""
    sent = rows.sparkSession.sparkContext.broadcast(phrases)
    names = [prefix + x for x in ("n_words", "spans", "items")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        number = p.number.get
        for batch in batches:
            n_words: list[int] = []
            found_spans: list[list[dict[str, int]]] = []
            found_items: list[list[str]] = []
            shard: list[np.ndarray] = []
            size = 0
            for text in byte_lists(batch, "text"):
                w = words(text or b"")
                if shard and size + len(w) > shard_words:
                    _found(p, shard, found_spans, found_items)
                    shard, size = [], 0
                shard.append(np.fromiter((number(x, 1) for x in w), np.int64, len(w)))
                size += len(w)
                n_words.append(len(w))
            _found(p, shard, found_spans, found_items)
            if not first:
                old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names[1:]]
                found_spans = [_merged(a + b) for a, b in zip(found_spans, old[0])]
                found_items = [sorted({*a, *b}) for a, b in zip(found_items, old[1])]
            yield take(batch, kept, dict(zip(names, (pa.array(n_words, pa.int64()), pa.array(found_spans, span), pa.array(found_items, pa.list_(pa.string()))))))

    made = zip(names, ("bigint", "array<struct<start:int,stop:int>>", "array<string>"))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in [*((k, kinds[k]) for k in kept), *made]))


def _found(p: Phrases, shard: list[np.ndarray], found_spans: list[list[dict[str, int]]], found_items: list[list[str]]) -> None:
    """Adds the merged spans and the items of each document of a shard."""
    doc, at, phrase = occurrences(p, shard) if shard and p.lengths.size else (np.zeros(0, np.int64),) * 3
    order = np.argsort(doc, kind="stable")
    doc, at, phrase = doc[order], at[order], phrase[order]
    cuts = np.searchsorted(doc, np.arange(len(shard) + 1))
    for own, x, y in zip(shard, cuts, cuts[1:]):
        if x == y:
            found_spans.append([])
            found_items.append([])
            continue
        hits = np.zeros(own.size + 1, np.int64)
        np.add.at(hits, at[x:y], 1)
        np.add.at(hits, at[x:y] + p.lengths[phrase[x:y]], -1)
        inside = np.concatenate([[False], np.cumsum(hits)[:-1] > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        found_spans.append([{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)])
        q = np.unique(phrase[x:y])
        owners = np.unique(p.owners[spread(p.first_owner[q], p.first_owner[q + 1] - p.first_owner[q])])
        found_items.append([p.items[k] for k in owners])


def _merged(parts: list[dict[str, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for x in sorted(parts, key=lambda s: s["start"]):
        if out and x["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], x["stop"])
        else:
            out.append(dict(x))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without any word inside a test window's occurrence; columns as in docs."""
    plain = numbered(docs, "text")
    return spans(plain, benchmark).where(F.size("spans") == 0).select(*plain.columns).toDF(*docs.columns)
