"""Language-model scores by Katz backoff: Good-Turing discounted bigrams over discounted unigrams.

P(w | h) = s(h) d2(c(hw)) c(hw) / c(h) where hw was seen in training, else a(h) P(w);
P(w) = d1(c(w)) c(w) / N where w was seen, else what the discounts leave, for all unknown words as one type.
a(h) makes the probabilities of all types after h sum to one exactly; s(h) is 1 unless no successor of h is
discounted, when it is c(h) / (c(h) + 1) to leave something. A document's start is the context that its
predecessor's end would be, so that every token has a context and c(h) is h's unigram count.

Text is read once, into chunks of tokens written to the shared folder: distinct words as 56-bit hashes, and the
token stream as numbers of the chunk's words. The table is bucketed by chunk, so that what comes back to a chunk
is shuffled to where the chunk is, never the chunk. All counting is between chunks and hash ranges of n-grams, in
compressed columns and pre-aggregated by chunk:

1. Each chunk asks each range of words for their counts; ranges sum over chunks and answer in the asked order.
2. Each chunk asks each range of bigrams. Ranges follow the context's hash, so backoff weights are local; a
   context with very many tokens is split over several ranges by its successors, and its few sums are added up.
   The merged tables of the ranges are the model; they are written before anything is scored.
3. Ranges answer with counts and backoff weights; each chunk evaluates its tokens, recursively.

A word's rows in a range are at most one a chunk, so frequent words make no skew. Words are 56-bit hashes as
contexts and 40-bit ones as a context's successors (a context with a million of them expects half a clash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import byte_lists, release, session, text_bytes, written

K = 5
CHUNK_TOKENS = 3 << 19
RANGE_ENTRIES = 1_500_000
HOT_TOKENS = 250_000
MOST_HOT = 65_536
END_HASH = np.uint64(0x9E3779B97F4A7C)
ROW = "chunk long, kind int, p int, docs array<long>, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary, b5 binary"


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed; planes of zeros take no room."""
    a = np.ascontiguousarray(a)
    return a.dtype.char.encode() + zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if raw.size else np.zeros(0, kind)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for counts r = 0..K from n[r], how many n-grams have count r = 0..K+1; larger counts are not discounted.

    Katz's formula where it gives a value between 0 and 1; otherwise (small corpora) absolute discounting.
    """
    d = np.ones(K + 1)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        katz = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = katz if 0 < katz < 1 else (r - absolute) / r
    return d


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """d(c) c, as floats."""
    return np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0) * c


class Numbers(dict):
    """Words' numbers from 1, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def _row(chunk: int, kind: int, p: int, blobs: list[bytes], docs: list[int | None] | None = None) -> dict:
    return {"chunk": chunk, "kind": kind, "p": p, "docs": docs, **{f"b{k}": blobs[k] if k < len(blobs) else None for k in range(6)}}


SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("p", pa.int32()), ("docs", pa.list_(pa.int64())), *((f"b{k}", pa.binary()) for k in range(6))])


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: docs, and packed training marks, token counts by document, word hashes, token stream."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        numbers, ids, marks, sizes, stream, held = Numbers(), [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal first, held
            digest = xxhash.xxh64_intdigest
            hashes = np.array([int(END_HASH), *(digest(w) >> 8 for w in numbers)], np.uint64)
            blobs = [pack(np.array(marks, np.uint8)), pack(np.array(sizes, np.uint32)), pack(hashes), pack(np.concatenate(stream))]
            row = _row(first, 0, -1, blobs, list(ids))
            first, held = first + 1, 0
            for x in (numbers, ids, marks, sizes, stream):
                x.clear()
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), byte_lists(batch)):
                words = text.lower().split()
                own = np.zeros(len(words) + 1, np.uint32)
                own[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                ids.append(i)
                marks.append(zlib.crc32(str("" if i is None else i).encode()) % 5 != 1)
                sizes.append(own.size)
                stream.append(own)
                held += own.size
                if held >= CHUNK_TOKENS:
                    yield chunk()
        if ids:
            yield chunk()

    rows = text_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, ROW)


class Chunk:
    """A chunk's arrays, and its requests' order."""

    def __init__(self, row: dict, n_ranges: int) -> None:
        self.id, self.docs = row["chunk"], row["docs"]
        self.train, self.sizes, self.hashes, self.stream = (unpack(row[f"b{k}"]) for k in range(4))
        self.weights = np.repeat(self.train, self.sizes)
        part = (self.hashes >> np.uint64(20)) % np.uint64(n_ranges)
        self.order = np.argsort(part, kind="stable")
        self.cuts = np.searchsorted(part[self.order], np.arange(n_ranges + 1))

    def word_requests(self) -> Iterator[dict]:
        counts = np.bincount(self.stream, self.weights, self.hashes.size).astype(np.uint64)
        for p, (x, y) in enumerate(zip(self.cuts, self.cuts[1:])):
            if x < y:
                own = self.order[x:y]
                yield _row(self.id, 1, p, [pack(self.hashes[own]), pack(counts[own])])

    def counted(self, answers: list[dict]) -> np.ndarray:
        """Training counts of the chunk's words."""
        out = np.zeros(self.hashes.size, np.uint64)
        for a in answers:
            out[self.order[self.cuts[a["p"]] : self.cuts[a["p"] + 1]]] = unpack(a["b0"])
        return out.astype(np.int64)

    def bigrams(self, c1: np.ndarray, n_ranges: int, hot: int) -> Bigrams:
        return Bigrams(self, c1, n_ranges, hot)


class Bigrams:
    """A chunk's distinct bigrams, by range and context."""

    def __init__(self, chunk: Chunk, c1: np.ndarray, n_ranges: int, hot: int) -> None:
        n = chunk.hashes.size
        before = np.zeros(chunk.stream.size, np.int64)
        before[1:] = chunk.stream[:-1]
        key, self.inverse = np.unique(before * n + chunk.stream, return_inverse=True)
        h, w = key // n, key % n
        count = np.bincount(self.inverse, chunk.weights, key.size).astype(np.uint32)
        hh, wh = chunk.hashes[h], chunk.hashes[w] >> np.uint64(16)
        split = np.where(c1[h] > hot, wh % np.maximum(1, -(-c1[h] // hot)).astype(np.uint64), 0).astype(np.uint64)
        part = (mixed(hh + split) >> np.uint64(20)) % np.uint64(n_ranges)
        self.order = np.lexsort((wh, hh, part))
        h, w, hh, part = h[self.order], w[self.order], hh[self.order], part[self.order]
        self.h, self.w, self.c1 = h, w, c1
        self.wh, self.count, self.hh = wh[self.order], count[self.order], hh
        self.cuts = np.searchsorted(part, np.arange(n_ranges + 1))

    def requests(self, chunk: int) -> Iterator[dict]:
        for p, (x, y) in enumerate(zip(self.cuts, self.cuts[1:])):
            if x < y:
                hh = self.hh[x:y]
                head = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]]))
                n = np.diff(np.append(head, y - x)).astype(np.uint32)
                c = self.count[x:y]
                # Only bigrams seen in training weigh a successor's unigram count.
                blobs = [hh[head], n, self.c1[self.h[x:y][head]], self.wh[x:y], np.where(c > 0, self.c1[self.w[x:y]], 0), c]
                yield _row(chunk, 2, p, [pack(b) for b in blobs])


def _sum_words(t: pa.Table) -> pa.Table:
    """Answers a range of words: for each chunk the counts in the asked order; and, as chunk -1, the range's statistics."""
    rows = t.select(["chunk", "p", "b0", "b1"]).to_pylist()
    asked = [unpack(r["b0"]) for r in rows]
    word, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack(r["b1"]) for r in rows]).astype(float), word.size).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum([a.size for a in asked])])
    out = [_row(r["chunk"], 1, r["p"], [pack(total[inverse[x:y]].astype(np.uint64))]) for r, x, y in zip(rows, cuts, cuts[1:])]
    seen = total > 0
    stats = [int(total.sum()), int(seen.sum()), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()]
    out.append(_row(-1, 1, rows[0]["p"], [pack(word[seen]), pack(total[seen].astype(np.uint64))], stats))
    return pa.Table.from_pylist(out, SCHEMA)


#: One row a range: statistics, the model's table (contexts, their counts and numbers of seen successors; successors,
#: as 32-bit marks, and their counts; the successors' sum of P(w)), and what each chunk asked.
MODEL = "p int, stats array<long>, t_h binary, t_c1 binary, t_n binary, t_w binary, t_c binary, t_lower binary, chunks array<long>, counts array<binary>, places array<binary>"


def _sum_bigrams(t: pa.Table, uni: Unigrams) -> pa.Table:
    """Merges what chunks ask a range of bigrams."""
    rows = t.to_pylist()
    heads = [unpack(r["b0"]) for r in rows]
    sizes = [unpack(r["b1"]) for r in rows]
    h = np.concatenate([np.repeat(a, n) for a, n in zip(heads, sizes)])
    w, cw, c = (np.concatenate([unpack(r[f"b{k}"]) for r in rows]) for k in (3, 4, 5))
    order = np.lexsort((w, h))
    hs, ws = h[order], w[order]
    head = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
    group = np.cumsum(head) - 1
    total = np.bincount(group, c[order].astype(float)).astype(np.int64)
    answer = np.empty(h.size, np.int64)
    answer[order] = total[group]
    contexts, first = np.unique(np.concatenate(heads), return_index=True)
    c1 = np.concatenate([unpack(r["b2"]) for r in rows])[first]
    keep = np.flatnonzero(head)
    weight = np.maximum.reduceat(cw[order], keep)
    seen = total > 0
    keep, weight = keep[seen], weight[seen]
    n = np.bincount(np.searchsorted(contexts, hs[keep]), minlength=contexts.size).astype(np.uint32)
    cuts = np.concatenate([[0], np.cumsum([int(x.sum()) for x in sizes])])
    row = {
        "p": rows[0]["p"],
        "stats": np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist(),
        "t_h": pack(contexts),
        "t_c1": pack(c1),
        "t_n": pack(n),
        "t_w": pack((ws[keep] >> np.uint64(8)).astype(np.uint32)),
        "t_c": pack(total[seen]),
        "t_lower": pack(np.bincount(np.searchsorted(contexts, hs[keep]), uni(weight), contexts.size).astype(float)),
        "chunks": [r["chunk"] for r in rows],
        "counts": [pack(answer[x:y].astype(np.uint64)) for x, y in zip(cuts, cuts[1:])],
        "places": [pack(np.searchsorted(contexts, a).astype(np.uint32)) for a in heads],
    }
    kinds = {"p": pa.int32(), "stats": pa.list_(pa.int64()), "chunks": pa.list_(pa.int64()), "counts": pa.list_(pa.binary()), "places": pa.list_(pa.binary())}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


class Unigrams:
    """P(w) by count."""

    def __init__(self, total: int, kinds: int, n: np.ndarray) -> None:
        self.total, self.kinds, self.d = total, kinds, discounts(n)
        r = np.arange(1, K + 1)
        self.left = float(((1 - self.d[1:]) * r * n[1 : K + 1]).sum() / total) if total else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(self.d, c) / max(1, self.total), self.left)


def _context_sums(r: dict, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range's contexts: hash, count, and the sums over their seen successors of P(w | h) and of P(w)."""
    h, c1, n, c, lower = (unpack(r[k]) for k in ("t_h", "t_c1", "t_n", "t_c", "t_lower"))
    place = np.repeat(np.arange(h.size), n)
    own = np.bincount(place, discounted(d2, c), h.size) / np.maximum(1, c1)
    return h, c1, own.astype(float), lower.copy()


def _backoff(c1: np.ndarray, own: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a(h) and s(h)."""
    none = 1 - own < 1e-9
    scale = np.where(none & (c1 > 0), c1 / (c1 + 1), 1.0)
    return np.where(c1 > 0, (1 - own * scale) / (1 - lower), 1.0), scale


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text, ...).

    The model learns from rows whose crc32(doc_id as text) mod 5 is not 1 and scores all. Scores are log10
    probabilities of the whole text and its end. Null or empty texts are an end alone; a null doc_id counts as
    empty text for the remainder; repeated rows are learnt and scored as often as they come; without training
    rows every word is unknown; no rows give no rows; other columns are ignored.
    """
    spark = session(docs)
    buckets = 2 * max(1, docs.rdd.getNumPartitions())
    read = written(chunks(docs), bucket=(buckets, "chunk"))

    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([unpack(r["b2"]).size for r in rows], pa.int64()), pa.array([int(unpack(r["b1"]).sum()) for r in rows], pa.int64())], names=["words", "tokens"])

    n = read.select("b1", "b2").mapInArrow(meta, "words long, tokens long").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    word_ranges, ranges = max(1, -(-n[0] // RANGE_ENTRIES)), max(1, -(-n[1] // RANGE_ENTRIES))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist(list(Chunk(r, word_ranges).word_requests()), SCHEMA)

    words = written(read.mapInArrow(ask_words, ROW).groupBy("p").applyInArrow(_sum_words, ROW))
    release(spark)
    sums = {r.pos: r.s for r in words.where("chunk = -1").select(F.posexplode("docs")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    total, kinds = sums.get(0, 0), sums.get(1, 0)
    uni = Unigrams(total, kinds, np.array([0, *(sums.get(k + 1, 0) for k in range(1, K + 2))], float))
    hot = max(HOT_TOKENS, -(-total // MOST_HOT))
    answers = words.where("chunk >= 0")

    def ask_bigrams(own: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(own.to_pylist()[0], word_ranges)
        c1 = chunk.counted(told.to_pylist())
        return pa.Table.from_pylist(list(chunk.bigrams(c1, ranges, hot).requests(chunk.id)), SCHEMA)

    model = written(read.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_bigrams, ROW).groupBy("p").applyInArrow(lambda t: _sum_bigrams(t, uni), MODEL))
    release(spark)
    sums = {r.pos: r.s for r in model.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    d2 = discounts(np.array([0, *(sums.get(k, 0) for k in range(K + 1))], float))

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, c1, own, lower = _context_sums(r, d2)
                x = c1 > hot
                yield pa.RecordBatch.from_arrays([pa.array(h[x].view(np.int64), pa.int64()), pa.array(c1[x].astype(np.int64)), pa.array(own[x].astype(float)), pa.array(lower[x].astype(float))], names=["h", "c1", "own", "lower"])

    table = ["t_h", "t_c1", "t_n", "t_c", "t_lower"]
    # Contexts over the bound are fewer than MOST_HOT, as their counts add up to the tokens at most.
    split = model.select(*table).mapInArrow(hot_sums, "h long, c1 long, own double, lower double").groupBy("h").agg(F.sum("own").alias("own"), F.sum("lower").alias("lower")).collect()
    whole = spark.sparkContext.broadcast({np.uint64(r.h % (1 << 64)): (r.own, r.lower) for r in split})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, c1, own, lower = _context_sums(r, d2)
                for k in np.flatnonzero(c1 > hot):
                    own[k], lower[k] = whole.value[h[k]]
                a, s = _backoff(c1, own, lower)
                out = []
                for chunk, counts, places in zip(r["chunks"], r["counts"], r["places"]):
                    at = unpack(places)
                    out.append(_row(chunk, 2, r["p"], [counts, pack(a[at]), pack(s[at])]))
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = told.to_pylist()
        chunk = Chunk(own.to_pylist()[0], word_ranges)
        c1 = chunk.counted([r for r in rows if r["kind"] == 1])
        b = chunk.bigrams(c1, ranges, hot)
        p = np.empty(b.h.size)
        for r in rows:
            if r["kind"] == 2:
                x, y = b.cuts[r["p"]], b.cuts[r["p"] + 1]
                hh = b.hh[x:y]
                group = np.cumsum(np.concatenate([[False], hh[1:] != hh[:-1]]))
                c2, a, s = unpack(r["b0"]).astype(np.int64), unpack(r["b1"])[group], unpack(r["b2"])[group]
                p[x:y] = np.where(c2 > 0, s * discounted(d2, c2) / np.maximum(1, c1[b.h[x:y]]), a * uni(c1[b.w[x:y]]))
        log = np.empty_like(p)
        log[b.order] = np.log10(p)
        starts = np.cumsum(chunk.sizes.astype(np.int64)) - chunk.sizes
        base = np.log10((c1 + 0.5) / (total + 0.5 * (kinds + 1)))
        known = (c1 > 0).astype(np.int64)
        per = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            [pa.array(chunk.docs, pa.int64()), pa.array(chunk.train == 0), pa.array(chunk.sizes.astype(np.int64)), pa.array(per(known[chunk.stream])), pa.array(np.full(starts.size, total, np.int64)), pa.array(per(base[chunk.stream])), pa.array(per(log[b.inverse]))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    told = model.select(*table, "p", "chunks", "counts", "places").mapInArrow(answer, ROW)
    return read.groupBy("chunk").cogroup(answers.unionByName(told).groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
