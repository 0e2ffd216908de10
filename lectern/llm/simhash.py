"""SimHash fingerprints and near-duplicate groups through pivot distance tables.

Pairs of fingerprints at most `radius` bits apart are found exactly and without comparing all with all:

1. Copies collapse to distinct fingerprints, with map-side combine.
2. Two fingerprints that differ in at most r bits agree on b - r of any b blocks of bits. Each distinct
   fingerprint is dealt to one bucket for every choice of b - r blocks. b follows the number of distinct
   fingerprints, so that unrelated ones rarely meet; the pairs found are the same for every b.
3. In a bucket, pivot tables hold each fingerprint's Hamming distance to many reference fingerprints.
   The distances of a pair at most r apart differ by at most r in every coordinate, so pairs with a larger
   maximum coordinate difference are discarded; survivors are verified by counting their differing bits.
4. A bucket passes on a spanning forest of its links, not all of them, and the forests' connected
   components are the groups. A dense bucket is searched breadth first against the fingerprints not yet
   reached, which a group of near copies empties after a few steps; a bucket of more than BLOCK fingerprints is
   searched block by block (blocks.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import EDGE, Search, block_links
from .common import byte_lists, local_components, one_of_each, packed, pieces, session, take, text_bytes, written
from .graph import connected_components

#: Reference fingerprints: pseudo-random and fixed.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"reference {i}".encode()) for i in range(16)], np.uint64)
DENSE = 48
BLOCK = 8192


def fingerprints(texts: list[bytes], shingle: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text (UTF-8): A-Z lower-cased, split at ASCII white space, `shingle` words a shingle."""
    sums = np.zeros((len(texts), 64), np.int64)
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    owners: list[int] = []
    ends: list[int] = []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[owners] += np.add.reduceat(bits, [0, *ends[:-1]], axis=0, dtype=np.int32)
            hashes.clear(), owners.clear(), ends.clear()

    for k, text in enumerate(texts):
        words = text.lower().split()
        n = max(1, len(words) - shingle + 1) if words else 0
        counts[k] = n
        if len(words) <= shingle:
            got = [digest(b" ".join(words), 42)] if words else []
        else:
            line = b" ".join(words)
            at = [0]
            for w in words:
                at.append(at[-1] + len(w) + 1)
            got = [digest(line[x : y - 1], 42) for x, y in zip(at, at[shingle:])]
        for x in range(0, n, 50_000):
            hashes += got[x : x + 50_000]
            owners.append(k)
            ends.append(len(hashes))
            if len(hashes) >= 50_000:
                flush()
    flush()
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _coordinates(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(PIVOTS[:, None] ^ fp[None, :]).astype(np.int8)


def _verified(fp: np.ndarray, co: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those within the radius: by maximum coordinate difference, then bit by bit."""
    for row in co:
        ok = np.abs(row[i] - row[j]) <= radius
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[ok], j[ok]


def _dense(fp: np.ndarray, co: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one bucket."""
    left = np.arange(1, fp.size)
    front = np.zeros(1, np.int64)
    a, b = [], []
    while left.size:
        if not front.size:
            front, left = left[:1], left[1:]
            continue
        x, front = front[:32], front[32:]
        near = np.abs(co[0][x][:, None] - co[0][left][None, :]) <= radius
        for row in co[1:4]:
            near &= np.abs(row[x][:, None] - row[left][None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = _verified(fp, co, x[i], left[j], radius)
        if i.size:
            j, first = np.unique(j, return_index=True)
            a.append(i[first])
            b.append(j)
            front = np.concatenate([front, j])
            left = left[~np.isin(left, j, assume_unique=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _forest(t: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole buckets; rows are sorted by (t, key)."""
    co = _coordinates(fp)
    same = (t[1:] == t[:-1]) & (key[1:] == key[:-1])
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    lengths = np.diff(np.concatenate([starts, [fp.size]]))
    a, b = [], []
    for s, n in zip(starts[lengths > DENSE], lengths[lengths > DENSE]):
        i, j = _dense(fp[s : s + n], co[:, s : s + n], radius)
        a.append(i + s)
        b.append(j + s)
    rest = np.repeat(np.where(lengths > DENSE, 0, lengths), lengths)
    room = rest - (np.arange(fp.size) - np.repeat(starts, lengths))  # rows from here to the bucket's end
    at = np.flatnonzero(room > 1)
    step = 1
    while at.size:
        i, j = _verified(fp, co, at, at + step, radius)
        a.append(i)
        b.append(j)
        step += 1
        at = at[room[at] > step]
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    node, inverse = np.unique(np.concatenate([fp[a], fp[b]]), return_inverse=True)
    root = local_components(node.size, inverse[: a.size], inverse[a.size :])
    up = root != np.arange(node.size)
    return node[up], node[root[up]]


def _search(radius: int) -> Search:
    """Spanning links of a block; of strays, one to each component among the others."""

    def found(node: np.ndarray, _: list, root: np.ndarray, stray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = node.view(np.uint64)
        co = _coordinates(fp)
        if not stray.any():
            return _dense(fp, co, radius)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rest = np.flatnonzero(~stray)
        for x in np.flatnonzero(stray):
            i, j = _verified(fp, co, np.full(rest.size, x), rest, radius)
            j = j[root[j] != root[x]]
            j = j[np.unique(root[j], return_index=True)[1]]
            a.append(np.full(j.size, x))
            b.append(j)
        return np.concatenate(a), np.concatenate(b)

    return found


def links(distinct: DataFrame, radius: int = 4, load: int = 16) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of distinct(fp) at most `radius` bits apart."""
    session(distinct)
    n, blocks = distinct.count(), radius + 1
    while blocks < 12 and n > load * 2 ** (64 * (blocks - radius) // blocks):
        blocks += 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(x) for x in combinations(block, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    schema = EDGE
    large = written(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK))
    some = not large.isEmpty()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def forest(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            t, key, fp = (np.concatenate(x) for x in zip(*parts))
            src, dst = _forest(t, key, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], schema=schema)

        for batch in batches:
            t, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            if not t.size:
                continue
            last = (t == t[-1]) & (key == key[-1])
            cut = int(t.size - np.argmin(last[::-1])) if not last.all() else 0
            if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (t[0], key[0])):
                held.append((t[:cut], key[:cut], fp[:cut]))
                yield forest(held)
                held = []
            held.append((t[cut:], key[cut:], fp[cut:]))
        if held:
            yield forest(held)

    small = dealt.join(large, ["t", "key"], "left_anti") if some else dealt
    by_bucket = small.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(search, "src long, dst long")
    if not some:
        return by_bucket
    members = dealt.join(large, ["t", "key"]).select("t", "key", "n", F.col("fp").alias("node"), F.lit(None).cast("binary").alias("payload"))
    return by_bucket.unionByName(block_links(members, BLOCK, _search(radius)))


def fingerprint_table(docs: DataFrame, keep: list[str], shingle: int = 4) -> DataFrame:
    """The kept columns of each row and `fp`, its text's fingerprint as a signed long."""
    session(docs)
    rows = text_bytes(docs, *keep)
    fields = [f for f in rows.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_lists(batch)
            fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprints(texts[x:y], shingle) for x, y in pieces(texts, 8 << 20))])
            yield take(batch, keep, {"fp": pa.array(fp.view(np.int64))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds}, fp long")


def _rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (with one row for each fp) and `root`, the same for fingerprints connected by links."""
    root = connected_components(links(distinct.select("fp"), radius))
    rows = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left")
    return written(rows.withColumn("root", F.coalesce("root", "fp")))


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of fingerprints at most `radius` bits apart,
    the row's own included. Null or empty texts have fingerprint zero and link like any other; a null
    doc_id is never the smallest (component_id is null only if the group has no other); repeated rows are
    kept; no rows give no rows; other columns are ignored.
    """
    each = written(fingerprint_table(docs, ["doc_id"], shingle))
    named = _rooted(written(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), radius)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return each.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each near-duplicate group of docs, unchanged: the one with the smallest doc_id.

    Among rows with that doc_id, the one with the least hash of the whole row stays, once if it is
    repeated. Rows with a null doc_id come after all others. Columns stay as they are.
    """
    marked = packed(docs, "doc_id", "text")
    each = written(fingerprint_table(marked, ["doc_id", "m1", "m2"], shingle))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "m1", "m2")
    named = _rooted(written(each.groupBy("fp").agg(F.min(rank).alias("first"))), radius)
    return one_of_each(marked, named.groupBy("root").agg(F.min("first").alias("k")).select("k.m1", "k.m2"))
