"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. At each level, runs of one symbol become one symbol; deterministic coin tossing then
labels each symbol from itself and its left neighbour, again and again until six labels are left, which are
reduced to three; local maxima of the labels begin the phrases, of two to four symbols each. A phrase is named by a
hash of its symbols, and the names are the next level's text. A symbol's label depends on a few neighbours only,
so equal substrings are parsed alike inside, wherever they stand.

The fingerprint is a sketch of the set of phrase names from level 3 on (some 15 characters and more): names are
dealt to 64 bins by hash and each bin keeps its least; it is written as 64 groups of four hex digits, 0000 for an
empty bin. The likeness of two fingerprints is the share of equal bins among those not empty in both, an estimate
of the sets' Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import session, written

BINS = 64
LEVEL = 3
#: Symbols between documents, distinct and more than any label's reach.
PAD = 12
#: Rows of a range, ranges at most (larger ones beyond it), and rows drawn for each to cut them by.
ROWS_A_RANGE = 1024
MOST_RANGES = 1 << 16
DRAWN = 16
BATCH_CHARS = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _lowest(x: np.ndarray) -> np.ndarray:
    """The place of the lowest bit of each number; all are over 0."""
    return np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))


def _tossed(s: np.ndarray) -> np.ndarray:
    """Labels 0 to 2, neighbours different, from symbols whose neighbours are different."""
    diff = s[1:] ^ s[:-1]
    low = _lowest(diff)
    label = np.zeros(s.size, np.uint8)
    label[1:] = 2 * low + ((s[1:] >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(3):  # 128 labels, 14, 8, 6
        diff = label[1:] ^ label[:-1]
        low = _lowest(diff | (diff == 0).astype(np.uint8) * np.uint8(1))
        new = np.zeros_like(label)
        new[1:] = 2 * low + ((label[1:] >> low) & np.uint8(1))
        label = new
    for v in (5, 4, 3):
        at = np.flatnonzero(label[1:-1] == v) + 1
        a, b = label[at - 1], label[at + 1]
        used = (np.uint8(1) << np.minimum(a, 7)) | (np.uint8(1) << np.minimum(b, 7))
        label[at] = np.where(used & 1 == 0, 0, np.where(used & 2 == 0, 1, 2)).astype(np.uint8)
    return label


def phrase_names(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By level from 1: the documents and the names of all phrases, in order."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    names = _mixed(flat.astype(np.uint64) + np.uint64(1))
    pad = _mixed(np.arange(1, PAD + 1, dtype=np.uint64) << np.uint64(40))
    level = 0
    while True:
        level += 1
        if not names.size:
            return
        # Runs of a symbol become one.
        head = np.concatenate([[True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
        start = np.flatnonzero(head)
        length = np.diff(np.append(start, names.size)).astype(np.uint64)
        names, owner = names[start], owner[start]
        long = length > 1
        names[long] = _mixed(names[long] + length[long] * np.uint64(0x9E3779B97F4A7C15))
        same = np.flatnonzero((names[1:] == names[:-1]) & (owner[1:] == owner[:-1]))
        names[same + 1] ^= np.uint64(1)  # a hash collision of neighbours; labels need them different
        # Documents apart, with the same symbols between them everywhere.
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        shift = np.cumsum(np.concatenate([[1], (owner[1:] != owner[:-1]).astype(np.int64)])) * PAD
        s = np.empty(names.size + PAD * (first.size + 1), np.uint64)
        inside = np.arange(names.size) + shift
        gaps = (np.append(inside[first] - PAD, s.size - PAD)[:, None] + np.arange(PAD)[None]).ravel()
        s[gaps] = np.tile(pad, first.size + 1)
        s[inside] = names
        label = _tossed(s)
        top = np.zeros(s.size, bool)
        top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        begin = top[inside]
        begin[first] = True
        at = np.flatnonzero(begin)
        length = np.diff(np.append(at, names.size))
        made = np.full(at.size, level, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(int(length.max())):
            more = length > k
            made[more] = _mixed(made[more] * np.uint64(0x100000001B3) + names[at[more] + k])
        names, owner = made, owner[at]
        yield owner, names
        # A document that has become one phrase is done, whatever the others are.
        more = np.bincount(owner, minlength=len(texts))[owner] > 1
        names, owner = names[more], owner[more]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of BINS 16-bit numbers for each text; 0 is an empty bin."""
    out = np.full((len(texts), BINS), np.uint64(2**64 - 1))
    final = np.zeros(len(texts), np.uint64)
    has = np.zeros(len(texts), bool)
    for level, (owner, names) in enumerate(phrase_names(texts), 1):
        if level >= LEVEL:
            np.minimum.at(out, (owner, (names >> np.uint64(58)).astype(np.int64)), _mixed(names))
        final[owner], has[owner] = names, True  # at last the name of the whole
    rest = has & (out == np.uint64(2**64 - 1)).all(axis=1)  # texts that end below the level
    out[rest, (final[rest] >> np.uint64(58)).astype(np.int64)] = _mixed(final[rest])
    value = (out >> np.uint64(20) & np.uint64(0xFFFF)).astype(np.uint16)
    return np.where(out == np.uint64(2**64 - 1), 0, np.maximum(value, 1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, row by row; two empty sketches are alike."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(either == 0, 1.0, same / np.maximum(1, either))


def written_out(sketch: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in sketch]


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of each row of docs(text, ...) and its fingerprint; a null text is empty."""
    session(docs)
    kinds = dict(docs.dtypes)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(len(keep)).to_pylist(), []
            for x, y in _slices(texts):
                out += written_out(sketches(texts[x:y]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "fingerprint"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fingerprint string")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _order_keys(known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Byte strings that sort as (whether there is an id, id, hash) do."""
    out = np.zeros(len(ids), [("known", "u1"), ("id", ">u8"), ("hash", ">u8")])
    out["known"] = known
    for name, values in (("id", ids), ("hash", hashes)):
        out[name] = values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S17")


def ranged(rows: DataFrame) -> DataFrame:
    """rows(doc_id, hash, ...) with `range`, ascending with (doc_id, hash).

    Ranges are cut at keys drawn by hash, some DRAWN a range, so the driver holds at most DRAWN * MOST_RANGES of them
    (16 MB); rows without an id, or of one id, are parted by their text hash.
    """
    n = rows.count()
    parts = min(MOST_RANGES, n // ROWS_A_RANGE + 1)
    if parts == 1:
        return rows.withColumn("range", F.lit(0))
    rate = max(1, n // (DRAWN * parts))
    key = [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("hash")]
    drawn = rows.select(*key).where(F.pmod(F.xxhash64("known", "id", "hash"), F.lit(rate)) == 0).distinct().toArrow()
    keys = np.sort(_order_keys(*(drawn[c].to_numpy() for c in ("known", "id", "hash"))))
    cuts = keys[np.arange(1, parts) * keys.size // parts] if keys.size >= parts else keys
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def place(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, _order_keys(known.to_numpy(), ids.to_numpy(), hashes.to_numpy()), side="right"))

    return rows.withColumn("range", place(*key))


def successors(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (range, extra, doc_id, text), such that each range's rows in order of (extra, doc_id,
    text hash, text) are consecutive documents, followed by an extra copy of the next range's first.

    The order of all rows is by doc_id, null first, rows of one id by text hash, length and text; the first follows
    the last. The texts move once, and no task holds more than its ranges.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = ranged(rows.withColumn("hash", F.xxhash64("text"))).withColumn("size", F.length("text"))
    firsts = written(rows.groupBy("range").agg(F.min(F.struct("doc_id", "hash", "size")).alias("f")))
    last = firsts.agg(F.max("range")).first()[0]
    # A row a range, MOST_RANGES at most.
    before = firsts.withColumn("to", F.coalesce(F.lag("range").over(W.orderBy("range")), F.lit(last)))
    before = F.broadcast(before.select("to", F.col("f.doc_id").alias("id"), F.col("f.hash").alias("h"), F.col("f.size").alias("n")))
    same = rows["doc_id"].eqNullSafe(before["id"]) & (rows["hash"] == before["h"]) & (rows["size"] == before["n"])
    extra = rows.join(before, same).groupBy("to").agg(F.min(F.struct("text", "doc_id", "hash")).alias("x"))
    extra = extra.select(F.col("to").alias("range"), F.lit(1).alias("extra"), "x.doc_id", "x.hash", F.length("x.text").alias("size"), "x.text")
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra)
    return both.repartition("range").sortWithinPartitions("range", "extra", "doc_id", "hash", "size", "text").select("range", "extra", "doc_id", "text")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    The edited text is the text with its last half, rounded down, replaced by as much of the next document's
    beginning, in ascending order of doc_id (null first, rows of one id by text hash); the first follows the last. Null
    texts are empty; a lone document follows itself; no rows give no rows; other columns are ignored.
    """
    session(docs)
    rows = successors(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def digest(run: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Rows for all but the last of consecutive documents."""
        own = [t for _, t in run]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, own[1:])]
        s, e = sketches(own), sketches(edited)
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        cols = [[i for i, _ in run[:-1]], [len(t) for t in own[:-1]], sha, written_out(s[:-1]), written_out(e), likeness(s[:-1], e), likeness(s[:-1], s[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for extra, i, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                held.append((i, t))
                size += len(t)
                if extra or size > BATCH_CHARS and len(held) > 1:
                    yield digest(held)
                    held = [] if extra else held[-1:]
                    size = len(t)
        if held:
            raise ValueError("a range without its extra row")

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
