"""Token-id shards with a minimal perfect hash index.

Format: a Parquet table of records. Each record is one shard: documents consecutive in ascending doc_id order,
  part, seq      the shard's place in the whole order
  n_docs, n_ids  its documents and ids
  width          bytes of an id: 2 or 4, little-endian
  payload        the raw ids of all its documents, one after the other
  keys           its documents' keys in order: 8 bytes doc_id, 4 bytes occurrence (top bit: null doc_id)
  index          a minimal perfect hash of the keys, and by slot a 32-bit fingerprint, offset and length
Spark's writer commits the files, so a lost task leaves no part of a shard and any store that Spark reaches will do.

The hash is a cascade of bit arrays: each level hashes the remaining keys to twice as many places, keys alone in
their place set its bit, the others go on; a key's slot is the rank of its bit. A lookup reads one bit a level
(under two on average) and one slot; a key that is not there almost always fails the fingerprint.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_lists, pieces, session, text_bytes, written

END = 1
#: Ids in a shard (a longer document is a shard of its own), and words whose ids a worker remembers (some 150 bytes each).
SHARD_IDS = 1 << 20
REMEMBERED = 700_000
#: Letters (checked further if not ASCII), and ASCII punctuation without the apostrophe.
ENDING = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level tokenizers write a byte as a character: itself if it is printable, else the next one from 256 on.
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
NULL_KEY = np.uint32(1 << 31)
KEY = np.dtype([("id", "<i8"), ("nth", "<u4")])
SLOT = np.dtype([("mark", "<u4"), ("offset", "<u8"), ("length", "<u8")])
SHARD = "part int, seq int, n_docs int, n_ids long, width int, payload binary, keys binary, index binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 pseudo-random bits of each key."""
    x = keys["id"].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 2**64 - 1)
    for add in (keys["nth"].astype(np.uint64), np.uint64(seed)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) + add
    return x


class PerfectHash:
    """Slots 0..n-1 of n distinct keys."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while keys.size:
            at = (_mixed(keys, len(levels)) % np.uint64(2 * keys.size)).astype(np.int64)
            alone = np.bincount(at, minlength=2 * keys.size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for some that were not there."""
        out, left = np.full(keys.size, -1, np.int64), np.arange(keys.size)
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(keys[left], seed) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<I{len(self.levels)}I", len(self.levels), *(b.size for b in self.levels))
        return sizes + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        """The hash and the place after it."""
        (n,) = struct.unpack_from("<I", data)
        at, levels = 4 + 4 * n, []
        for size in struct.unpack_from(f"<{n}I", data, 4):
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels), at


def built_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    mph = PerfectHash.of(keys)
    slots = np.zeros(keys.size, SLOT)
    at = mph.slots(keys)
    slots["mark"][at] = _mixed(keys, 1 << 20).astype(np.uint32)
    slots["offset"][at], slots["length"][at] = offsets, lengths
    return mph.to_bytes() + slots.tobytes()


def looked_up(index: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of each key, in ids; offset -1 for keys that the index does not have."""
    mph, at = PerfectHash.from_bytes(index)
    table = np.frombuffer(index, SLOT, mph.size, at)
    slot = mph.slots(keys)
    known = slot >= 0
    known[known] = table["mark"][slot[known]] == _mixed(keys[known], 1 << 20).astype(np.uint32)
    offset, length = np.full(keys.size, -1, np.int64), np.zeros(keys.size, np.int64)
    offset[known], length[known] = table["offset"][slot[known]], table["length"][slot[known]]
    return offset, length


def latin(text: str) -> bool:
    """Whether a text is Latin letters, each composed."""
    return text.isalpha() and max(text) < "\u0250"


class Words(dict):
    """Packed ids by word; a word that is not there is taken from the older generation, or encoded."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        got = self.encoder.old.get(word)
        if got is None:
            got = self.encoder.encoded(word)
        self[word] = got
        return got


class Encoder:
    """Ids of texts. ASCII white space parts words for this kind of tokenizer, so ids are remembered by word.

    A worker keeps its encoder from task to task. Words are remembered in two generations: when the newer is
    full the older is dropped, and a word that is met again moves to the newer. Where the tokenizer splits
    letters from ASCII punctuation and takes no note of their case (it is asked), a word that ends in
    punctuation is put together from its parts, and plain letters go to the tokenizer's model directly.
    """

    made: dict[str, Encoder] = {}

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.most = remembered // 2
        self.new = Words(self)
        self.old: dict[bytes, bytes] = {}
        self.splits = self._splits()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _splits(self) -> bool:
        """Whether letters may be encoded without their case and apart from the punctuation after them."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        probes = [("Theword", ",."), ("EX", "###"), ("Caf\u00e9s", "!!"), ("\u00c0\u00dfn", "&&&"), ("Zq", ")]|"), ("x\u00e9", "")]
        return all(ids(a + b) == ids(a.lower()) + ids(b) == self.model(a.lower().encode()) + ids(b) for a, b in probes)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def model(self, letters: bytes) -> list[int]:
        text = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def parts(self, word: bytes) -> tuple[bytes, bytes]:
        """The letters and the punctuation of a word that is no more than these, else the word."""
        if not self.splits:
            return word, b""
        m = ENDING.fullmatch(word)
        if not m:
            return word, b""
        if m[1].isascii():
            return m[1].lower(), m[2]
        letters = m[1].decode().lower()
        return (letters.encode(), m[2]) if latin(letters) else (word, b"")

    def encoded(self, word: bytes) -> bytes:
        """Packed ids of a word, or of its parts."""
        a, b = self.parts(word)
        if b or a != word:
            return self.new[a] + self.new[b] if b else self.new[a]
        if self.splits and (word.isalpha() or not word.isascii() and latin(own := word.decode()) and own == own.lower()):
            return self.pack(self.model(word))
        return self.pack(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, Words(self)
        end = END.to_bytes(self.width, "little")
        get = self.new.__getitem__
        return [b"".join(map(get, t.split())) + end for t in texts]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shards(docs: DataFrame, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shard records of docs(doc_id, text, ...), each document's ids ending with id 1.

    Null or empty texts have the end id alone; a null doc_id comes first; rows that repeat a doc_id are
    kept, in order of their texts, and told apart by occurrence; no rows give no shards; other columns are
    ignored. vocabulary: the file of a tokenizer that splits at ASCII white space, at the same path on all hosts.
    """
    session(docs)
    path = vocabulary or default_vocabulary()
    rows = text_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_t").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        held: list[bytes] = []
        ids: list[int | None] = []
        seq = size = part = 0
        last, nth = object(), 0

        def record() -> pa.RecordBatch:
            nonlocal last, nth, seq, size
            keys = np.zeros(len(ids), KEY)
            for k, i in enumerate(ids):
                nth = nth + 1 if k + seq and i == last else 0
                last = i
                keys[k] = (0, nth | int(NULL_KEY)) if i is None else (i, nth)
            lengths = np.array([len(x) // encode.width for x in held], np.int64)
            offsets = np.cumsum(lengths) - lengths
            row = [part, seq, len(ids), int(lengths.sum()), encode.width, b"".join(held), keys.tobytes(), built_index(keys, offsets, lengths)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            held.clear()
            ids.clear()
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            texts, names = byte_lists(batch), batch.column(0).to_pylist()
            part = batch.column(batch.schema.get_field_index("_part"))[0].as_py() if names else part
            for x, y in pieces(texts, 1 << 20):
                for name, got in zip(names[x:y], encode(texts[x:y])):
                    if held and size + len(got) // encode.width > shard_ids:
                        yield record()
                    held.append(got)
                    ids.append(name)
                    size += len(got) // encode.width
        if held:
            yield record()

    return rows.mapInArrow(run, SHARD)


def with_starts(records: DataFrame) -> DataFrame:
    """records with `start`, the ids of all shards before. One small row a shard is gathered for the running sum."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    sums = records.select("part", "seq", "n_ids").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return records.join(sums.drop("n_ids"), ["part", "seq"])


def read_back(records: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seq, offset) of each document, its ids found through the index."""
    session(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["keys"], KEY)
                offset, length = looked_up(r["index"], keys)
                if (offset < 0).any():
                    raise ValueError(f"shard {r['part']}/{r['seq']}: a document is not in its index")
                ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(ids[o : o + n].tobytes()) for o, n in zip(offset, length)]
                null = (keys["nth"] & NULL_KEY) > 0
                n = keys.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys["id"], pa.int64(), mask=null), pa.array(offset + r["start"]), pa.array(length), pa.array(crc, pa.int64()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["seq"]] * n, pa.int32()), pa.array(offset)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "offset"],
                )

    return with_starts(records).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int, offset long")


def fetch(records: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of the first row of each of keys(doc_id) that the shards have: keyed access.

    Keys find their shard by an equi-join with the key column alone; only shards that are asked give their payload.
    """
    session(records)
    wanted = keys.select("doc_id").where("doc_id is not null").distinct()
    spread = records.select("part", "seq", F.explode(_key_ids("keys")).alias("doc_id")).distinct()
    asked = spread.join(wanted, "doc_id").groupBy("part", "seq").agg(F.collect_list("doc_id").alias("asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ask = np.zeros(len(r["asked"]), KEY)
                ask["id"] = r["asked"]
                offset, length = looked_up(r["index"], ask)
                ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype(np.int32)
                got = [(i, ids[o : o + n]) for i, o, n in zip(r["asked"], offset, length) if o >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return records.join(asked, ["part", "seq"]).mapInArrow(answer, "doc_id long, ids array<int>")


def _key_ids(name: str) -> Column:
    """The doc_ids of a keys column, repeats once."""

    @F.pandas_udf("array<long>")
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series([k["id"][k["nth"] == 0] for k in (np.frombuffer(x, KEY) for x in s)])

    return ids(name)


def tokenised(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes docs' shards to the shared folder and reads them back, document by document."""
    return read_back(written(shards(docs, vocabulary)))
