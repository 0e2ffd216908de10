"""Quality classifier from weak labels.

Two questions are asked of every document: is it junk, is it abusive. For each, overlapping heuristic labellers
vote yes, no or abstain. Expectation-maximisation over the counts of vote patterns, gathered from all documents,
estimates the labellers' accuracies and the posterior of each pattern; nothing but the pattern table (bounded by
3^labellers rows) reaches the driver. The posteriors then label a bounded sample of documents, on which a hashed
logistic scorer is trained; the scorer judges every document. A document is rejected if either score is over
one half.

One labeller of abuse knows a list of English words; another weighs word stems that are far more frequent in
documents labelled as toxic than in others, mined from a bounded sample of the labelled rows, and so covers
other languages. Neither is trusted as such: EM finds how far each is right.

The scorer's features are hashed: the document's distinct words, and bins of its surface statistics.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, byte_lists, numbered, session, take, text_bytes, written

#: Words of abuse, in English.
ABUSE = frozenset(
    b"""asshole bastard bitch clown cretin dimwit disgusting dumb dumbass dunce fatso filth halfwit idiot idiotic
    idiots imbecile loser losers lowlife maggot moron moronic morons nitwit pathetic scum scumbag shit stupid
    trash twit vermin worthless wretch""".split()
)

BITS = 18
#: Documents in the scorer's training sample, at most.
SAMPLE = 8_000
REMEMBERED = 400_000
#: Labelled rows that stems are mined from and their threshold set by, at most; their words bound the stems.
LABELLED = 20_000
STEM_BYTES = 6
TASKS = ("junk", "abuse")


def stem(word: bytes) -> bytes:
    """The first STEM_BYTES bytes of a word, without the beginning of a character that goes on after them."""
    cut = STEM_BYTES
    while cut < len(word) and word[cut] & 0xC0 == 0x80:
        cut -= 1
    return word[:cut]


@dataclass
class Mined:
    """Stems of abuse with their log ratios, and the score from which a text counts as abusive."""

    stems: dict[bytes, float]
    threshold: float

    def score(self, clean: list[bytes]) -> float:
        get = self.stems.get
        return sum(w for w in (get(x if x.isascii() and len(x) <= STEM_BYTES else stem(x)) for x in clean) if w) / (len(clean) ** 0.8 + 1)


def statistics(text: bytes, mined: Mined | None = None) -> tuple[dict[str, int], list[bytes]]:
    """Surface statistics of a text in bins of small whole numbers, and its words without punctuation."""
    raw = text.split()
    clean = text.translate(ALNUM).split()
    n = max(1, len(raw))
    symbols = sum(map(text.count, (b"#", b"$", b"%", b"&", b"*", b"|", b"~", b"^", b"@", b"=", b"<", b">", b"{", b"}", b"\\", b"_")))
    marks = text.count(b"!")
    kinds = len(set(raw))
    letters = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    repeats = sum(map(bytes.__eq__, raw, raw[1:]))
    abuse = sum(map(ABUSE.__contains__, clean))
    grade = lambda x, *cuts: sum(x > c for c in cuts)
    return {
        "words": grade(len(raw), 0, 4, 20, 100, 1000),
        "symbols": grade(symbols / n, 0.02, 0.1, 0.3, 1.0),
        "marks": grade(marks / n, 0.05, 0.2, 0.5),
        "upper": grade(upper / max(1, letters), 0.1, 0.3, 0.6) if letters > 20 else 0,
        "kinds": grade(kinds / n**0.9, 0.15, 0.3, 0.5) if n > 30 else 3,
        "repeats": grade(repeats / n, 0.05, 0.2, 0.5) if n > 10 else 0,
        "abuse": grade(abuse, 0, 1, 2, 5),
        "abuse_share": grade(abuse / n, 0.0, 0.002, 0.01, 0.05),
        "abuse_kinds": grade(len(ABUSE.intersection(clean)), 0, 1, 2) if abuse else 0,
        "mined": grade(mined.score(clean) / mined.threshold, 0.3, 0.7, 1.0, 1.5) if mined else -1,
    }, clean


#: Labellers by task: name and rule, from statistics to 1 (yes), 0 (no) or -1 (abstains).
LABELLERS = {
    "junk": {
        "symbols": lambda s: 1 if s["symbols"] >= 3 else -1,
        "marks": lambda s: 1 if s["marks"] >= 2 else -1,
        "upper": lambda s: 1 if s["upper"] >= 3 else -1,
        "kinds": lambda s: 1 if s["kinds"] == 0 else -1,
        "repeats": lambda s: 1 if s["repeats"] >= 2 else -1,
        "plain": lambda s: 0 if s["symbols"] < 3 and s["marks"] < 2 and s["upper"] < 3 and s["kinds"] >= 2 and s["repeats"] == 0 else -1,
    },
    "abuse": {
        "many": lambda s: 1 if s["abuse"] >= 2 else -1,
        "share": lambda s: 1 if s["abuse_share"] >= 2 else -1,
        "kinds": lambda s: 1 if s["abuse_kinds"] >= 2 else -1,
        "plain": lambda s: 0 if s["abuse"] == 0 and s["mined"] <= 1 else -1,
        "mined": lambda s: -1 if s["mined"] in (-1, 2) else int(s["mined"] > 2),
    },
}


def votes(s: dict[str, int]) -> str:
    """The labellers' votes as one letter each: y, n, or - (abstains)."""
    return "".join({1: "y", 0: "n", -1: "-"}[f(s)] for t in TASKS for f in LABELLERS[t].values())


@dataclass
class LabelModel:
    """Of one task: the share of yes, and by labeller the probabilities of y, n, - given yes and given no."""

    prior: float
    given: np.ndarray  # labeller, truth (no, yes), vote (n, y, -)

    @classmethod
    def fitted(cls, patterns: list[str], counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """EM from a start at which labellers that vote are nearly always right.

        The start also counts as votes on a fiftieth of the documents: a labeller that never meets another would
        else be as well explained by being always wrong.
        """
        n = len(patterns[0]) if patterns else 0
        seen = np.array([["ny-".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), n)
        start = np.array([[0.72, 0.03, 0.25], [0.03, 0.72, 0.25]])
        trust = 1 + 0.02 * counts.sum()
        model = cls(0.1, np.repeat(start[None], n, axis=0))
        for _ in range(rounds if counts.sum() else 0):
            p = model.posterior(patterns)
            model.prior = float(np.clip((p * counts).sum() / counts.sum(), 0.01, 0.5))
            for k in range(n):
                for truth, w in ((0, (1 - p) * counts), (1, p * counts)):
                    got = np.bincount(seen[:, k], w, 3) + trust * start[truth]
                    model.given[k, truth] = got / got.sum()
        return model

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of yes for each pattern."""
        out = []
        for p in patterns:
            odds = np.log(self.prior / (1 - self.prior))
            for k, c in enumerate(p):
                v = "ny-".index(c)
                if v < 2:  # abstaining says nothing
                    odds += np.log(self.given[k, 1, v] / self.given[k, 0, v])
            out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        return np.array(out)


class Features:
    """Hashed features of texts."""

    def __init__(self, mined: Mined | None) -> None:
        self.mined = mined
        self.place: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[dict[str, int], np.ndarray]:
        s, clean = statistics(text, self.mined)
        if len(self.place) > REMEMBERED:
            self.place.clear()
        place, own = self.place, set(clean)
        for w in own.difference(place):
            place[w] = zlib.crc32(w) & (1 << BITS) - 1
        at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        bins = [zlib.crc32(f" {k} {v}".encode()) & (1 << BITS) - 1 for k, v in s.items()]
        return s, np.concatenate([at, np.array(bins, np.int64)])


def _values(n_words: int, n_bins: int) -> np.ndarray:
    """Feature values: bins count fully, words together as much as one bin at most."""
    return np.concatenate([np.full(n_words, 1 / np.sqrt(n_words + 1)), np.ones(n_bins)])


def fit_scorer(features: list[np.ndarray], labels: np.ndarray, n_bins: int, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic scorer (the last one the constant) for soft labels, by gradient steps with momentum."""
    weights = np.zeros((1 << BITS) + 1)
    if not features:
        return weights
    rows = np.repeat(np.arange(len(features)), [f.size + 1 for f in features])
    cols = np.concatenate([np.append(f, 1 << BITS) for f in features])
    vals = np.concatenate([np.append(_values(f.size - n_bins, n_bins), 1.0) for f in features])
    step, speed = 8.0 / (n_bins + 2), np.zeros_like(weights)
    for _ in range(rounds):
        score = np.bincount(rows, vals * weights[cols], len(features))
        error = 1 / (1 + np.exp(-score)) - labels
        slope = np.bincount(cols, vals * error[rows], weights.size) / len(features) + 1e-5 * weights
        speed = 0.9 * speed - step * slope
        weights += speed
    return weights


@dataclass
class Classifier:
    """The label models and scorers of both tasks, and what was mined for the labellers."""

    models: dict[str, LabelModel]
    weights: dict[str, np.ndarray]
    mined: Mined | None = None


def _parts(pattern: str) -> dict[str, str]:
    out, at = {}, 0
    for t in TASKS:
        out[t] = pattern[at : at + len(LABELLERS[t])]
        at += len(LABELLERS[t])
    return out


def mine(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Mined | None:
    """Stems that mark abuse in docs(doc_id, text) by labels(doc_id, toxic), from at most `bound` labelled ids.

    The ids of least hash are taken; a row that repeats an id counts as toxic if any is. Three in four of them
    give the stems, by the documents that have each; the others give the threshold, at which fewest are wrong.
    None if labels have no toxic or no other row among docs.
    """
    session(docs)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    ids = np.array(sorted((r.doc_id, int(r.toxic > 0)) for r in rows), np.int64).reshape(-1, 2)
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def labelled(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
        """Id, label and words of a batch's labelled rows."""
        own, label = sent.value[:, 0], sent.value[:, 1]
        for i, t in zip(batch.column(0).to_pylist(), byte_lists(batch)):
            at = np.searchsorted(own, i) if i is not None else own.size
            if at < own.size and own[at] == i:
                yield i, int(label[at]), t.translate(ALNUM).split()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {b"": [0, 0]}
        for batch in batches:
            for i, label, clean in labelled(batch):
                if zlib.crc32(str(i).encode()) % 4:
                    for x in set(map(stem, clean)):
                        found.setdefault(x, [0, 0])[label] += 1
                    found[b""][label] += 1
            if len(found) > REMEMBERED:
                yield table(found)
                found = {b"": [0, 0]}
        yield table(found)

    def table(found: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in (0, 1))], names=["stem", "clean", "toxic"])

    source = text_bytes(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = written(source.mapInArrow(count, "stem binary, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    total = counts.where(F.octet_length("stem") == 0).first()
    if total is None or not total.clean or not total.toxic:
        return None
    ratio = F.log((F.col("toxic") + 0.5) / (total.toxic + 1) / ((F.col("clean") + 0.5) / (total.clean + 1)))
    # Two standard errors off, a stem must still be three times as frequent among the toxic.
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where(F.octet_length("stem") > 0).withColumn("w", ratio).where("toxic >= 4").where(F.col("w") - 2 * error > float(np.log(3)))
    stems = {bytes(r.stem): r.w for r in best.collect()}
    trial = Mined(stems, 1.0)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(label, trial.score(clean)) for i, label, clean in labelled(batch) if zlib.crc32(str(i).encode()) % 4 == 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], names=["label", "score"])

    # As many rows as labelled ids at most, unless docs repeat ids; counted by score, not listed.
    rated = source.mapInArrow(rate, "label long, score double").groupBy(F.round("score", 3).alias("score")).agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).orderBy("score").collect()
    score, toxic, n = (np.array([float(r[k]) for r in rated]) for k in range(3))
    if not toxic.sum():
        return None
    wrong = np.cumsum(toxic) + (n - toxic).sum() - np.cumsum(n - toxic)  # if texts up to this score pass
    at = np.flatnonzero(wrong == wrong.min())
    cut = score[at[len(at) // 2]]
    after = score[score > cut]
    return Mined(stems, max(0.01, float((cut + after.min()) / 2 if after.size else cut + 0.01)))


def marks_of(texts: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each whole text, by which the scorer's sample is drawn."""
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, bound: int = LABELLED) -> Classifier:
    """Label models from the votes on all of docs(doc_id, text, ...); scorers from at most `sample` of them.

    The sample takes the documents of least text hash, one of each text, until it is full. No rows give
    scorers that reject nothing.
    """
    session(docs)
    mined = mine(docs, labels, bound) if labels is not None else None

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_lists(batch)
            yield pa.RecordBatch.from_arrays([pa.array([votes(statistics(t, mined)[0]) for t in texts], pa.string()), pa.array(marks_of(texts))], names=["votes", "mark"])

    voted = written(text_bytes(docs).mapInArrow(vote, "votes string, mark long"))
    table = voted.groupBy("votes").count().collect()
    models = {}
    for t in TASKS:
        patterns = [_parts(r.votes)[t] for r in table]
        models[t] = LabelModel.fitted(patterns, np.array([r["count"] for r in table], float))
    marks = voted.groupBy("mark").agg(F.min("votes").alias("votes")).orderBy("mark").limit(sample)
    most = marks.agg(F.max("mark")).first()[0]
    n_bins = len(statistics(b"")[0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Features(mined), set()
        for batch in batches:
            out = []
            texts = byte_lists(batch)
            for t, mark in zip(texts, marks_of(texts).tolist()):
                if mark <= most and mark not in seen:
                    seen.add(mark)
                    s, f = make(t)
                    out.append((mark, votes(s), f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.list_(pa.int32())))], names=["mark", "votes", "features"])

    got = [] if most is None else text_bytes(docs).mapInArrow(gather, "mark long, votes string, features array<int>").dropDuplicates(["mark"]).toArrow()
    weights = {}
    features = [x.values.to_numpy().astype(np.int64) for x in got["features"]] if len(got) else []
    for t in TASKS:
        labels = models[t].posterior([_parts(p)[t] for p in got["votes"].to_pylist()]) if features else np.zeros(0)
        weights[t] = fit_scorer(features, labels, n_bins)
    return Classifier(models, weights, mined)


def scored(docs: DataFrame, classifier: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of each row of docs, _votes, and the scores _junk and _abuse (0 to 1)."""
    session(docs)
    mined = classifier.mined
    sent = docs.sparkSession.sparkContext.broadcast({t: w.astype(np.float32) for t, w in classifier.weights.items()})
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(mined)
        for batch in batches:
            scores: dict[str, list[float]] = {t: [] for t in TASKS}
            cast = []
            for raw in byte_lists(batch, text):
                s, f = make(raw or b"")
                cast.append(votes(s))
                v = _values(f.size - len(s), len(s))
                for t in TASKS:
                    w = sent.value[t]
                    scores[t].append(1 / (1 + np.exp(-np.clip((w[f] * v).sum() + w[-1], -30, 30))))
            yield take(batch, keep, {"_votes": pa.array(cast, pa.string()), **{f"_{t}": pa.array(scores[t], pa.float64()) for t in TASKS}})

    made = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return docs.mapInArrow(run, f"{made}, _votes string, _junk double, _abuse double")


def judged(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, bound: int = LABELLED) -> DataFrame:
    """(doc_id, votes, junk_score, abuse_score, rejected) for every row of docs(doc_id, text, ...).

    The classifier is fitted on docs itself; labels(doc_id, toxic) only serve one labeller and may be missing or
    empty. Null or empty texts have no words: the labellers find nothing wrong, and they stay. Repeated rows
    are judged alike, long texts whole, null ids kept; no rows give no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    out = scored(rows, fit(rows, labels, sample, bound), ["doc_id"])
    reject = (F.col("_junk") > 0.5) | (F.col("_abuse") > 0.5)
    return out.select("doc_id", F.col("_votes").alias("votes"), F.col("_junk").alias("junk_score"), F.col("_abuse").alias("abuse_score"), reject.alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, bound: int = LABELLED) -> DataFrame:
    """The rows of docs that the classifier, fitted on docs, does not reject; columns unchanged."""
    plain = numbered(docs, "doc_id", "text")
    out = scored(plain, fit(plain.select("doc_id", "text"), labels, sample, bound), plain.columns)
    return out.where((F.col("_junk") <= 0.5) & (F.col("_abuse") <= 0.5)).select(*plain.columns).toDF(*docs.columns)
