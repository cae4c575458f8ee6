"""Quality classifier by supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the mean of the learned vectors of its features: its words, hashed, and the character n-grams of each word
with its borders, hashed. A word that repeats the one before it is a word 2-gram of its own kind, a back-reference: all of
them share one vector, which counts as often as a usual word has features. A softmax over two classes reads the mean. Both the vectors and the softmax are learned from
labelled documents, one document at a time in a seeded order with a falling rate.

As the softmax is linear in the mean, each bucket's vector counts only by its share of the log-odds; so the fitted model
is scored as one number for each bucket, and a word's sum over its features is the same in every text. Workers keep the
sums of words they met in a bounded memo. Texts are scored whole.

The sample for fitting is bounded: `max_docs` labelled documents, those whose seeded hash of the id is smallest, which is a
uniform sample that does not depend on partitions. It is the only bound; scoring covers every row. Texts are counted on the
executors, and an example has at most BUCKETS + 1 features, so the driver's memory is bounded too.

Defined cases: a null or empty text has no features, and its score is the softmax of the bias alone. Documents without a
label are scored like all others. Several labels of one document are several examples, and so are several texts of one id;
repeated rows are one. Without any labelled row, or with
one class only, every score is the share of label 1 among the examples (0.5 if there are none). Equal texts have equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import slices

BUCKETS = 1 << 18
MAX_DOCS = 1500
#: Words whose sums are kept; with what a batch's new words need on top, some 40 MB.
MEMO = 100_000
#: Features that an immediate repetition of a word counts for.
REPEAT = 24


def features(words: list[bytes], buckets: int = BUCKETS, low: int = 2, high: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features, number of them for each word): first the n-grams of code points of each word between its
    borders, by length, and then the word itself. Words are UTF-8 without white space, of any length."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    points = np.frombuffer(b"".join(b" %b\n" % w for w in words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = (np.cumsum(points == 32) - 1).astype(np.int32)
    sizes = np.bincount(owner, minlength=len(words))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    grams, owners, value = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, high + 1):
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n >= low:
            inside = np.flatnonzero(left[: len(value)] >= n)
            mixed = value[inside] * np.uint64(0x9E3779B97F4A7C15)
            grams.append(((mixed ^ (mixed >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32))
            owners.append(owner[inside])
    grams.append(np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words)))
    owners.append(np.arange(len(words), dtype=np.int32))
    owner = np.concatenate(owners)
    return np.concatenate(grams)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def repeats(words: list[bytes]) -> int:
    """Weight of the back-reference feature, which lies in the bucket after all others."""
    return REPEAT * sum(map(eq, words, words[1:]))


@dataclass
class Model:
    """weights: each bucket's share of the log-odds of class 1; bias: those of an empty text; repeat: a back-reference's share."""

    weights: np.ndarray
    bias: float
    buckets: int = BUCKETS
    repeat: float = 0.0
    memo: dict | None = None

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """Probability of class 1 of each text."""
        memo, split = self.memo if self.memo is not None else {}, [t.split() if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in memo})
        if len(memo) + len(new) > MEMO and len(new) <= MEMO:
            memo, new = {}, list({w for words in split for w in words})
        own = memo if len(memo) + len(new) <= MEMO else dict(memo)
        # New words by the hundred thousand bytes, so that the arrays of their n-grams stay small.
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) <= 1 << 18):
                size += len(new[end])
                end += 1
            found, counts = features(new[at:end], self.buckets)
            sums = np.add.reduceat(self.weights[found].astype(np.float64), np.concatenate(([0], np.cumsum(counts)[:-1])))
            own.update(zip(new[at:end], zip(sums.tolist(), counts.tolist(), strict=True), strict=True))
            at = end
        self.memo = memo
        out = []
        for words in split:
            n = repeats(words)
            total = n * self.repeat
            for s, k in map(own.__getitem__, words):
                total += s
                n += k
            out.append(float(1 / (1 + np.exp(-np.clip(self.bias + (total / n if n else 0.0), -40, 40)))))
        return out


def counted(text: bytes | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, times), ascending, of a whole text; at most buckets + 1 of them, however long it is."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    found, counts = features(list(times), buckets)
    n = np.bincount(found, np.repeat(np.fromiter(times.values(), np.float64, len(times)), counts), minlength=buckets + 1)
    n[buckets] = repeats(words)
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at].astype(np.int64)


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """A model from labelled texts as counted() gives them. Each step moves the softmax and the vectors of the document's features."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), buckets)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim)).astype(np.float32)
    softmax, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    docs = [(at, (n / max(1, n.sum())).astype(np.float32)) for at, n in examples]
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, share = docs[i]
            mean = share @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            z = softmax @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            pace = rate * (1 - done / steps)
            done += 1
            if len(at):
                vectors[at] -= pace * len(at) ** 0.5 * share[:, None] * (softmax.T @ p)[None, :]
            softmax -= pace * np.outer(p, mean)
            bias -= pace * p
    lean = softmax[1] - softmax[0]
    weights = (vectors @ lean).astype(np.float32)
    return Model(weights[:buckets], float(bias[1] - bias[0]), buckets, float(weights[buckets]))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = MAX_DOCS, seed: int = 11, where=None) -> DataFrame:
    """(at, label, found, times): at most max_docs examples for fitting, their whole texts counted where they lie.

    Ids are chosen by a seeded hash, so that only ids are sorted; their texts follow by join, and equal rows count once.
    Where an id has several texts, the bound holds for the examples too. No text leaves its executor.
    """
    own = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    own = (own.where(where(F.col("key"))) if where else own).distinct()
    chosen = own.orderBy(F.xxhash64(F.lit(seed), "key", "label"), "key", "label").limit(max_docs)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    # The chosen side has max_docs rows of two numbers, a bound that does not grow.
    rows = texts.join(F.broadcast(chosen), "key").select(F.xxhash64(F.lit(seed), "key", "label", "text").alias("at"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 100):
                told = [counted(t) for t in part.column(2).to_pylist()]
                columns = [pa.array([x[i].astype("<i4").tobytes() for x in told], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["at", "label", "found", "times"])

    counts = rows.mapInArrow(run, "at long, label int, found binary, times binary")
    return counts.dropDuplicates(["at", "label"]).orderBy("at", "label").limit(max_docs)


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    rows = training_rows(docs, labels, **options).collect()
    return fit([(np.frombuffer(r["found"], "<i4"), np.frombuffer(r["times"], "<i4").astype(np.int64)) for r in rows], [r["label"] for r in rows])


def score_documents(docs: DataFrame, model: Model, text: str = "text", name: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all if None) and the column `name`: the score of each row's whole text.

    The model's weights, which the workers get by broadcast, are of fixed size.
    """
    carry = docs.columns if carry is None else carry
    if name.lower() in {c.lower() for c in carry}:
        raise ValueError(f"docs already have a column {name}")
    place, kept = docs.columns.index(text), [docs.columns.index(c) for c in carry]
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias, buckets, repeat = model.bias, model.buckets, model.repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights.value, bias, buckets, repeat)
        for batch in batches:
            for part in slices(batch, place):
                scores = own.scores(part.column(place).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(scores, pa.float64())], [*(f"c{i}" for i in kept), "score"])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = plain.select(*(f"c{i}" for i in kept), F.lit(0.0).alias("score")).schema
    return plain.mapInArrow(run, schema).toDF(*carry, name)


def held_out(key) -> object:
    """Whether crc32 of the id as text leaves 0 when divided by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))
