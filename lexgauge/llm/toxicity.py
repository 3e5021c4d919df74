"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word's character n-grams (three to five units, with word boundaries) and the
word itself share vectors in a table of hashed buckets.  A text is the average
of the vectors of all its n-grams, and a linear softmax over that average gives
the two classes.  Vectors and softmax are trained together in numpy, so a
misspelling, which keeps most n-grams of its word, keeps most of its meaning.

The fit uses a bounded sample (``sample`` labelled rows of either class, chosen
by hash); scores are given to all rows and whole texts.  As averaging and the
softmax are linear, a bucket's share in the score is one number, and scoring a
text is the mean of table look-ups.

Null and empty texts have no n-grams and get the score of an empty bag (the
bias).  Labels of one class only, or none, give a constant score of that class
(0 without labels).  Rows that repeat are scored each, a label row that repeats
counts as often as it stands; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.llm.common import held_out

BUCKETS = 1 << 16
LENGTHS = (3, 4, 5)
#: Labelled rows of either class that the fit may see.
SAMPLE = 1500
CHARACTERS = 1 << 20
_MULTIPLIER = np.uint64(0x100000001B3)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram and word of the texts, and the text each belongs to."""
    raw = [np.frombuffer((" " + t.lower() + " ").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    units = np.concatenate(raw) if raw else np.zeros(0, "<u2")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(r) for r in raw])
    space = (units == 32) | ((units >= 9) & (units <= 13))
    value = np.where(space, np.uint16(32), units).astype(np.uint64)
    out, owners = [], []
    # Hash of the n-gram that starts at each place, one unit longer with each step.
    hashed = np.full(len(units), 0xCBF29CE484222325, np.uint64)
    size = len(units)
    inner = np.concatenate(([0], np.cumsum(space)))
    for n in range(1, max(LENGTHS) + 1):
        size = len(units) - n + 1
        if size <= 0:
            break
        hashed = (hashed[:size] ^ value[n - 1 :]) * _MULTIPLIER
        if n not in LENGTHS:
            continue
        # White space may stand at the ends of an n-gram, not inside, and not at both ends of nothing.
        clean = inner[n - 1 : n - 1 + size] - inner[1 : 1 + size] == 0
        out.append(_bucket(hashed[clean], n))
        owners.append(owner[:size][clean])
    # Whole words: their mixed units, each times a power of its place, summed.
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    if len(starts):
        mixed = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        within = np.concatenate([[0], np.cumsum(~space)])[:-1]
        begin = np.repeat(within[starts], stops - starts)
        letters = np.flatnonzero(~space)
        power = _powers(int((stops - starts).max()))[within[letters] - begin]
        word = np.add.reduceat(mixed[letters] * power, np.cumsum(stops - starts) - (stops - starts))
        out.append(_bucket(word, 0))
        owners.append(owner[starts])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(owners)


def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.full(count, 0xD6E8FEB86659FD93, np.uint64))


def _bucket(hashed: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashed ^ np.uint64(kind * 0x632BE5AB)) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


@dataclass(frozen=True)
class Model:
    """Score of each bucket for class 1 against class 0, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        bucket, owner = buckets(texts)
        total = np.bincount(owner, self.weights[bucket], len(texts))
        count = np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -30, 30)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> Model:
    """Train embeddings and softmax together by gradient descent on single bags.

    ``bags`` are (buckets, counts) of a text each.  Classes weigh the same whatever
    their sizes.
    """
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        sure = 0.0 if not len(labels) or labels[0] == 0 else 1.0
        return Model(np.zeros(BUCKETS), 30.0 if sure else -30.0)
    chance = np.random.default_rng(seed)
    vectors = chance.uniform(-1 / dims, 1 / dims, (BUCKETS, dims))
    softmax = chance.normal(0, 0.1, (dims, 2))
    bias = np.zeros(2)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    squares = np.full(BUCKETS, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in chance.permutation(len(bags)):
            names, counts = bags[i]
            share = counts / max(counts.sum(), 1)
            mean = share @ vectors[names]
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = softmax @ p
            softmax -= step * 0.2 * np.outer(mean, p)
            bias -= step * 0.05 * p
            # Rare n-grams take larger steps than those that every text has.
            slope = share[:, None] * back
            squares[names] += (slope**2).sum(axis=1) / dims
            vectors[names] -= step * slope / np.sqrt(squares[names])[:, None] * 0.2
    direction = softmax[:, 1] - softmax[:, 0]
    return Model(vectors @ direction, float(bias[1] - bias[0]))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > CHARACTERS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def learn(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled training rows of either class.

    The rows are those with the smallest hashes of their doc_id, so the sample
    is the same on every run.  Their n-grams are counted in the tasks; the
    driver gets bucket numbers and counts, at most ``BUCKETS`` per row.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, text in enumerate(texts):
                bucket, _ = buckets([text])
                names, counts = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "toxic": batch.column("toxic").slice(i, 1),
                        "data": [np.concatenate((names, counts)).astype("<u4").tobytes()],
                    }
                )

    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(training)
    # Each class has its own top list, which keeps ``sample`` rows per task.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    taken = sorted((r["toxic"], bytes(r["data"])) for r in rows.select("text", "toxic").mapInArrow(run, "toxic int, data binary").collect())
    bags = [tuple(np.split(np.frombuffer(data, "<u4").astype(np.int64), 2)) for _, data in taken]
    return fit(bags, np.array([t for t, _ in taken], np.int64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = [model.scores(texts[a:b]) for a, b in _groups(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled training folds and score all rows: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
