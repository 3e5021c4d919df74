"""Language identification by rank-order n-gram profiles.

A profile lists a text's most frequent character n-grams (one to three letters,
lower case, words padded by a space) in order of frequency.  The out-of-place
distance of a document to a language adds, over the document's profile, how far
each n-gram stands from its place in the language's profile, or the largest
possible value where the language lacks it.  The nearest language is predicted.

Profiles are counted over all training documents; counts combine in the tasks
before the shuffle.  All n-grams of a batch are handled as numbers: three
16-bit units and a document number make one 64-bit key, and one sort of the
keys counts them all.

A null text, or one without a letter, is ``und`` with score 0.  Rows with null
language are not learned from, texts in languages that were never learned get the nearest
known one; without any training row everything is ``und``.  Ties between
n-grams fall to the smaller code, between languages to the first in order.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.llm.common import held_out

#: N-grams of a profile.
PROFILE = 300
UNKNOWN = "und"
#: Characters of a piece of work inside a batch.
CHARACTERS = 1 << 21
DOCUMENT_BITS = 16


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every 16-bit unit: is it a letter (halves of characters beyond 16 bits are none by themselves)."""
    return np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def _with_pairs(units: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """``letter`` with both halves of every letter beyond 16 bits."""
    first = np.flatnonzero((units[:-1] & 0xFC00 == 0xD800) & (units[1:] & 0xFC00 == 0xDC00))
    if len(first):
        points = 0x10000 + ((units[first].astype(np.int64) & 0x3FF) << 10) + (units[first + 1].astype(np.int64) & 0x3FF)
        kinds, place = np.unique(points, return_inverse=True)
        real = np.array([chr(c).isalpha() for c in kinds.tolist()])[place.reshape(-1)]
        letter[first], letter[first + 1] = real, real
    return letter


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with one zero between words and around texts, and each unit's text."""
    raw = [np.frombuffer((t.lower() + " ").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    units = np.concatenate([np.zeros(1, "<u2"), *raw])
    owner = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
    owner = np.concatenate(([0], owner))
    letter = _with_pairs(units, _letters()[units])
    # The last unit of each text is a space, so words of two texts never meet.
    keep = letter | np.concatenate(([True], letter[:-1]))
    return np.where(letter, units, 0)[keep].astype(np.uint64), owner[keep]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram code and count of every n-gram of every text, sorted by owner and code.

    Texts are at most 2**16.  A code holds up to three units in its upper 48 bits.
    """
    units, owner = _units(texts)
    document = owner.astype(np.uint64)
    one, two, three = units, units[1:], units[2:]
    keys = []
    mine = one != 0
    keys.append((document[mine] << np.uint64(48)) | (one[mine] << np.uint64(32)))
    # A pair or triple starts at a space or a letter and holds at least one letter, and stays within a text.
    same = owner[1:] == owner[:-1]
    if len(units) > 1:
        pair = (one[:-1] | two) != 0
        start = owner[1:]
        chosen = pair & (same | (one[:-1] == 0))
        keys.append(
            (start[chosen].astype(np.uint64) << np.uint64(48)) | (one[:-1][chosen] << np.uint64(32)) | (two[chosen] << np.uint64(16)) | np.uint64(1)
        )
    if len(units) > 2:
        middle = two[:-1] != 0
        start = owner[1:-1]
        keys.append(
            (start[middle].astype(np.uint64) << np.uint64(48))
            | (one[:-2][middle] << np.uint64(32))
            | (two[:-1][middle] << np.uint64(16))
            | three[middle]
        )
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with a bounded number of characters; a longer text comes alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (size + len(text) > CHARACTERS or i - begin == 1 << DOCUMENT_BITS):
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def learn(docs: DataFrame, training: Column) -> dict[str, np.ndarray]:
    """Profiles by language from the rows where ``training`` is true: codes in order of rank.

    The result has ``PROFILE`` numbers per language; nothing else reaches the driver.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in stream:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _groups(texts):
                owner, codes, counts = gram_counts(texts[a:b])
                for lang in set(langs[a:b]):
                    mine = (langs[a:b] == lang)[owner]
                    old = totals.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    names, place = np.unique(np.concatenate((old[0], codes[mine])), return_inverse=True)
                    totals[lang] = names, np.bincount(place, np.concatenate((old[1], counts[mine])), len(names)).astype(np.int64)
        for lang, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"]
            )

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = rows.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # The rank limit runs in every task before rows meet by language.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counted.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "place", "code").collect()
    found: dict[str, dict[int, int]] = {}
    for r in top:
        found.setdefault(r["lang"], {})[r["place"]] = r["code"]
    return {lang: np.array([codes[p] for p in sorted(codes)], np.uint64) for lang, codes in sorted(found.items())}


def distances(texts: list[str], profiles: dict[str, np.ndarray]) -> np.ndarray:
    """Out-of-place distance per n-gram of each text (rows) to each language; inf for texts without letters."""
    owner, codes, counts = gram_counts(texts)
    order = np.lexsort((codes, -counts, owner))
    owner, codes = owner[order], codes[order]
    begin = np.searchsorted(owner, np.arange(len(texts)))
    rank = np.arange(len(owner)) - begin[owner]
    top = rank < PROFILE
    owner, codes, rank = owner[top], codes[top], rank[top]
    held = np.bincount(owner, minlength=len(texts))
    out = np.full((len(texts), len(profiles)), np.inf)
    for column, profile in enumerate(profiles.values()):
        by_code = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[by_code], codes), len(profile) - 1)
        there = profile[by_code][at] == codes
        moved = np.where(there, np.abs(by_code[at] - rank), PROFILE)
        summed = np.bincount(owner, moved, len(texts))
        out[held > 0, column] = summed[held > 0] / held[held > 0]
    return out


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    The score is one less the nearest distance over the farthest possible one.
    """
    names = np.array([*profiles, UNKNOWN], object)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores = [], []
            for a, b in _groups(texts):
                away = distances(texts[a:b], profiles)
                if not profiles:
                    away = np.full((b - a, 1), np.inf)
                best = away.argmin(axis=1)
                least = away.min(axis=1)
                known = np.isfinite(least)
                langs += names[np.where(known, best, len(names) - 1)].tolist()
                scores += np.where(known, 1 - np.where(known, least, 0) / PROFILE, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the training folds of ``docs`` and predict all rows: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs, ~held_out(F.col("doc_id")))
    return predict(docs, profiles).withColumn("held_out", held_out(F.col("doc_id")))
