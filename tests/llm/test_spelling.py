import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexgauge.llm import spelling
from tests.llm import plain


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def slow_words(rows, slip, shortest=7, least=2):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def slow_variants(words, factor=10):
    near = {w: sorted((o for o in words if distance_is_one(w, o)), key=lambda o: (-words[o], o)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= factor * words[w] else None for w, o in near.items()}

    def root(word):
        return word if form[word] is None else root(form[word])

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def sorted_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def some_words(seed, count, letters="abé"):
    """Words of few letters, so that many are near, with counts that tie and chain."""
    chance = np.random.default_rng(seed)
    words = {"".join(chance.choice(list(letters), chance.integers(7, 10))) for _ in range(count)}
    return {w: int(10 ** chance.integers(0, 5) * chance.integers(2, 4)) for w in sorted(words)}


@pytest.mark.parametrize("shard_letters", [None, 400, 20])
def test_equal_to_all_pairs(spark, monkeypatch, shard_letters):
    monkeypatch.setattr(spelling, "LEAF", 3)
    words = some_words(3, 700)
    # One count vector for many words: no tree can cut it.
    words |= {"xxxxyyz"[k:] + "xxxxyyz"[:k]: 5 for k in range(7)} | {"q" * 40: 2, "q" * 41: 30, "ÿ" * 7: 2, "ÿ" * 8: 20}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    assert sorted_rows(spelling.variants(table, shard_letters=shard_letters)) == slow_variants(words)


def test_pairs_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 7)
    words = some_words(4, 200)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert sorted_rows(spelling.variants(table)) == slow_variants(words)


def test_a_sample_that_misses_lengths(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SAMPLE", 8)
    words = some_words(5, 300)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert sorted_rows(spelling.variants(table, shard_letters=100)) == slow_variants(words)


def test_boxes_are_reached_exactly_when_a_step_leads_there():
    chance = np.random.default_rng(9)
    counts = chance.integers(0, 4, (400, 5)).astype(np.int32)
    for tight in (True, False):
        tree = spelling.Tree(counts, 6, tight)
        leaf = tree.place(counts)
        for up, down in ((1, 1), (1, 0)):
            met = {(q, int(d)) for node, rows in tree.reached(counts, up, down) for q in rows for d in np.flatnonzero(leaf == node)}
            step = counts[None] - counts[:, None]
            close = (np.maximum(step, 0).sum(axis=2) <= up) & (np.maximum(-step, 0).sum(axis=2) <= down)
            assert set(zip(*map(np.ndarray.tolist, np.nonzero(close)))) <= met
            assert len(met) < counts.shape[0] ** 2


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
@pytest.mark.parametrize("slip", [None, 2])
def test_odd_documents(spark, change, slip):
    text = "Lettered lettered LETTERED Ärmeltext ärmeltext ärmeltext übermäßig×x a-b cleared " * 3
    rows = plain.odd_documents() + [
        (30, text, "en", "a", 1),
        (None, text + "x" * 100_000, "en", "a", 1),
        (31, "x" * 100_000 + " unlettered", "en", "a", 1),
    ]
    expected = slow_words(rows, slip)
    found = spelling.vocabulary(change(plain.documents(spark, rows)), slip=slip)
    assert {r["word"]: r["n"] for r in found.collect()} == expected
    assert sorted_rows(spelling.variants(found)) == slow_variants(expected)


def test_empty(spark):
    empty = spelling.vocabulary(plain.documents(spark, []))
    assert spelling.variants(empty).count() == 0


def test_a_word_with_very_many_variants(spark):
    hub = "abcdefghij"
    words = {hub: 1000} | {hub[:k] + c + hub[k + 1 :]: 2 for k in range(10) for c in map(chr, range(0xC0, 0xFF))}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = {r["word"]: r for r in spelling.variants(table, shard_letters=200).collect()}
    assert rows[hub]["n_near"] == len(words) - 1
    assert {r["form"] for w, r in rows.items() if w != hub} == {hub}
