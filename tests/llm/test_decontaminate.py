import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgauge.llm import decontaminate
from lexgauge.llm.queries import op6_contaminated
from tests.llm import plain

ITEMS = "item_id bigint, text string"


def bench(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=70), st.lists(st.integers(0, 4), max_size=90))
@settings(max_examples=200, deadline=None)
def test_edit_distance(pattern, text):
    assert decontaminate.edits(pattern, text) == plain.edit_distance(pattern, text)


def changed(words, edits, chance):
    """The words after so many random edits."""
    words = list(words)
    for _ in range(edits):
        at = int(chance.integers(len(words)))
        kind = chance.integers(3)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "added")
    return words


def test_recall_against_brute_force(spark):
    chance = np.random.default_rng(4)
    items = [(i, plain.prose(i, int(n), 3000)) for i, n in enumerate(chance.integers(14, 60, 40))]
    rows, expected = [], set()
    for d in range(600):
        item, text = items[d % 40]
        words = text.split()
        within = changed(words, int(chance.integers(0, int(0.2 * len(words)) + 2)), chance)
        around = plain.prose(5000 + d, 80, 3000).split()
        whole = around[:40] + within + around[40:]
        rows.append((d, " ".join(whole), "en", "a", 1))
        for other, pattern in items:
            pattern = pattern.split()
            if plain.edit_distance(pattern, whole) <= int(0.2 * len(pattern)):
                expected.add((d, other))
    got = {(r[0], r[1]) for r in decontaminate.contaminated(plain.documents(spark, rows), bench(spark, items)).collect()}
    assert got <= expected
    assert len(got) >= 0.97 * len(expected)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in op6_contaminated(spark, sf_dir).collect()}
    coded = {d["doc_id"]: decontaminate.words_of(d["text"]) for d in docs}
    expected = set()
    for item in items:
        pattern = decontaminate.words_of(item["text"])
        for doc, words in coded.items():
            if decontaminate.edits(pattern, words) <= int(0.2 * len(pattern)):
                expected.add((doc, item["item_id"]))
    assert got == expected and expected


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
def test_odd_documents(spark, change):
    leak = plain.prose(5, 90)
    items = [(1, leak), (1, leak), (2, None), (3, ""), (4, "too short"), (None, plain.prose(4, 80)), (6, plain.prose(2, 30_000)[:300])]
    docs = change(plain.documents(spark))
    rows = decontaminate.contaminated(docs, bench(spark, items)).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found == {(10, 1), (None, None), (7, 6)}
    assert sum(r["doc_id"] == 10 for r in rows) == 4
    kept = decontaminate.keep_clean(docs, bench(spark, items))
    assert kept.columns == docs.columns
    assert kept.count() == len(plain.odd_documents()) - 4


def test_a_window_at_the_end_of_a_text(spark):
    text = plain.prose(77, 40)
    docs = plain.documents(spark, [(1, " ".join(text.split()[:-2]), "en", "a", 1), (2, " ".join(text.split()[2:]), "en", "a", 1)])
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench(spark, [(0, text)])).collect()} == {1, 2}


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 20)
    items = [(i, plain.prose(i, 30)) for i in range(12)]
    docs = plain.documents(spark, [(i, plain.prose(i, 30), "en", "a", 1) for i in range(15)])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench(spark, items)).collect()} >= {(i, i) for i in range(12)}
    assert decontaminate.keep_clean(docs, bench(spark, items)).count() == 3


def test_empty(spark):
    docs = plain.documents(spark, [])
    assert decontaminate.contaminated(docs, bench(spark, [(1, plain.prose(1, 20))])).count() == 0
    assert decontaminate.contaminated(plain.documents(spark), bench(spark, [])).count() == 0
    assert decontaminate.keep_clean(plain.documents(spark), bench(spark, [])).count() == len(plain.odd_documents())


def edited(words, count, kind, chance):
    """The words after so many edits of one kind at different places."""
    words = list(words)
    for at in sorted(chance.choice(len(words), count, False).tolist(), reverse=True):
        one = ("change", "drop", "add")[chance.integers(3)] if kind == "mixed" else kind
        if one == "change":
            words[at] = "changed"
        elif one == "drop":
            del words[at]
        else:
            words.insert(at, "added")
    return words


@pytest.mark.parametrize("kind", ["change", "mixed", "drop", "add"])
@pytest.mark.parametrize("size", [15, 27, 59, 100, 200, 300])
def test_recall_at_the_most_edits(size, kind):
    chance = np.random.default_rng(size)
    items = [(i, plain.prose(1000 * size + i, size, 3000).split()) for i in range(40)]
    texts = []
    for i, words in items:
        around = plain.prose(10**6 + i, 80, 3000).split()
        texts.append(around[:40] + edited(words, int(0.2 * size), kind, chance) + around[40:])
    found = decontaminate.Search(items).matches(texts)
    for text, item, away, start in found:
        pattern = items[item][1]
        assert away == plain.edit_distance(pattern, texts[text]) <= int(0.2 * size)
        assert away == plain.edit_distance(pattern, texts[text][start:])
    assert sum(text == item for text, item, _, _ in found) >= 0.95 * len(items)


def test_the_start_is_the_first_word_of_the_stretch():
    words = plain.prose(9, 60, 3000).split()
    around = plain.prose(8, 50, 3000).split()
    assert decontaminate.Search([(3, words)]).matches([around, around[:20] + words[2:] + around[20:]]) == [(1, 3, 2, 20)]


def test_stretches_with_too_few_words_are_not_counted_by_window(monkeypatch):
    """A count of the whole stretch comes first: the CPU seconds of op6_contaminated."""
    item = [f"w{i}" for i in range(20)]
    search = decontaminate.Search([(1, item)])
    text = ["x"] * 50 + item[:5] + ["x"] * 100 + item + ["x"] * 30
    # Every start as a candidate, so that stretches without the item are looked at, too.
    monkeypatch.setattr(search, "candidates", lambda tokens: np.array([[10, 0, 0], [155, 0, 0]]))
    summed = []
    plain_sum = np.cumsum
    monkeypatch.setattr(decontaminate.np, "cumsum", lambda *a, **k: summed.append(1) or plain_sum(*a, **k))
    assert search.matches([text]) == [(0, 1, 0, 155)]
    assert len(summed) == 2  # the edges of the texts, and the one stretch that can match


class Docs:
    """Stands for a table of one batch; what is asked of the tasks runs at once."""

    schema = "doc_id bigint, text string"

    def __init__(self, batch):
        self.batch = batch

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


@pytest.mark.parametrize("operator", [decontaminate.keep_clean, decontaminate.contaminated])
def test_a_batch_is_not_held_as_words(monkeypatch, operator):
    item = plain.prose(1, 30, 3000)
    texts = [plain.prose(10 + d, 2000, 3000) for d in range(20)] * 30 + [f"before {item} after", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    search = decontaminate.Search([(5, item.split())])
    monkeypatch.setattr(decontaminate, "searches", lambda benchmark, **choices: [search])
    tracemalloc.start()
    try:
        out = operator(Docs(batch), None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = [i for b in out for i in b.column("doc_id").to_pylist()]
    assert found == ([*range(600), 601] if operator is decontaminate.keep_clean else [600])
    # All words as Python strings would be about 70 MB.
    assert peak < 40e6
