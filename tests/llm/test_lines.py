import numpy as np
import pytest

from lexgauge.llm import lines
from tests.llm import plain


def rows_of(index):
    counts = {(r["shard"], bytes(r["key"])): r["n_docs"] for r in index.counts.collect()}
    held = {
        r["shard"]: (r["n_keys"], int((lines.CuckooFilter.load(bytes(r["data"])).slots > 0).sum()))
        for r in index.filters.collect()
        if r["n_keys"]
    }
    return counts, held


def dropped(index, docs):
    rows = lines.drop_frequent(index, docs).collect()
    return sorted(((r[0] is not None, r[0] or 0, r[1], r[2], r[3]) for r in rows))


def expected(rows, min_docs):
    return sorted((r[0] is not None, r[0] or 0, *e) for r, e in zip(rows, plain.drop_lines([r[1] for r in rows], min_docs)))


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
@pytest.mark.parametrize("limit", [lines.FILTER_BYTES, 0])
def test_odd_documents(spark, monkeypatch, change, limit):
    monkeypatch.setattr(lines, "FILTER_BYTES", limit)
    rows = plain.odd_documents() + [(100 + i, f"Copyright NOTICE \t\nown {i}\n copyright notice", "en", "z", 1) for i in range(4)]
    docs = change(plain.documents(spark, rows))
    assert dropped(lines.build(docs, min_docs=2, shards=4), docs) == expected(rows, 2)


def test_insert_and_delete_are_reversible(spark):
    first = [(i, f"common\nonly {i}\nsome {i % 5}", "en", "a", 1) for i in range(40)]
    second = [(100 + i, f"common\nnew\nsome {i % 5}", "en", "a", 1) for i in range(12)]
    one, two = plain.documents(spark, first), plain.documents(spark, second)
    start = lines.build(one, min_docs=10, shards=3)
    grown = lines.insert(start, two)
    assert rows_of(grown) == rows_of(lines.build(one.union(two), min_docs=10, shards=3))
    assert dropped(grown, one.union(two)) == expected(first + second, 10)
    assert rows_of(lines.delete(grown, two)) == rows_of(start)
    emptied = lines.delete(lines.delete(grown, two), one)
    assert rows_of(emptied) == ({}, {})


def test_a_full_filter_is_built_anew(spark):
    rows = [(i, "\n".join(f"line {k}" for k in range(300)), "en", "a", 1) for i in range(2)]
    docs = plain.documents(spark, rows)
    grown = lines.insert(lines.build(plain.documents(spark, []), min_docs=2, shards=2), docs)
    assert dropped(grown, docs) == expected(rows, 2)


def test_cuckoo_filter():
    chance = np.random.default_rng(1)
    hashes = chance.integers(0, 1 << 63, 20_000, np.uint64)
    cuckoo = lines.CuckooFilter.of(hashes)
    assert cuckoo.contains(hashes).all()
    others = chance.integers(1 << 63, (1 << 64) - 1, 100_000, np.uint64)
    assert cuckoo.contains(others).mean() < 0.001
    gone = hashes[:5000]
    assert all(cuckoo.delete(int(h)) for h in gone)
    assert cuckoo.contains(hashes[5000:]).all() and cuckoo.contains(gone).mean() < 0.01
    assert lines.CuckooFilter.load(cuckoo.dump()).contains(hashes[5000:]).all()


def test_empty(spark):
    empty = plain.documents(spark, [])
    assert lines.drop_frequent(lines.build(empty), empty).count() == 0
