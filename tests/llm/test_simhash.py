import numpy as np
import pytest

from lexgauge.llm import simhash
from lexgauge.llm.components import connected_components
from lexgauge.llm.queries import op4_simhash
from tests.llm import plain


def named(prints, names, radius=4):
    tops = plain.groups(prints, radius)
    best = {}
    for top, name in zip(tops, names):
        if name is not None and (top not in best or name < best[top]):
            best[top] = name
    return [best.get(top) for top in tops]


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
def test_odd_documents(spark, change):
    rows = plain.odd_documents()
    prints = [plain.fingerprint(t) for _, t, *_ in rows]
    expected = sorted(
        ((r[0] is not None, r[0] or 0, f"{p:016x}", -1 if c is None else c) for r, p, c in zip(rows, prints, named(prints, [r[0] for r in rows])))
    )
    got = simhash.near_groups(change(plain.documents(spark))).collect()
    assert sorted((r[0] is not None, r[0] or 0, r[1], -1 if r[2] is None else r[2]) for r in got) == expected


def test_query_on_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain.fingerprint(d["text"]) for d in docs]
    expected = dict(zip([d["doc_id"] for d in docs], zip([f"{p:016x}" for p in prints], named(prints, [d["doc_id"] for d in docs]))))
    assert {r[0]: (r[1], r[2]) for r in op4_simhash(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("bands", [(1, 1), (2, 1), (3, 1), (5, 1), (6, 2), (7, 3)])
def test_every_forest_finds_every_link(spark, bands):
    chance = np.random.default_rng(3)
    centres = chance.integers(0, 1 << 63, 60, np.uint64)
    prints = {int(c) for c in centres}
    for centre in centres.tolist():
        for flips in (1, 3, 4, 5, 6):
            moved = centre
            for bit in chance.choice(64, flips, replace=False).tolist():
                moved ^= 1 << bit
            prints.add(moved)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = simhash.links(table, 4, *bands).collect()
    place = {s: i for i, s in enumerate(signed)}
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in found:
        a, b = sorted((top(place[u]), top(place[v])))
        parent[b] = a
    assert [top(i) for i in range(len(prints))] == plain.groups(prints)


def test_large_shards_are_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    prints = sorted({(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)})
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    found = simhash.links(table).collect()
    assert len({p for link in found for p in link}) == len(prints)
    # Stars, not pairs.
    assert len(found) < 60 * len(prints)
    roots = connected_components(simhash.links(table)).collect()
    assert {r["root"] for r in roots} == {prints[0]} and len(roots) == len(prints) - 1


def test_components(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (2000, 1000)]
    rows = connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(1, 301)} | {1001: 1000, 2000: 1000}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_representatives(spark):
    docs = plain.clashing(plain.documents(spark))
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    rows = [r for r in plain.odd_documents() if r[0] is not None]
    names = named([plain.fingerprint(r[1]) for r in rows], [r[0] for r in rows])
    assert ids == sorted({r[0] for r, n in zip(rows, names) if r[0] == n})
    # The row with neither doc_id nor text is a copy of others without words.
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == [plain.prose(4, 80)]


def test_representatives_of_repeated_and_missing_ids(spark):
    a, b, c, d = (plain.prose(seed, 90) for seed in (60, 61, 62, 63))
    rows = [
        (5, a), (5, b), (5, b),  # unlike texts under one id, one of them twice
        (6, c), (None, c), (None, c),  # copies without an id go
        (None, d), (None, d),  # one of them stays
        (7, a), (8, b),  # copies of texts whose first id is repeated
        (9, None), (9, ""), (None, " "),
    ]
    docs = plain.documents(spark, [(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)]).repartition(4)
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in simhash.keep_representatives(docs).collect()), key=str)
    empty = [k for k in kept if k[1] == 9]
    assert len(empty) == 1
    assert [k for k in kept if k[1] != 9] == sorted([(False, 5, a), (False, 5, b), (False, 6, c), (True, 0, d)], key=str)


def test_one_id_holds_a_third_of_all_rows(spark):
    rows = [(1 if k % 3 == 0 else k, plain.prose(k % 200, 60)) for k in range(600)]
    docs = plain.documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    kept = simhash.keep_representatives(docs).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t in rows})


def test_empty(spark):
    empty = plain.documents(spark, [])
    assert simhash.near_groups(empty).count() == 0
    assert simhash.keep_representatives(empty).count() == 0
