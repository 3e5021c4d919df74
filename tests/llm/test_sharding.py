import hashlib
from collections import Counter

import pytest

from lexgauge.llm.sharding import interleave
from tests.llm import plain


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
@pytest.mark.parametrize("shards", [1, 4, 40])
def test_odd_documents(spark, change, shards):
    rows = interleave(change(plain.documents(spark)), shards).collect()
    expected = plain.odd_documents()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(key((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == sorted(
        key((d, len((t or "").encode()) + 1, plain.crc(t))) for d, t, *_ in expected
    )
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards))
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    for shard, size in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(size))


def test_every_shard_has_the_mixture(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(3000)]
    table = interleave(plain.documents(spark, rows), 8).collect()
    whole = Counter(r["source"] for r in table)
    for shard in range(8):
        own = Counter(r["source"] for r in table if r["shard"] == shard)
        assert all(abs(own[s] - n / 8) <= 2 for s, n in whole.items())
    # The order inside a source is shuffled.
    hot = [r["doc_id"] for r in sorted(table, key=lambda r: r["position"]) if r["source"] == "hot"]
    assert hot != sorted(hot)
    # The order does not depend on the layout of the input.
    again = interleave(plain.documents(spark, rows[::-1]).repartition(5), 8)
    assert {(r["doc_id"], r["position"]) for r in again.collect()} == {(r["doc_id"], r["position"]) for r in table}


def test_empty(spark):
    assert interleave(plain.documents(spark, [])).count() == 0


def slow_sequence(rows, seed):
    """All rows in the order of the sequence, by plain sorting."""
    keyed = []
    for doc_id, text, _, source, *_ in rows:
        crc = plain.crc(text)
        chance = int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{crc}".encode()).hexdigest()[:13], 16) / 16**13
        keyed.append((source or "", (chance, doc_id is not None, doc_id or 0, crc)))
    sizes, seen, placed = Counter(s for s, _ in keyed), Counter(), []
    for source, tie in sorted(keyed):
        placed.append(((seen[source] + 0.5) / sizes[source], tie, source))
        seen[source] += 1
    return [(tie[2] if tie[1] else None, tie[3]) for _, tie, source in sorted(placed)]


@pytest.mark.parametrize("shards", [3, 8])
def test_equal_to_plain_sorting(spark, shards):
    rows = [(i, f"t{i % 50}", "en", None if i % 7 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(500)]
    rows += [(None, f"n{i}", "en", "s1", 1) for i in range(20)] + [(3, "other", "en", "hot", 1), (900, None, "en", "s2", 1)]
    found = sorted(interleave(plain.documents(spark, rows), shards, seed=5).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [(r["doc_id"], r["text_crc32"]) for r in found] == slow_sequence(rows, 5)
    assert [r["position"] for r in found] == list(range(len(rows)))
