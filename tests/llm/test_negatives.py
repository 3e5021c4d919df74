import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgauge.llm import negatives

ROWS = "vec_id bigint, embedding array<float>, label int"
LONG = 2**63 - 1


def slow(rows, every=10, positives=5, wanted=10, low=30, scale=100, high=90):
    """Every anchor against every row, in whole numbers."""
    used = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    anchors = {(i, label, tuple(v)) for i, label, v in used if i is not None and i % every == 0}
    out = []
    for anchor, own, a in anchors:
        scored = []
        for i, label, v in used:
            width = min(len(a), len(v))
            score = max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a[:width], v[:width]))))
            scored.append((-score, i is None, i or 0, i, label))
        scored.sort(key=lambda s: s[:3])
        near = [s for s in scored if s[4] == own and s[3] != anchor][:positives]
        for p in near:
            inside = [s for s in scored if s[4] != own and low * -p[0] <= scale * -s[0] <= high * -p[0]][:wanted]
            out += [(anchor, p[3], k, s[3], -p[0], -s[0]) for k, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=10, **more):
    table = spark.createDataFrame(rows, ROWS).repartition(6)
    found = negatives.mine(table, F.col("vec_id") % every == 0, **more)
    assert found.dtypes[2] == ("rank", "int")
    return sorted(map(tuple, found.collect()), key=str)


def some_rows(count, seed=1, width=4, labels=3):
    chance = np.random.default_rng(seed)
    vectors = chance.normal(0.3, 0.4, (count, width)).astype(np.float32)
    return [(int(k), [float(x) for x in v], int(chance.integers(0, labels))) for k, v in zip(chance.permutation(count), vectors)]


@pytest.mark.parametrize("more", [{}, {"block": 3}, {"positives": 1, "negatives": 2}, {"low": 50, "scale": 70, "high": 70}])
def test_equal_to_all_pairs(spark, more):
    rows = some_rows(300)
    plain = {"wanted" if k == "negatives" else k: v for k, v in more.items() if k != "block"}
    found = mined(spark, rows, **more)
    assert found and found == slow(rows, **plain)


def test_tiles_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SCORES", 64)
    rows = some_rows(200, 2)
    assert mined(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = some_rows(60, 3)
    rows += [
        (None, [0.5, 0.5, 0.5, 0.5], 1),
        (None, [0.5, 0.5, 0.5, 0.5], 0),
        (100, None, 1),
        (110, [0.1, None, 0.2, 0.3], 1),
        (120, [0.1, float("nan"), 0.2, 0.3], 1),
        (130, [0.1, float("inf"), 0.2, 0.3], 1),
        (140, [0.1, 0.2, 0.2, 0.3], None),
        (150, [], 1),
        (160, [0.4, 0.4], 2),
        (170, [0.4, 0.4, 0.1, 0.2, 9.0], 2),
        (180, [0.0] * 4, 0),
        (190, [-0.5] * 4, 0),
        (-200, [0.7] * 4, 0),
        (-200, [0.7] * 4, 0),
        (-200, [0.6] * 4, 1),
    ]
    found = mined(spark, rows)
    assert found == slow(rows)
    assert any(r[3] is None for r in found)


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, [1.0, 1.0], 0) for k in range(8)] + [(100 + k, [0.5, 0.5], 1) for k in range(0, 60, 3)]
    found = mined(spark, rows)
    assert found == slow(rows)
    ranked = sorted(found, key=lambda r: r[:3])
    assert [r[3] for r in ranked if r[:2] == (0, 1)] == [100 + 3 * k for k in range(10)]


def test_products_beyond_doubles_and_longs(spark):
    rows = some_rows(40, 5)
    rows += [(200 + k, [1e6 + k, 3e7, -2e5, 7.5], k % 2) for k in range(30)]
    rows += [(300 + k, [1e30, 2e29, 5.0, float(k)], k % 2) for k in range(6)]
    assert mined(spark, rows) == slow(rows)


def test_nothing_to_find(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_clashing_columns(spark):
    rows = some_rows(80, 6)
    table = spark.createDataFrame(rows, ROWS)
    for name in "anchor score slot place lower upper kept rank anchor_id _block".split():
        table = table.withColumn(name, F.lit("clash"))
    found = negatives.mine(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == slow(rows)


def test_one_label_holds_most_rows(spark):
    rows = [(k, v, 0 if k % 5 else 1) for k, v, _ in some_rows(250, 7)]
    assert mined(spark, rows, block=5) == slow(rows)
