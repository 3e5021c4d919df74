import pytest
from pyspark.sql import functions as F

from lexgauge.llm import mixing
from tests.llm import plain


def test_weights_meet_all_three_targets(spark):
    rows = [
        (s, lang, topic, 100 * (1 + i) * (3 if s == "hot" else 1))
        for i, (s, lang, topic) in enumerate((s, x, t) for s in ("hot", "b", "c") for x in ("en", "fr") for t in ("p", "q"))
    ]
    counts = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    shares = [("source", "hot", 0.2), ("source", "b", 0.3), ("source", "*", 0.5), ("lang", "en", 0.6), ("lang", "fr", 0.4), ("topic", "p", 0.25), ("topic", "q", 0.75)]
    targets = spark.createDataFrame(shares, "dimension string, category string, share double")
    cells = mixing.raked(counts, targets, 60).collect()
    for dimension, category, share in shares:
        assert sum(r["weight"] for r in cells if r[f"k_{dimension}"] == category) == pytest.approx(share, abs=1e-6)
    assert max(r["p"] for r in cells) == pytest.approx(1)
    # Odds ratios inside the table are those of the counts.
    w = {(r["k_source"], r["k_lang"], r["k_topic"]): (r["weight"], r["tokens"]) for r in cells}
    for i in (0, 1):
        a, b, c, d = (w[k][i] for k in (("hot", "en", "p"), ("hot", "fr", "p"), ("b", "en", "p"), ("b", "fr", "p")))
        ratio = a * d / (b * c)
        if i:
            assert ratio == pytest.approx(before)
        before = ratio


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
def test_odd_documents(spark, change):
    docs = change(plain.documents(spark))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(plain.odd_documents())
    for r in rows:
        assert r["tokens"] == len(plain.words(r["row"]["text"]))
        assert 0 <= r["probability"] <= 1 + 1e-9
        assert not r["sampled"] or r["probability"] > 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns


def test_the_sample_follows_the_probabilities(spark):
    rows = [(i, "word " * 20, "en", "hot" if i % 4 else "b", 1) for i in range(4000)]
    targets = spark.createDataFrame(
        [("source", "hot", 0.5), ("source", "b", 0.5), ("lang", "en", 1.0), ("topic", "prose", 1.0)],
        "dimension string, category string, share double",
    )
    table = mixing.mix(plain.documents(spark, rows), targets, budget=None)
    kept = {r[0]: r[1] for r in table.where("sampled").groupBy("source").agg(F.count("*")).collect()}
    assert kept["b"] == 1000 and abs(kept["hot"] - 1000) < 100


def test_a_budget_takes_small_cells_whole(spark):
    rows = [("a", "en", "p", 900), ("b", "en", "p", 100)]
    counts = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    shares = [("source", "a", 0.5), ("source", "b", 0.5), ("lang", "en", 1.0), ("topic", "p", 1.0)]
    targets = spark.createDataFrame(shares, "dimension string, category string, share double")
    p = {r["k_source"]: r["p"] for r in mixing.raked(counts, targets, 3, 0.5).collect()}
    assert p == {"a": pytest.approx(250 / 900), "b": 1.0}


def test_empty(spark):
    assert mixing.mix(plain.documents(spark, [])).count() == 0


def test_every_category_has_its_own_target(spark):
    # 100 sources, the last 90 of them tied: more than any cap, in an order that names must not decide.
    sizes = {f"s{i:03d}": 20 - i if i < 10 else 10 for i in range(100)}
    rows = [(n, "word " * size, ("en", "fr")[n % 2], s, 1) for n, (s, size) in enumerate((s, z) for s, z in sizes.items() for _ in range(2))]
    docs = plain.documents(spark, rows)
    counts = docs.selectExpr("source", "lang", "'prose' AS topic", "cast(length(text) / 5 AS bigint) AS tokens")
    targets = {(r[0], r[1]): r[2] for r in mixing.tempered_targets(counts).collect()}
    whole = sum((2 * z) ** 0.7 for z in sizes.values())
    assert {c: share for (d, c), share in targets.items() if d == "source"} == pytest.approx({s: (2 * z) ** 0.7 / whole for s, z in sizes.items()})
    tokens = sum(2 * z for z in sizes.values())
    for r in mixing.mix(docs).collect():
        size = 2 * sizes[r["source"]]
        assert r["probability"] == pytest.approx(size**0.7 / whole * 0.5 * tokens / size)
