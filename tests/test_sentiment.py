import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexgauge.operators import sentiment
from lexgauge.operators.content import split_of
from lexgauge.sources.tables import read_table

DOCS = "doc_id bigint, text string"


def test_weights_equal_plain_counting(spark):
    rows = [(k, ("good " if k % 3 else "bad ") * 3 + f"word{k % 5} THE the") for k in range(60)] + [(60, None), (61, "")]
    labels = [(k, int(k % 3 > 0)) for k in range(0, 62)] + [(5, 0), (900, 1), (None, 1), (7, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["word"]: r for r in sentiment.word_weights(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), prior=50).collect()}
    train = {r["doc_id"] for r in docs.where(split_of(F.col("doc_id")) == "train").collect()}
    counts = {0: Counter(), 1: Counter()}
    for k, text in rows:
        # Of two labels that differ, 1 wins.
        if k in train:
            counts[int(k % 3 > 0)].update((text or "").lower().split())
    total = {c: sum(counts[c].values()) for c in counts}
    assert set(found) == set(counts[0]) | set(counts[1])
    for word, row in found.items():
        n = {c: counts[c][word] for c in counts}
        a = 50 * (n[0] + n[1]) / (total[0] + total[1])
        odds = {c: math.log((n[c] + a) / (total[c] + 50 - n[c] - a)) for c in counts}
        assert (row["n_1"], row["n_0"]) == (n[1], n[0])
        assert row["weight"] == pytest.approx(odds[1] - odds[0], abs=2e-6)
        assert row["z"] == pytest.approx((odds[1] - odds[0]) / math.sqrt(1 / (n[1] + a) + 1 / (n[0] + a)), abs=1e-5)


def test_scores(spark):
    weights = spark.createDataFrame([("good", 1, 1, 1.5, 3.0), ("bad", 1, 1, -2.0, -4.0), ("weak", 1, 1, 9.0, 1.0)], "word string, n_1 bigint, n_0 bigint, weight double, z double")
    docs = spark.createDataFrame([(1, "Good good BAD weak"), (2, "weak"), (3, None), (None, "bad")], DOCS)
    found = sorted(((r["doc_id"] or 0, r["hits"], r["score"]) for r in sentiment.score(docs, weights).collect()))
    assert found == [(0, 1, -2.0), (1, 3, 1 / 3), (2, 0, 0.0), (3, 0, 0.0)]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    weights = sentiment.word_weights(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert weights.count() == 0
    assert [tuple(r) for r in sentiment.score(docs, weights).collect()] == [(1, 0, 0.0)]


def test_documents_that_were_held_out(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    labels = read_table(spark, "/root/testdata/sf0.1", "labels")
    weights = sentiment.word_weights(docs, labels)
    scored = sentiment.score(docs, weights).where(split_of(F.col("doc_id")) != "train").join(labels, "doc_id")
    means = {r["quality"]: r["m"] for r in scored.groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.1
