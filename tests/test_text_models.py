import hashlib
import math
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lexgauge.operators import classification, vectors
from lexgauge.sources.tables import read_table

DOCS = "doc_id bigint, text string"
ODD = [
    (1, "the cat the dog"), (2, "The CAT\n\tthe bird"), (3, None), (4, ""), (5, " \n "), (6, "dog " * 5_000), (7, "Éa 漢字 😀 the"),
    (7, "Éa 漢字 😀 the"), (None, "cat bird"), (8, "unique"),
]


def slow_vectors(rows, dims):
    """Plain counting of hashed words."""
    counts = []
    for _, text in rows:
        words = [w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if w]
        counts.append(Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in words))
    held = Counter(b for c in counts for b in c)
    idf = {b: math.log((len(rows) + 1) / (n + 1)) for b, n in held.items()}
    return [(r[0], [(b, n, n * idf[b]) for b, n in sorted(c.items())]) for r, c in zip(rows, counts)]


@pytest.mark.parametrize("dims", [vectors.DIMS, 4])
def test_vectors_equal_plain_counting(spark, dims):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("terms", F.lit("clash")).withColumn("norm", F.lit("clash"))
    found = vectors.text_vectors(docs.repartition(3), dims).collect()
    expected = slow_vectors(ODD, dims)
    assert len(found) == len(expected)

    def shape(doc_id, terms):
        return (doc_id is None, doc_id or 0, [(b, n, round(w, 9)) for b, n, w in terms])

    assert sorted(shape(r["doc_id"], r["terms"]) for r in found) == sorted(shape(*e) for e in expected)
    for row in found:
        assert row["norm"] == pytest.approx(math.sqrt(sum(t["weight"] ** 2 for t in row["terms"])))


def test_weights_of_another_corpus(spark):
    fitted = vectors.fit_idf(vectors.term_frequencies(spark.createDataFrame(ODD, DOCS), 64))
    new = vectors.term_frequencies(spark.createDataFrame([(1, "the stranger"), (2, None)], DOCS), 64)
    rows = {r["doc_id"]: r for r in vectors.vectorize(new, fitted, 64).collect()}
    assert len(rows[1]["terms"]) == 2 and rows[2]["terms"] == [] and rows[2]["norm"] == 0


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], DOCS)
    assert vectors.text_vectors(empty, 16).count() == 0


@pytest.mark.parametrize("block", [8, 1])
def test_nearest_label_by_plain_angles(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "LABELS", block)
    rows = [(k, t) for k, t in enumerate(["red fox", "red hen red", "blue sky", "blue sea sky", "sea", "green", "", "red sky"])]
    labels = {0: "warm", 1: "warm", 2: "cold", 3: "cold", 4: "cold", 6: "warm"}
    table = spark.createDataFrame([(k, t, labels.get(k)) for k, t in rows], DOCS + ", label string")
    found = vectors.text_vectors(table, 1 << 12).join(table.select("doc_id", "label"), "doc_id")
    centroids = vectors.label_centroids(found, "label")
    best = {r["doc_id"]: r for r in vectors.nearest_label(found, centroids, 1 << 12).collect()}
    unit = {}
    for doc_id, terms in slow_vectors(rows, 1 << 12):
        norm = math.sqrt(sum(w * w for _, _, w in terms))
        unit[doc_id] = {b: w / norm for b, _, w in terms} if norm else {}
    means = {}
    for name in ("cold", "warm"):
        members = [unit[k] for k, v in labels.items() if v == name and unit[k]]
        total = Counter()
        for m in members:
            total.update(m)
        mean = {b: round(s / len(members), 9) for b, s in total.items()}
        length = math.sqrt(sum(x * x for x in mean.values()))
        means[name] = {b: x / length for b, x in mean.items()}
    for k, _ in rows:
        cosines = {n: round(sum(w * m[b] for b, w in unit[k].items() if b in m), 6) for n, m in means.items()}
        met = {n: c for n, c in cosines.items() if any(b in means[n] for b in unit[k])}
        if not met:
            assert best[k]["nearest"] is None
        else:
            assert best[k]["cosine"] == pytest.approx(max(met.values()), abs=2e-6)
            assert met[best[k]["nearest"]] == max(met.values())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_add_up_where_they_are(spark):
    """No lambda per label and term, and no sort by a lambda: the growth in seconds of doc_vector_nearest."""
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "blue sky", "b"), (3, "red sky", None)], DOCS + ", lang string")
    assert "array_sort" not in plan_of(vectors.term_frequencies(docs))
    found = vectors.labelled_vectors(docs, "lang")
    assert "Exchange" not in plan_of(found)
    plan = plan_of(vectors.nearest_label(found, vectors.label_centroids(found, "lang")))
    assert "lambda" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["nearest"] for r in vectors.nearest_label(found, vectors.label_centroids(found, "lang")).orderBy("doc_id").collect()][:2] == ["a", "b"]


def test_labels_of_repeated_ids_meet_as_in_a_join(spark):
    rows = [(1, "red fox", "a"), (1, "sea", "b"), (1, "sea", None), (2, "fox", None), (None, "fox", "a"), (None, "sky", "b"), (3, None, "b"), (4, "", "a")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    joined = vectors.text_vectors(docs).join(docs.select("doc_id", "lang"), "doc_id")

    def shape(df):
        return sorted((r["doc_id"], str(r["lang"]), round(r["norm"], 9), [(t["bucket"], t["n"]) for t in r["terms"]]) for r in df.collect())

    assert shape(vectors.labelled_vectors(docs, "lang")) == shape(joined)


def test_no_label_and_no_length(spark):
    docs = spark.createDataFrame([(1, "red fox", None), (2, None, None)], DOCS + ", lang string")
    found = vectors.labelled_vectors(docs, "lang")
    rows = vectors.nearest_label(found, vectors.label_centroids(found, "lang")).collect()
    assert sorted(map(tuple, rows)) == [(1, None, None), (2, None, None)]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    labels = read_table(spark, "/root/testdata/sf0.1", "labels")
    path = str(tmp_path_factory.mktemp("model") / "m")
    return docs, labels, classification.fit_and_write(docs, labels, path), path


def test_better_than_the_majority_on_what_was_held_out(fitted):
    docs, labels, model, _ = fitted
    measured = {r["held_out"]: r for r in classification.accuracy(classification.classify(docs, model), labels).collect()}
    unseen = measured[True]
    assert unseen["documents"] > 500
    assert unseen["accuracy"] > unseen["majority"]
    assert unseen["recall_1"] > 0.9 and unseen["recall_0"] > 0.3


def test_the_model_is_what_was_read_back(spark, fitted):
    docs, _, model, path = fitted
    again = PipelineModel.load(path)
    some = docs.where("doc_id < 300")
    assert classification.classify(some, again).orderBy("doc_id").collect() == classification.classify(some, model).orderBy("doc_id").collect()


def test_odd_texts_have_scores(spark, fitted):
    _, _, model, _ = fitted
    rows = classification.classify(spark.createDataFrame(ODD, DOCS).withColumn("features", F.lit(1)), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1


def test_the_held_out_fold_and_other_columns_do_not_matter(spark, fitted):
    docs, labels, model, _ = fitted
    few = docs.where("doc_id < 3000")
    lies = labels.withColumn(
        "quality", F.when(classification.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    other = few.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a, b = classification.fit(few, labels), classification.fit(other, lies)
    assert a.stages[-1].coefficients.toArray() == pytest.approx(b.stages[-1].coefficients.toArray())


def test_labels_that_disagree(spark):
    rows = [(1, 1), (1, 0), (2, 0), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)]
    found = classification.known_labels(spark.createDataFrame(rows, "doc_id bigint, quality int"), "quality")
    assert sorted(map(tuple, found.collect())) == [(1, 1.0), (2, 0.0)]
