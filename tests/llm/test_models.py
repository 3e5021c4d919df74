import numpy as np
import pytest

from lexgauge.llm import langid, toxicity
from lexgauge.llm.queries import op5_language, op10_toxicity
from tests.llm import plain


def test_gram_counts_match_a_plain_count():
    from collections import Counter

    texts = ["Ab ab!c", "", "é 1x", "aßb" * 3]
    owner, codes, counts = langid.gram_counts(texts)
    for i, text in enumerate(texts):
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower())
        units = [0 if c == " " else ord(c) for c in " ".join(padded.split(" ")) + " "]
        units = [u for j, u in enumerate(units) if u or j == 0 or units[j - 1]]
        expected = Counter()
        for j, u in enumerate(units):
            if u:
                expected[u << 32] += 1
                if 0 < j < len(units) - 1:
                    expected[units[j - 1] << 32 | u << 16 | units[j + 1]] += 1
            if j + 1 < len(units) and (u or units[j + 1]):
                expected[u << 32 | units[j + 1] << 16 | 1] += 1
        got = {int(c): int(n) for o, c, n in zip(owner, codes, counts) if o == i}
        assert got == dict(expected)


def test_letters_beyond_16_bits():
    units, owner = langid._units(["a😀b", "\U00010428", "😀"])
    letters = "\U00010428".encode("utf-16-le")
    pair = [letters[0] | letters[1] << 8, letters[2] | letters[3] << 8]
    assert units.tolist() == [0, ord("a"), 0, ord("b"), 0, *pair, 0]
    assert owner.tolist() == [0, 0, 0, 0, 0, 1, 1, 1]


def test_out_of_place_distance():
    texts = ["aaab aab", "ba"]
    owner, codes, counts = langid.gram_counts(texts)
    ranked = [[int(c) for _, c in sorted(zip(-counts[owner == i], codes[owner == i]))] for i in (0, 1)]
    profile = np.array(ranked[1], np.uint64)
    places = {c: i for i, c in enumerate(ranked[1])}
    expected = [np.mean([abs(places[c] - i) if c in places else langid.PROFILE for i, c in enumerate(r)]) for r in ranked]
    assert langid.distances(texts, {"x": profile})[:, 0].tolist() == pytest.approx(expected)


def test_language_of_odd_documents(spark):
    rows = plain.odd_documents() + [(200 + i, f"the of and is {plain.prose(i, 30)}", "en", "a", 1) for i in range(20)]
    rows += [(300, "😀😀 👍 12 !", "en", "a", 1), (301, "\U00010400\U00010401", "en", "a", 1), (302, "\u4e2d\u6587", "en", "a", 1)]
    docs = plain.clashing(plain.documents(spark, rows))
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in got if (r["doc_id"] or 0) >= 300} == {300: True, 301: False, 302: False}
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == by_id[5]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and plain.crc(str(r["doc_id"])) % 5 == 0) for r in got)
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}
    assert langid.identify(plain.documents(spark, [])).count() == 0


def test_language_accuracy(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = [r for r in op5_language(spark, path).collect() if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_buckets_do_not_cross_words_or_texts():
    one, owner = toxicity.buckets(["abc de", "", "de"])
    alone = toxicity.buckets(["de"])[0]
    assert sorted(one[owner == 2]) == sorted(alone)
    assert set(alone) <= set(one[owner == 0])
    assert (owner != 1).all()


def test_misspellings_share_vectors():
    chance = np.random.default_rng(0)
    texts = [plain.prose(i, 40) + (" you horrible creature" if i % 2 else "") for i in range(200)]
    labels = np.array([i % 2 for i in range(200)])
    bags = [np.unique(toxicity.buckets([t])[0], return_counts=True) for t in texts]
    model = toxicity.fit(bags, labels)
    scores = model.scores([plain.prose(900, 40) + " you horribble creature", plain.prose(901, 40), ""])
    assert scores[0] > 0.5 > scores[1] and 0 <= scores[2] <= 1
    assert chance is not None


def test_toxicity_of_odd_documents(spark):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (7, None, 1), (None, 0, 1), (99, 0, 0), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    docs = plain.clashing(plain.documents(spark))
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(plain.odd_documents())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    none = toxicity.toxicity(docs, labels.where("1 = 0")).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.toxicity(plain.documents(spark, []), labels).count() == 0


def test_toxicity_accuracy(spark):
    path = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [r for r in op10_toxicity(spark, path).collect() if r["held_out"] and r["doc_id"] in toxic]
    truth = np.array([toxic[r["doc_id"]] for r in held])
    predicted = np.array([r["predicted"] for r in held])
    # The labels themselves are wrong for a few rows in a hundred.
    assert predicted[truth == 1].mean() > 0.75 and predicted[truth == 0].mean() < 0.05
