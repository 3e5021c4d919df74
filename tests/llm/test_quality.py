import math
import re
import unicodedata

import pytest

from lexgauge.llm import quality
from tests.llm import plain


def scored(docs, **kw):
    return quality.quality(docs, **kw).selectExpr("row.doc_id AS doc_id", "row.text AS text", "* EXCEPT (row)").collect()


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
def test_counts_on_odd_documents(spark, change):
    rows = scored(change(plain.documents(spark)))
    assert len(rows) == len(plain.odd_documents())
    for r in rows:
        text = r["text"] or ""
        found = plain.words(text)
        lines = [line for line in text.split("\n") if plain.words(line)]
        assert r["n_words"] == len(found)
        assert r["word_chars"] == sum(map(len, found))
        assert r["n_symbols"] == len(re.findall("[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == plain.repeat_words(text)
        assert r["base_failed"] == (len(found) < 20 or 100 * plain.repeat_words(text) > 30 * len(found))
        assert not (r["kept"] and r["base_failed"])
        assert (r["class_distance"] is None) == (len(found) < 50)


def test_far_documents_go_and_usual_ones_stay(spark):
    rows = [(i, plain.prose(100 + i, 200, 5000), "en", "a", 1) for i in range(40)]
    rows += [(90, plain.prose(7, 200, 5000).upper(), "en", "a", 1), (91, " ".join(["#$%&"] * 5 + [f"{i}**" for i in range(150)]), "en", "a", 1)]
    kept = {r["doc_id"] for r in scored(plain.documents(spark, rows)) if r["kept"]}
    assert kept == set(range(40))


def test_columns_pass_through(spark):
    docs = plain.clashing(plain.documents(spark))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() > 0


def test_empty(spark):
    assert scored(plain.documents(spark, [])) == []


def test_classes_are_taken_out_one_after_the_other(spark):
    """Every pass but the first sees what the ones before left: the CPU seconds of op8_quality."""
    texts = ["Ab1 $\t\n#é漢Ω😀𝒜𝒶\u00a0|", "", None, " \n ", "ABC", "a b  c", "x" * 3000, "İI Σας"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    counted = quality.statistics(docs)
    for row in counted.collect():
        t = row["row"]["text"] or ""
        kinds = [unicodedata.category(c) for c in t]
        lower, upper = kinds.count("Ll"), kinds.count("Lu")
        digit, space = sum(c in "0123456789" for c in t), sum(c in " \t\n\x0b\f\r" for c in t)
        assert (row["c_lower"], row["c_upper"], row["c_digit"], row["c_space"]) == (lower, upper, digit, space)
        assert (row["c_all"], row["c_rest"]) == (len(t), len(t) - lower - upper - digit - space)
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "array_remove" not in plan


def test_shares_of_common_words_by_plain_counting(spark):
    texts = ["The cat THE dog " * 15, "the ÉTÉ été cat longest " * 12 + "İx", "dog " * 60]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    reference = quality.references(docs).first()
    for row in quality.quality(docs).collect():
        words = row["row"]["text"].lower().split()
        p = [words.count(w) / len(words) for w in reference["ref_words"]]
        q = list(reference["ref_shares"])
        p, q = [*p, max(1 - sum(p), 0.0)], [*q, max(1 - sum(q), 0.0)]
        js = sum(x * math.log2(x / ((a + b) / 2)) for a, b in zip(p, q) for x in (a, b) if x > 0) / 2
        assert row["word_distance"] == pytest.approx(math.sqrt(max(js, 0)), abs=2e-6)


def test_common_words_are_not_looked_up_one_by_one(spark, monkeypatch):
    """No search through the common words for every word, no hashes of eight without equal fours: CPU seconds of op8_quality."""
    texts = ["the THE of\tof\nthe É É " * 12, "of \x0bthe\x0c é the\r" * 20 + "longer-word " * 3, plain.prose(3, 80, 300), "a b c d e f g h " * 2, "", None]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id int, text string, lang string")
    scores = quality.quality(docs)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and "zip_with" not in plan
    found = {r["row"]["doc_id"]: r for r in scores.collect()}
    for k, t in enumerate(texts):
        assert found[k]["n_repeat_words"] == plain.repeat_words(t or "")
    # The condition on the words of all languages saves time only.
    monkeypatch.setattr(quality, "_all_common", lambda reference: None)
    assert {r["row"]["doc_id"]: r for r in quality.quality(docs).collect()} == found
