"""Rows that are easy to lose: no key, no manifest, no limit, new titles, huge numbers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexgauge.functions.ordering import with_ranks, with_row_number_per
from lexgauge.operators import content, ledger, privacy, snapshots
from lexgauge.plans import reports
from lexgauge.session import materialize


def test_rows_without_a_key_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 2), (None, 3)], "k string, t int")
    rows = {(r.k, r.t): r.row_number for r in with_row_number_per(df, "k", ["t"]).collect()}
    assert rows == {("a", 1): 1, ("a", 2): 2, (None, 1): 1, (None, 3): 2}


def test_ranks_tell_huge_numbers_apart(spark):
    df = materialize(spark.createDataFrame([(2**53,), (2**53 + 1,), (None,), (2**53,)], "n bigint"))
    assert sorted((r.n or 0, r.place) for r in with_ranks(df, {"place": F.col("n")}).collect()) == [
        (0, 4), (2**53, 1), (2**53, 1), (2**53 + 1, 3),
    ]


def test_agencies_without_manifest_have_the_defaults(spark):
    df = spark.createDataFrame(
        [("a", datetime(2020, 1, 1)), ("b", datetime(2020, 1, 1)), ("c", datetime(2010, 1, 1)), ("d", None)],
        "agency_id string, t timestamp_ntz",
    )
    manifests = spark.createDataFrame(
        [("a", "TS", 0), ("d", None, None)], "agency_id string, data_classification string, retention_days int"
    )
    scope = privacy.in_clearance(df, manifests, ["U"])
    assert sorted(r.agency_id for r in scope.collect()) == ["b", "c", "d"]
    kept = privacy.within_retention(df, manifests, "t", ledger.at(datetime(2024, 1, 1)))
    assert {r.agency_id: r.retention_days for r in kept.collect()} == {"a": 0, "b": 2555, "d": 2555}


def test_a_new_title_stays_in_the_impact_score(spark):
    columns = "ecfr_id bigint, title int, checksum string"
    old = spark.createDataFrame([(1, 1, "a")], columns)
    new = spark.createDataFrame([(1, 1, "a"), (2, 7, "b")], columns)
    rows = {r.title: r for r in snapshots.impact_score(old, new).collect()}
    assert rows[1].impact_score == 0 and rows[7].impact_score is None and rows[7].new_count == 1


def test_lists_without_a_limit_keep_order_and_offset(spark):
    row = ("r", 1, "a", None, None, None)
    df = spark.createDataFrame(
        [(i, *row, 2000 + i) for i in range(5)],
        "ecfr_id bigint, cfr_reference string, title int, corrective_action string, error_occurred date, "
        "error_corrected date, lag_days int, year int",
    )
    assert [r.ecfr_id for r in reports.corrections_list(df, limit=None, offset=3).collect()] == [1, 0]
    assert reports.recent_corrections(df, limit=2).count() == 2


def test_top_lists_end_at_the_cap(spark, sf_dir, monkeypatch):
    many = spark.range(90).selectExpr(
        "concat('a', id) AS slug", "'n' AS name", "'s' AS short_name", "id + 1 AS total_corrections", "id / 3 AS rvi",
        "id AS cfr_reference_count",
    )
    monkeypatch.setattr(reports.marts, "serving_metrics", lambda domain: many)
    assert [reports.top_by_corrections(None, n).count() for n in (20, 50, 75)] == [20, 50, 50]
    assert reports.top_by_rvi(None, limit=75).count() == 50
    assert reports.top_by_rvi(None, limit=75, cap=None).count() == 75


def test_searches_may_have_no_limit(spark):
    df = spark.range(150).selectExpr(
        "'t' AS agency_id", "id AS event_id", "'n' AS event_name", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS timestamp"
    )
    assert ledger.search_events(df, "t", limit=None).count() == 150
    assert ledger.search_events(df, "t").count() == ledger.SEARCH_CAP


def test_content_of_odd_documents(spark):
    rows = [(1, None, None, None, 3), (2, " ", "en", "s", 1), (3, "Mail a.b@c.org or 555-123-4567, 123-45-6789!", "xx", "s", 44)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    broken = sorted((r.doc_id, r.violation) for r in content.validate_documents(docs).collect())
    assert broken == [(1, "lang: required"), (1, "text: required"), (2, "text: empty"), (3, "lang: unknown")]
    scan = {r.doc_id: r for r in content.scan_pii(docs).collect()}
    assert scan[3].masked == "Mail [email] or[phone], [ssn]!" and (scan[3].email, scan[3].phone, scan[3].ssn) == (1, 1, 1)
    assert scan[1].masked == ""
    metrics = {r.doc_id: r for r in content.text_metrics(docs).collect()}
    assert (metrics[1].words, metrics[2].words, metrics[2].mean_word_length) == (0, 0, None)
    assert {r.detected for r in content.stop_word_language(docs).collect()} == {None}
    page = spark.createDataFrame([(1, "u", "<p>a&amp;b<script>x<y</script> <b>c</b>"), (2, None, None)], "page_id bigint, url string, html string")
    assert [r.text for r in content.page_text(page).orderBy("page_id").collect()] == ["a&b c", None]
    wrong = content.dataset_manifest(docs, {"doc_id": "bigint", "text": "string", "extra": "int", "lang": "int"})
    assert {r.schema_problems for r in wrong.collect()} == {
        "extra: missing; lang: string instead of int; source: unexpected; n_chars: unexpected"
    }
