"""Marts, checks, contracts, privacy and ledger on small hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexgauge.operators import content, contracts, ledger, privacy, quality, snapshots
from lexgauge.operators.steps import steps_for
from lexgauge.plans import marts, reports
from lexgauge.sources.domain import Domain

AGENCY = "slug string, name string, short_name string, parent_slug string, cfr_reference_count bigint, child_count bigint"
REFERENCE = "agency_slug string, title int, chapter string, subtitle string, part string"
CORRECTION = "ecfr_id bigint, title int, year int, error_corrected date, lag_days int"


@pytest.fixture
def domain(spark):
    agencies = [
        ("top", "Top", "T", None, 8, 1),
        ("sub", "Sub", None, "top", 1, 0),
        ("idle", "Idle", None, None, 0, 0),
    ]
    refs = [("top", t, None, None, None) for t in (1, 1, 2, 2, 3, 3, 4, 4)] + [("sub", 9, "I", None, "")]
    corrections = [(i, i % 4 + 1, 2020 + i % 3, None, None if i % 5 == 0 else i % 7) for i in range(1024)]
    return Domain(
        spark.createDataFrame(agencies, AGENCY),
        spark.createDataFrame(refs, REFERENCE),
        spark.createDataFrame(corrections, CORRECTION),
    )


def test_published_index_value(domain):
    rows = {r.slug: r for r in marts.metrics_mart(domain).collect()}
    # 1,024 corrections over 8 references is the published 12,800.00.
    assert (rows["top"].total_corrections, rows["top"].rvi) == (1024, 12800.0)
    assert (rows["sub"].total_corrections, rows["sub"].rvi) == (0, 0.0)
    assert rows["idle"].word_count_estimate == 0 and rows["idle"].avg_correction_lag_days is None
    # An empty part still counts as a part.
    assert rows["sub"].word_count_estimate == 2000


def test_eager_mart_equals_the_plain_join(domain):
    titles = domain.references.select("agency_slug", "title").distinct()
    naive = (
        titles.join(domain.corrections, "title")
        .groupBy("agency_slug")
        .agg(
            F.countDistinct("ecfr_id").alias("n"),
            F.countDistinct("year").alias("years"),
            F.avg("lag_days").alias("lag"),
        )
    )
    ours = {r.slug: r for r in marts.metrics_mart(domain).collect()}
    for row in naive.collect():
        mine = ours[row.agency_slug]
        assert (mine.total_corrections, mine.years_with_corrections) == (row.n, row.years)
        assert mine.avg_correction_lag_days == pytest.approx(row.lag)


def test_top_lists_are_capped(domain):
    assert reports.top_by_corrections(domain, 500).count() == 1
    with pytest.raises(ValueError):
        reports.agencies_sorted(domain, sort="name; drop")


def test_quality_checks_find_faults(spark):
    agencies = spark.createDataFrame(
        [("a", None, 2), ("b", "a", 0), ("c", "gone", 0), ("a", None, 2)], "slug string, parent_slug string, child_count bigint"
    )
    assert [r.key for r in quality.duplicates(agencies, ["slug"], "t").collect()] == ["a"]
    assert [r.slug for r in quality.orphans(agencies, "parent_slug", agencies, "slug").collect()] == ["c"]
    wrong = quality.child_count_mismatches(agencies.dropDuplicates()).collect()
    assert [(r.slug, r.child_count, r.actual_children) for r in wrong] == [("a", 2, 1)]
    rows = spark.createDataFrame([(1, "a" * 64), (2, "A" * 64), (3, None)], "id int, checksum string")
    assert [r.id for r in quality.malformed_checksums(rows, "checksum", "id").collect()] == [2]
    assert [r.id for r in quality.null_values(rows, "checksum", "id").collect()] == [3]
    report = quality.report(
        [
            quality.tallies(rows, {"x": F.col("id") > 1, "y": F.col("id") > 9}),
            quality.empty_view("filled", rows),
            quality.empty_view("blank", rows.filter("id > 9")),
            quality.extra_copies(agencies, ["slug"], "unique"),
        ]
    )
    assert {r.check_name: (r.violations, r.status) for r in report.collect()} == {
        "x": (2, "fail"), "y": (0, "pass"), "filled": (0, "pass"), "blank": (1, "fail"), "unique": (1, "fail"),
    }


def test_snapshot_diff(spark):
    schema = "id int, checksum string"
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, None)], schema)
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (5, None)], schema)
    rows = {r.id: r.change for r in snapshots.snapshot_diff(old, new, "id", include_same=True).collect()}
    assert rows == {1: "same", 2: "changed", 3: "removed", 4: "added", 5: "same"}
    assert snapshots.snapshot_diff(old, new, "id").count() == 3


def test_copies_of_a_key_are_compared_as_one(spark):
    schema = "id int, checksum string"
    old = spark.createDataFrame([(1, "a")] * 700 + [(2, "b"), (2, "c"), (2, "c")], schema)
    new = spark.createDataFrame([(1, "a")] * 701 + [(2, "c"), (2, "b"), (2, "c")], schema)
    rows = {r.id: r.change for r in snapshots.snapshot_diff(old, new, "id", include_same=True).collect()}
    assert rows == {1: "changed", 2: "same"}


PAYLOADS = [
    ('{"agency":"nasa","content_type":"text","use_case":"policy"}', None, []),
    ('{"agency":"nasa","content_type":"text","use_case":"policy","stage":"later"}',
     "invalid stage: later (must be one of: ingest, transform, export, full)", ["stage: enum"]),
    ('{"agency":7,"content_type":"film"}', "missing required field: use_case",
     ["agency: type", "content_type: enum", "use_case: required"]),
    ('{"agency":"Nasa!","content_type":"text","use_case":"policy"}',
     "invalid agency: Nasa! (must be lowercase alphanumeric with hyphens)", ["agency: pattern"]),
    ('{"agency":"ab","content_type":"text","use_case":"general","more":1}',
     "invalid agency: ab (must be lowercase alphanumeric with hyphens)",
     ["agency: minLength", "use_case: enum", "more: not allowed"]),
    ('{"agency":"nasa","content_type":"text","use_case":"policy","source":"http://x","checkpoint_id":"1"}', None,
     ["source: pattern", "checkpoint_id: pattern"]),
]


def test_payload_contract(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAYLOADS)], "i int, payload string")
    rows = contracts.apply_contract(df, contracts.PAYLOAD_RULES, "payload").select(
        "i", "violations", "accepted", contracts.first_payload_error().alias("error")
    )
    for row in rows.collect():
        assert (row.error, row.violations) == PAYLOADS[row.i][1:]
        assert row.accepted == (not row.violations)


def test_bad_json_is_quarantined(spark):
    df = spark.createDataFrame([("{oops",)], "payload string")
    row = contracts.apply_contract(df, contracts.PAYLOAD_RULES, "payload").first()
    assert row.violations == ["not valid JSON"] and not row.accepted


def test_steps(spark):
    df = spark.createDataFrame([("ingest", "text", "policy"), ("full", "mixed", "general")], "s string, c string, u string")
    first, second = [r[0] for r in df.select(steps_for(F.col("s"), F.col("c"), F.col("u"))).collect()]
    assert first == [
        "validate_source", "calculate_checksums", "load_text_records", "tokenise_text", "detect_language",
        "generate_policy_brief_metadata", "export_structured_summary",
    ]
    assert len(second) == 9 + 7 + 6


def test_privacy_pass(spark):
    rows = [("ann", 30 + i % 10, "2024-01-03") for i in range(5)] + [("bob", 41, "2024-01-03")] * 4
    rows += [(None, None, "2024-01-09")] * 6
    df = spark.createDataFrame(rows, "name string, age int, seen string").withColumn("seen", F.col("seen").cast("date"))
    clean = privacy.generalize(
        privacy.hash_identifiers(df, {"name": "person"}, "s"), "age", "band", "seen", "week"
    )
    assert set(clean.columns) == {"person", "band", "week"}
    safe = privacy.k_anonymous(clean, ["band", "week"], 5)
    assert [(r.band, r["count"]) for r in safe.groupBy("band").count().collect()] == [("30_to_39", 5)]
    small = privacy.k_violations(clean, ["band", "week"], 5).collect()
    assert [(r.band, r.group_size) for r in small] == [("40_to_49", 4)]
    # Unknown names stay unknown and cannot be linked.
    assert clean.filter("band is null and person is not null").count() == 0


def test_linkage_needs_authorization(spark):
    left = spark.createDataFrame([("p1",)] * 50 + [("p2",)], "id string")
    right = spark.createDataFrame([("p1",)] * 30 + [("p3",), (None,)], "id string")
    a, b = privacy.link_tokens(left, "id", "g", "a"), privacy.link_tokens(right, "id", "g", "b")
    assert [(r.left_records, r.right_records) for r in privacy.link(a, b, authorized=True).collect()] == [(50, 30)]
    assert privacy.link(a, b).count() == 0


SAVE = "run_id string, save_id int, saved_at timestamp_ntz, agency_id string, provider_name string, model string, status string, payload string, last_step string"


@pytest.fixture
def saves(spark):
    def save(run, n, day, tenant, status, payload, step):
        return (run, n, datetime(2024, 1, day), tenant, "p", "m", status, payload, step)

    return spark.createDataFrame(
        [
            save("r1", 1, 1, "x", "PENDING", "{}", "auth"),
            save("r1", 2, 2, "x", "DONE", '{"a":1}', "call"),
            save("r2", 3, 20, "y", "PENDING", "{}", "auth"),
        ],
        SAVE,
    )


def test_checkpoints(saves):
    latest = ledger.latest_checkpoints(saves)
    rows = {r.run_id: r for r in latest.collect()}
    assert (rows["r1"].status, rows["r1"].last_step, rows["r1"].event_count) == ("PENDING", "call", 2)
    assert rows["r1"].expires_at == datetime(2024, 1, 31)
    now = datetime(2024, 2, 2)
    assert ledger.expiry_counts(latest, now).first()[:] == (1, 1)
    assert [r.run_id for r in ledger.unexpired(latest, now).collect()] == ["r2"]
    integrity = ledger.verify_integrity(latest, now)
    assert ledger.load_checkpoint(latest, integrity, "r1", "x", now).count() == 0
    assert ledger.load_checkpoint(latest, integrity, "r2", "x", now).count() == 0
    assert ledger.load_checkpoint(latest, integrity, "r2", "y", now).first().is_valid
    spoiled = latest.withColumn("payload", F.lit("{}"))
    assert {r.run_id: r.integrity_valid for r in ledger.verify_integrity(spoiled, now).collect()} == {"r1": False, "r2": True}


def test_tenants_see_only_their_rows(saves):
    for tenant in ("x", "y"):
        assert ledger.foreign_rows(ledger.tenant_rows(saves, tenant), tenant).count() == 0
    assert ledger.foreign_rows(saves, "x").count() == 1
    with pytest.raises(ValueError):
        ledger.tenant_rows(saves, "")


def test_weights():
    assert ledger.parse_weights("a:0.5,b:1.5") == [("a", 0.25), ("b", 1.0)]
    assert ledger.parse_weights("junk,a:x") == []


def test_weighted_choice_follows_the_weights(spark):
    rows = spark.range(4000).select(ledger.weighted_choice(F.col("id"), "a:0.7,b:0.3", "a").alias("c"))
    counts = {r.c: r["count"] for r in rows.groupBy("c").count().collect()}
    assert 0.66 < counts["a"] / 4000 < 0.74 and set(counts) == {"a", "b"}


def test_unknown_error_class(spark):
    df = spark.createDataFrame([("TRANSIENT_ERROR",), ("NEW",)], "kind string")
    rows = {r.kind: (r.http_status, r.retryable) for r in contracts.classify_errors(df, "kind").collect()}
    assert rows == {"TRANSIENT_ERROR": (503, True), "NEW": (500, False)}


def test_a_manifest_tells_texts_of_equal_length_apart(spark):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    expected = dict(part.split() for part in kinds.split(", "))

    def manifest(*texts):
        docs = spark.createDataFrame([(i, t, "en", "a", 3) for i, t in enumerate(texts)], kinds)
        return {r["table_name"]: r for r in content.dataset_manifest(docs, expected).collect()}

    one, other = manifest("abc", "dé", None), manifest("abd", "dé", None)
    assert sum(r["characters"] for r in one.values()) == sum(r["characters"] for r in other.values()) == 5
    assert len([s for s in one if one[s]["aggregate_checksum"] != other[s]["aggregate_checksum"]]) == 1
