"""Nested JSON readers against hand-made files."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgauge.functions.checksums import with_record_checksum
from lexgauge.sources.json_files import file_checksums, ingestion_log, load_agencies, load_corrections

AGENCIES = [
    {
        "name": "Bureau of \"Tests\" \\ Trials",
        "short_name": "BTT",
        "slug": "bureau-tests",
        "display_name": "left out",
        "cfr_references": [{"title": 2, "chapter": "IV"}, {"title": 5, "part": "12", "subtitle": None}],
        "children": [
            {
                "slug": "office-b",
                "name": "Oficina Ñandú \U0001f600",
                "short_name": None,
                "sortable_name": "Ñandú",
                "cfr_references": [{"title": 7}],
                "checksum": "to be left out",
            },
            {"slug": "office-c", "name": "Office C", "cfr_references": []},
        ],
    },
    {"name": "No children", "short_name": None, "slug": "no-children", "cfr_references": [{"title": 9}]},
    {"name": "Tab\tline\nend", "slug": "no-refs", "cfr_references": []},
]

CORRECTIONS = [
    {
        "id": 1, "title": 12, "year": 2020, "fr_citation": "85 FR 1",
        "cfr_references": [
            {"cfr_reference": "12 CFR 1.1", "hierarchy": {"title": "12", "chapter": "I", "part": "1", "section": "1.1"}},
            {"cfr_reference": "12 CFR 2", "hierarchy": {"part": "2"}},
        ],
        "corrective_action": "Amended § 1.1", "error_occurred": "2020-01-01", "error_corrected": "2020-03-01",
    },
    {"id": 2, "title": 13, "year": 2020, "cfr_references": [], "error_occurred": "2020-01-05"},
    {"id": 3, "title": 13, "year": 2021, "error_occurred": "2021-02-01", "error_corrected": "soon"},
    {
        "id": 4, "title": 14, "year": 2021, "cfr_references": [{"cfr_reference": "14 CFR 3"}],
        "error_occurred": "2021-5-9", "error_corrected": "2021-04-29", "checksum": "ignored",
    },
]


def digest(data):
    text = json.dumps(data, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def agency_digest(agency):
    return digest(
        {
            "name": agency.get("name"),
            "short_name": agency.get("short_name"),
            "slug": agency.get("slug"),
            "cfr_references": agency.get("cfr_references", []),
            "children": [
                {k: v for k, v in c.items() if k != "checksum"} for c in agency.get("children", [])
            ],
        }
    )


def correction_digest(correction):
    names = ["id", "corrective_action", "error_corrected", "error_occurred", "fr_citation", "title", "year"]
    data = {n: correction.get(n) for n in names}
    data["cfr_references"] = correction.get("cfr_references", [])
    return digest(data)


@pytest.fixture(params=["document", "lines"])
def files(request, tmp_path):
    if request.param == "document":
        (tmp_path / "agencies.json").write_text(json.dumps({"agencies": AGENCIES}, indent=1))
        (tmp_path / "corrections.json").write_text(
            json.dumps({"ecfr_corrections": CORRECTIONS}, ensure_ascii=False)
        )
    else:
        (tmp_path / "agencies.json").write_text("\n".join(json.dumps(a) for a in AGENCIES))
        (tmp_path / "corrections.json").write_text("\n".join(json.dumps(c) for c in CORRECTIONS))
    return tmp_path, request.param


def test_agencies(spark, files):
    folder, layout = files
    raw, parsed, refs = load_agencies(spark, str(folder / "agencies.json"), layout)
    rows = {r.slug: r for r in parsed.collect()}
    assert len(rows) == 5
    assert (rows["bureau-tests"].child_count, rows["bureau-tests"].cfr_reference_count) == (2, 2)
    assert (rows["no-children"].child_count, rows["no-refs"].cfr_reference_count) == (0, 0)
    assert rows["office-b"].parent_slug == "bureau-tests" and rows["office-b"].child_count == 0
    everyone = AGENCIES + AGENCIES[0]["children"]
    assert {s: r.checksum for s, r in rows.items()} == {a["slug"]: agency_digest(a) for a in everyone}
    assert {r.agency_slug: r.title for r in refs.filter("agency_slug != 'bureau-tests'").collect()} == {
        "office-b": 7, "no-children": 9,
    }
    stored = {r.slug: json.loads(r.data) for r in raw.collect()}
    assert stored["office-b"] == AGENCIES[0]["children"][0]


def test_corrections(spark, files):
    folder, layout = files
    raw, parsed = load_corrections(spark, str(folder / "corrections.json"), layout)
    rows = {r.ecfr_id: r for r in parsed.collect()}
    assert {i: r.lag_days for i, r in rows.items()} == {1: 60, 2: None, 3: None, 4: -10}
    assert {i: r.cfr_reference for i, r in rows.items()} == {1: "12 CFR 1.1", 2: "", 3: "", 4: "14 CFR 3"}
    assert (rows[1].chapter, rows[1].part, rows[1].section) == ("I", "1", "1.1")
    assert {r.ecfr_id: r.checksum for r in raw.collect()} == {
        c["id"]: correction_digest(c) for c in CORRECTIONS
    }
    assert {i: r.checksum for i, r in rows.items()} == {c["id"]: correction_digest(c) for c in CORRECTIONS}


@pytest.mark.parametrize(
    "text", ["plain", "quote \" and \\ slash/", "Ñandú § 1.1", "\U0001f600 smile", "\x7f\x01\x1f\n\t\b\f\r",
     "\x1b \\x1b \\u001B \\\x1b", "", None]
)
def test_json_text_is_ascii_json(spark, text):
    df = spark.createDataFrame([(text, 3)], "t string, n int")
    row = with_record_checksum(df, {"t": "t", "a": F.array(F.struct("n", "t"))}).first()
    assert row.checksum == digest({"t": text, "a": [{"n": 3, "t": text}]})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=200, max_size=200))
def test_checksum_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r.n: r.checksum for r in with_record_checksum(df, {"t": "t"}).collect()}
    assert got == {n: digest({"t": t}) for n, t in enumerate(texts)}


def test_file_checksums_and_log(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("[1]")
    files = file_checksums(spark, str(tmp_path), "*.json")
    counts = files.select("file_path", F.length("source_file").cast("bigint").alias("record_count"))
    rows = {r.source_file: r for r in ingestion_log(counts, files).collect()}
    assert rows["a.json"].file_checksum == hashlib.sha256(b"{}").hexdigest()
    assert rows["b.json"].record_count == 6 and rows["b.json"].status == "success"
