import glob
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexgauge.operators import profiles
from lexgauge.operators.steps import EXPORT, INGEST, INGEST_BASE, TRANSFORM, TRANSFORM_BASE, USE_CASE
from lexgauge.plans import pipeline
from lexgauge.sinks.publication import Publication, PublicationError
from lexgauge.sources.domain import load_domain
from lexgauge.sources.tables import read_table


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def versions(spark):
    one = {"a": spark.range(10), "b": spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "id int, name string")}
    two = {"a": spark.range(5, 9), "b": spark.createDataFrame([], "id int, name string"), "c": spark.range(3)}
    return one, two


def test_tables_change_together(spark, tmp_path):
    one, two = versions(spark)
    store = Publication(spark, str(tmp_path))
    with pytest.raises(PublicationError):
        store.read("a")
    assert store.publish("v1", one) == {"a": 10, "b": 3}
    assert store.read("b").count() == 3
    assert store.publish("v2", two) == {"a": 4, "b": 0, "c": 3}
    assert plain(store.read("a")) == [(5,), (6,), (7,), (8,)] and store.read("b").count() == 0
    assert [r["version"] for r in store.manifests().select("sequence", "version").distinct().orderBy("sequence").collect()] == ["v1", "v2"]


def test_a_failing_table_leaves_the_version_before(spark, tmp_path):
    one, two = versions(spark)
    store = Publication(spark, str(tmp_path))
    store.publish("v1", one)

    def fails():
        raise RuntimeError("disk")

    with pytest.raises(RuntimeError):
        store.publish("v2", {"a": two["a"], "b": two["b"], "c": fails})
    assert store.read("a").count() == 10 and store.read("b").count() == 3
    # A row that fails in a task, halfway through a table.
    broken = spark.range(100).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("row"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="row"):
        store.publish("v3", {"a": two["a"], "b": broken})
    assert store.read("a").count() == 10
    # The version may be begun again.
    store.publish("v2", two)
    assert store.read("a").count() == 4


def test_damage_is_found_before_the_commit(spark, tmp_path):
    one, two = versions(spark)
    store = Publication(spark, str(tmp_path))
    store.publish("v1", one)
    staging = store.stage("v2")
    for name, df in two.items():
        staging.add(name, df)
    spark.range(50, 54).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/versions/v2/a")
    verdict = {r["table_name"]: r["matches"] for r in staging.verify().collect()}
    assert verdict == {"a": False, "b": True, "c": True}
    with pytest.raises(PublicationError, match="differ.*: a$"):
        staging.commit()
    assert store.read("a").count() == 10
    for path in glob.glob(f"{tmp_path}/versions/v2/a/part-*"):
        with open(path, "wb") as file:
            file.write(b"torn")
    with pytest.raises(Exception):
        staging.commit()
    assert store.read("a").count() == 10


def test_a_repeated_commit_publishes_once(spark, tmp_path):
    one, _ = versions(spark)
    store = Publication(spark, str(tmp_path))
    store.publish("v1", one)
    assert store.stage("v1").commit() == 2
    assert store.manifests().count() == 2
    with pytest.raises(PublicationError, match="no tables"):
        store.stage("none").commit()


def test_every_member_of_a_package_counts(spark):
    def root(tables):
        rows = sorted(profiles.package_manifest(tables, "p").collect(), key=lambda r: r["position"])
        assert [r["table_name"] for r in rows] == list(tables)
        return rows[-1]["chain"]

    a, b = spark.range(5), spark.createDataFrame([(1, "x")], "id int, name string")
    whole = root({"a": a, "b": b})
    assert whole == root({"a": a.orderBy(F.desc("id")), "b": b})
    others = [{"b": b, "a": a}, {"a": a.limit(4), "b": b}, {"a": a, "b": b.withColumn("name", F.lit("y"))}, {"a": a}]
    assert len({whole, *map(root, others)}) == 5


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {n: read_table(spark, sf_dir, n) for n in ("documents", "labels", "embeddings", "events", "orders", "pages")}


def test_a_full_payload_runs_without_exceptions(spark, sf_dir, tables, tmp_path):
    use_case = "research"
    payload = {"agency": "nasa", "content_type": "text", "use_case": use_case}
    domain, folder = load_domain(spark, sf_dir), str(tmp_path)
    done = pipeline.run_pipeline(spark, payload, domain, folder, "r1", date(2024, 1, 1), tables=tables)
    wanted = INGEST_BASE + INGEST["text"] + TRANSFORM_BASE + TRANSFORM["text"] + EXPORT + USE_CASE[use_case]
    assert [(step, state) for step, state, _ in done] == [(step, "done") for step in wanted]
    store = Publication(spark, f"{folder}/serving")
    names = {r["table_name"] for r in store.manifest()}
    assert names == {"agencies", "corrections", "agency_metrics", "cfr_title_stats", "text_vectors", "correction_time_series"}
    assert store.read("text_vectors").count() == tables["documents"].count()
    logged = spark.read.parquet(f"{folder}/etl_log").collect()
    assert [r["status"] for r in logged] == ["success"]
    assert logged[0]["records_processed"] == sum(r["rows"] for r in store.manifest())


@pytest.mark.parametrize("use_case", ["national-security", "cultural", "historical", "scientific"])
def test_use_cases_have_all_their_jobs(spark, sf_dir, tables, tmp_path, monkeypatch, use_case):
    # The other step of this use case routes to machines that are not there.
    monkeypatch.setitem(USE_CASE, "national-security", ["apply_classification_labels"])
    whole = INGEST_BASE + INGEST["text"] + TRANSFORM_BASE + TRANSFORM["text"] + EXPORT + USE_CASE[use_case]
    assert set(whole) <= set(pipeline.JOBS)
    payload = {"agency": "nasa", "content_type": "text", "use_case": use_case, "stage": "ingest"}
    domain = load_domain(spark, sf_dir)
    done = pipeline.run_pipeline(spark, payload, domain, str(tmp_path), "r1", date(2024, 1, 1), tables=tables)
    assert [(step, state) for step, state, _ in done] == [(s, "done") for s in INGEST_BASE + INGEST["text"] + USE_CASE[use_case]]


def test_documents_are_classified_in_a_payload(spark, sf_dir, tables, tmp_path):
    payload = {"agency": "nasa", "content_type": "documents", "use_case": "scientific", "stage": "transform"}
    done = pipeline.run_pipeline(spark, payload, load_domain(spark, sf_dir), str(tmp_path), "r1", date(2024, 1, 1), tables=tables)
    assert dict((s, n) for s, _, n in done)["run_document_classification"] == tables["documents"].count()
    assert spark.read.parquet(f"{tmp_path}/scientific_schema").count() == 0
    manifest = spark.read.parquet(f"{tmp_path}/peer_review_manifest")
    assert manifest.count() == 2 + len(tables) + 1


def test_a_failing_transfer_keeps_the_published_tables(spark, sf_dir, tables, tmp_path, monkeypatch):
    payload = {"agency": "nasa", "content_type": "text", "use_case": "policy-none", "stage": "export"}
    payload["use_case"] = "policy"
    monkeypatch.setitem(USE_CASE, "policy", [])
    domain, folder, day = load_domain(spark, sf_dir), str(tmp_path), date(2024, 1, 1)
    pipeline.run_pipeline(spark, payload, domain, folder, "r1", day, tables=tables)
    store = Publication(spark, f"{folder}/serving")
    before = plain(store.read("corrections"))

    def fails(run):
        raise RuntimeError("disk")

    fewer = domain.with_(corrections=domain.corrections.limit(5))
    with monkeypatch.context() as patch:
        patch.setitem(pipeline.JOBS, "transfer_time_series", fails)
        with pytest.raises(RuntimeError):
            pipeline.run_pipeline(spark, payload, fewer, folder, "r2", day, tables=tables)
    assert plain(store.read("corrections")) == before
    pipeline.run_pipeline(spark, payload, fewer, folder, "r2", day, tables=tables, resume=True)
    assert store.read("corrections").count() == 5
