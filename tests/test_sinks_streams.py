"""Writers, the step pipeline and streams: write, read back, compare."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lexgauge.operators.profiles import event_time_series
from lexgauge.plans import pipeline
from lexgauge.sinks import writers
from lexgauge.sources.domain import load_domain
from lexgauge.sources.tables import read_table
from lexgauge.streaming import events as stream


@pytest.fixture(scope="module")
def domain(spark, sf_dir):
    return load_domain(spark, sf_dir)


def test_transfer_and_logs(spark, domain, tmp_path):
    log = str(tmp_path / "etl_log")
    target = writers.parquet_target(str(tmp_path), {"corrections": ["year"]})
    moved = writers.transfer(spark, domain, target, log)
    for name, rows in moved.items():
        assert spark.read.parquet(str(tmp_path / name)).count() == rows > 0
    assert spark.read.parquet(str(tmp_path / "data_checksums")).count() == 2
    again = writers.transfer(spark, domain, target, log)
    assert again == moved

    def broken(df, table):
        raise RuntimeError("no room")

    with pytest.raises(RuntimeError):
        writers.transfer(spark, domain, broken, log)
    entries = spark.read.parquet(log).orderBy("run_timestamp").collect()
    assert [e.status for e in entries] == ["success", "success", "failed"]
    assert entries[0].records_processed == sum(moved.values()) and "no room" in entries[2].error_message


def test_json_and_csv_exports(spark, domain, tmp_path):
    writers.export_json(domain, str(tmp_path), date(2024, 1, 1))
    agencies = spark.read.json(str(tmp_path / "agencies"))
    assert agencies.count() == domain.agencies.count()
    assert agencies.agg(F.max("id")).first()[0] == agencies.count()
    assert spark.read.json(str(tmp_path / "corrections")).count() == domain.corrections.count()
    assert spark.read.json(str(tmp_path / "summary_overview")).first().total_agencies == agencies.count()
    writers.export_csv(domain.agencies, str(tmp_path / "csv"), "agencies")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv" / "agencies"))
    assert sorted(r.slug for r in back.collect()) == sorted(r.slug for r in domain.agencies.collect())
    dictionary = spark.read.option("header", True).csv(str(tmp_path / "csv" / "agencies_dictionary"))
    assert dictionary.count() == len(domain.agencies.columns)


def test_audit_is_append_only(spark, tmp_path):
    path = str(tmp_path / "audit")
    for action in ("CREATE", "RESUME"):
        row = (datetime(2024, 1, 1), "u", "a", action, "checkpoint", "1", True, None)
        writers.append_audit(spark, path, [row])
    assert sorted(r.action for r in spark.read.parquet(path).collect()) == ["CREATE", "RESUME"]


PAYLOAD = {"agency": "nasa", "content_type": "text", "use_case": "preservation"}


def test_pipeline_resumes_after_the_last_finished_step(spark, domain, sf_dir, tmp_path, monkeypatch):
    folder = str(tmp_path)
    names = ("documents", "embeddings", "events", "orders")
    more = {"tables": {n: read_table(spark, sf_dir, n) for n in names}, "allow_missing": True}

    def fails(run):
        raise RuntimeError("disk")

    with monkeypatch.context() as patch:
        patch.setitem(pipeline.JOBS, "transfer_metrics", fails)
        with pytest.raises(RuntimeError):
            pipeline.run_pipeline(spark, PAYLOAD, domain, folder, "r1", date(2024, 1, 1), **more)
    done = pipeline.run_pipeline(spark, PAYLOAD, domain, folder, "r1", date(2024, 1, 1), resume=True, **more)
    status = {step: state for step, state, _ in done}
    assert status["compute_record_metrics"] == "skipped" and status["transfer_metrics"] == "done"
    assert status["verify_long_term_checksums"] == "done" and status["replicate_to_cold_storage"] == "no_job"
    assert status["detect_language"] == "skipped" and status["load_text_records"] == "skipped"
    verdict = spark.read.parquet(f"{folder}/archive_verification")
    assert {r.matches for r in verdict.collect()} == {True}
    with pytest.raises(ValueError, match="agency: required"):
        pipeline.run_pipeline(spark, {"content_type": "text", "use_case": "policy"}, domain, folder, "r2", date(2024, 1, 1))


def test_pipeline_refuses_steps_without_a_job(spark, domain, tmp_path):
    with pytest.raises(ValueError, match="replicate_to_cold_storage"):
        pipeline.run_pipeline(spark, PAYLOAD, domain, str(tmp_path), "r1", date(2024, 1, 1))


@pytest.mark.parametrize("use_case", ["research", "ai-training", "economic-development", "historical"])
def test_pipeline_runs_every_job(spark, domain, sf_dir, tmp_path, use_case):
    payload = {"agency": "nasa", "content_type": "text", "use_case": use_case, "stage": "transform"}
    names = ("documents", "embeddings", "events", "orders")
    tables = {n: read_table(spark, sf_dir, n) for n in names}
    done = pipeline.run_pipeline(spark, payload, domain, str(tmp_path), "r1", date(2024, 1, 1), tables=tables)
    counts = {step: records for step, state, records in done if state == "done"}
    assert counts["run_sentiment_analysis"] == tables["documents"].count()
    wanted = {
        "research": ["export_structured_csv", "generate_data_dictionary", "attach_provenance_metadata"],
        "ai-training": ["split_train_val_test", "export_dataset_manifest"],
        "economic-development": ["compute_economic_indicators", "export_trend_report"],
        "historical": ["build_timeline_index"],
    }
    assert all(counts[step] > 0 for step in wanted[use_case])


def comparable(df):
    return sorted((str(r.day), r.event_type, r.event_count, r.total_value) for r in df.collect())


def test_stream_equals_batch_and_resumes(spark, sf_dir, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = read_table(spark, sf_dir, "events")
    middle = datetime(2024, 1, 15)
    first, second = events.filter(F.col("ts") < F.lit(middle)), events.filter(F.col("ts") >= F.lit(middle))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        activity = stream.daily_activity(stream.read_events(spark, source), "1 day")
        stream.write_activity(activity, out, state).awaitTermination()
    assert comparable(stream.current_activity(spark, out)) == comparable(event_time_series(events))


def test_late_rows_are_counted(spark, sf_dir, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = read_table(spark, sf_dir, "events")
    middle = F.lit(datetime(2024, 1, 15))
    dropped = []
    for part in (events.filter(F.col("ts") >= middle), events.filter(F.col("ts") >= middle), events.filter(F.col("ts") < middle)):
        part.coalesce(1).write.mode("append").parquet(source)
        activity = stream.daily_activity(stream.read_events(spark, source), "1 day")
        query = stream.write_activity(activity, out, state)
        query.awaitTermination()
        dropped.append(stream.dropped_rows(query))
    assert dropped[0] == 0 and dropped[-1] > 0


def test_stream_log_drops_repeats_across_batches(spark, sf_dir, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = read_table(spark, sf_dir, "events").filter("ts < '2024-01-01 12:00:00'")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(source)
        rows = stream.distinct_events(stream.read_events(spark, source), "1 day")
        stream.write_log(rows, out, state).awaitTermination()
    written = spark.read.parquet(out)
    assert written.count() == events.count() == written.select("event_id").distinct().count()
