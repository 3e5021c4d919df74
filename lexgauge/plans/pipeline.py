"""Run the steps a payload asks for, each one Spark job, with a step ledger."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.operators import classification, content, contracts, privacy, profiles, quality, sentiment, steps, vectors
from lexgauge.operators.profiles import archival_manifest
from lexgauge.plans import marts, reports
from lexgauge.sinks.publication import Publication
from lexgauge.sinks.writers import export_csv, log_etl_run, serving_tables
from lexgauge.sources.domain import Domain
from lexgauge.sources.tables import SCHEMAS

LEDGER = (
    "run_id string, step_number int, step string, status string, records bigint, finished_at timestamp_ntz"
)


@dataclass(frozen=True)
class Run:
    spark: SparkSession
    domain: Domain
    folder: str
    as_of: date
    tables: dict[str, DataFrame] = field(default_factory=dict)
    run_id: str = "run"
    started: float = field(default_factory=time.time)

    def table(self, name: str) -> DataFrame:
        """A content table (documents, pages, embeddings, labels, orders, events) of the caller."""
        if name not in self.tables:
            raise ValueError(f"this step needs the table {name}")
        return self.tables[name]

    def write(self, df: DataFrame, name: str) -> int:
        """Replace one output table and return its row count."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def destination(self) -> Publication:
        """The serving tables; they change together, when the run's export is logged."""
        return Publication(self.spark, f"{self.folder}/serving")

    def serving(self, *names: str) -> int:
        tables, staging = serving_tables(self.domain), self.destination().stage(self.run_id)
        return sum(staging.add(name, tables[name]) for name in names)


def _checks(run: Run) -> int:
    corrections, agencies = run.domain.stored_corrections(), run.domain.agencies
    checks = [
        quality.extra_copies(corrections, ["ecfr_id"], "unique corrections.ecfr_id"),
        quality.extra_copies(agencies, ["slug"], "unique agencies.slug"),
        quality.tallies(corrections, {"checksum present": F.col("checksum").isNull()}),
    ]
    records = run.write(quality.report(checks), "source_checks")
    failed = run.spark.read.parquet(f"{run.folder}/source_checks").filter("status = 'fail'").collect()
    if failed:
        raise ValueError("source refused: " + "; ".join(f"{r.check_name}: {r.violations}" for r in failed))
    if "documents" in run.tables:
        records += run.write(content.validate_documents(run.table("documents")), "document_violations")
    return records


def _stored(run: Run) -> dict[str, DataFrame]:
    return {"agencies": run.domain.stored_agencies(), "corrections": run.domain.stored_corrections()}


def _digests(run: Run) -> int:
    records = run.write(archival_manifest(_stored(run)), "checksums")
    if "documents" in run.tables:
        records += run.write(content.text_checksums(run.table("documents")), "document_checksums")
    return records


def _csv(run: Run) -> int:
    """The metrics are computed once and exported from what was written."""
    records = run.write(marts.serving_metrics(run.domain), "csv_source")
    export_csv(run.spark.read.parquet(f"{run.folder}/csv_source"), f"{run.folder}/csv", "agency_metrics")
    return records


def _content(name: str, operator: Callable[[DataFrame], DataFrame], out: str) -> Callable[[Run], int]:
    """A job that applies an operator to one of the caller's content tables."""
    return lambda run: run.write(operator(run.table(name)), out)


def _metrics(run: Run) -> int:
    records = run.write(marts.metrics_mart(run.domain), "record_metrics")
    if "documents" in run.tables:
        records += run.write(content.text_metrics(run.table("documents")), "text_metrics")
    return records


def _dictionaries(run: Run) -> int:
    tables = {**_stored(run), **run.tables}
    rows = [profiles.data_dictionary(df, name) for name, df in tables.items()]
    return run.write(reduce(DataFrame.unionByName, rows), "data_dictionary")


def _provenance(run: Run) -> int:
    """What each stored table is made of: rows, digest and columns, beside the exports."""
    stored = _stored(run)
    listed = [(name, "select and fingerprint", df, df) for name, df in stored.items()]
    return run.write(privacy.provenance(listed), "provenance")


def _sentiment(run: Run) -> int:
    """By words weighed from the caller's labels; by the short word list where there are none."""
    docs = run.table("documents")
    if "labels" not in run.tables:
        return run.write(content.sentiment(docs), "sentiment")
    run.write(sentiment.word_weights(docs, run.table("labels")), "sentiment_weights")
    return run.write(sentiment.score(docs, run.spark.read.parquet(f"{run.folder}/sentiment_weights")), "sentiment")


def _classes(run: Run) -> int:
    docs, path = run.table("documents"), f"{run.folder}/classification_model"
    model = classification.fit_and_write(docs, run.table("labels"), path)
    return run.write(classification.classify(docs, model), "document_classes")


def _vectors(run: Run) -> int:
    """A vector of every document, the language whose centroid is nearest, and labels of given vectors."""
    docs = run.table("documents")
    records = run.write(vectors.text_vectors(docs), "text_vectors")
    if "lang" in docs.columns:
        labelled = run.spark.read.parquet(f"{run.folder}/text_vectors").join(docs.select("doc_id", "lang"), "doc_id")
        run.write(vectors.nearest_label(labelled, vectors.label_centroids(labelled, "lang")), "text_vector_labels")
    if "embeddings" in run.tables:
        run.write(content.embedding_nearest(run.table("embeddings")), "embedding_labels")
    return records


def _transfer_vectors(run: Run) -> int:
    """The vectors that the transform step wrote; in a run without it they are computed here."""
    staging = run.destination().stage(run.run_id)
    if "documents" not in run.tables:
        return staging.add("embeddings", run.table("embeddings"))
    try:
        found = run.spark.read.parquet(f"{run.folder}/text_vectors")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = vectors.text_vectors(run.table("documents"))
    return staging.add("text_vectors", found)


def _commit_export(run: Run) -> int:
    """Publish what the transfer steps staged and log it; a failure is logged and raised again."""
    log, staging = f"{run.folder}/etl_log", run.destination().stage(run.run_id)
    records = sum(row["rows"] for row in staging.staged())
    try:
        staging.commit()
    except Exception as error:
        log_etl_run(run.spark, log, "lake", records, "failed", str(error), run.started)
        raise
    log_etl_run(run.spark, log, "lake", records, "success", None, run.started)
    return records


def _labels(run: Run) -> int:
    """Every agency with its classification label; ``manifests`` may name others than the default."""
    agencies = run.domain.stored_agencies().withColumnRenamed("slug", "agency_id")
    none = run.spark.createDataFrame([], "agency_id string, data_classification string")
    labelled = privacy.in_clearance(agencies, run.tables.get("manifests", none), contracts.CLASSIFICATIONS)
    return run.write(labelled, "classification_labels")


def _link(run: Run) -> int:
    """Persons of orders and events linked by tokens; their salts are the run's own, so that runs do not link."""
    salt = f"{run.run_id}:shared"
    left = privacy.link_tokens(run.table("orders"), "o_custkey", salt, f"{run.run_id}:orders")
    right = privacy.link_tokens(run.table("events"), "user_id", salt, f"{run.run_id}:events")
    return run.write(privacy.link(left, right, authorized=True), "linked_records")


def _package(name: str, *outputs: str) -> Callable[[Run], int]:
    """A job that writes the manifest of a package: the stored tables and what earlier steps of the run wrote."""

    def job(run: Run) -> int:
        tables = _stored(run) | {out: run.spark.read.parquet(f"{run.folder}/{out}") for out in outputs}
        return run.write(profiles.package_manifest(tables, name), f"{name}_manifest")

    return job


def _scientific(run: Run) -> int:
    """Problems of the given tables' columns and of the documents' values."""
    records = run.write(profiles.schema_problems(_stored(run) | run.tables, SCHEMAS), "scientific_schema")
    if "documents" in run.tables:
        run.write(content.validate_documents(run.table("documents")), "scientific_values")
    return records


def _review(run: Run) -> int:
    """The manifest of everything a reviewer needs: stored tables, given tables and the schema report."""
    report = run.spark.read.parquet(f"{run.folder}/scientific_schema")
    package = profiles.package_manifest(_stored(run) | run.tables | {"scientific_schema": report}, "peer_review")
    return run.write(package, "peer_review_manifest")


def _schema(run: Run) -> int:
    expected = dict(run.table("documents").dtypes) | {"doc_id": "bigint", "text": "string"}
    manifest = content.dataset_manifest(run.table("documents"), expected)
    return run.write(manifest.filter("schema_problems != ''"), "schema_problems")


def _manifest(run: Run) -> int:
    expected = dict(run.table("documents").dtypes)
    return run.write(content.dataset_manifest(run.table("documents"), expected), "dataset_manifest")


def _verify(run: Run) -> int:
    then = run.spark.read.parquet(f"{run.folder}/archive").select("table_name", "aggregate_checksum")
    now = archival_manifest(_stored(run)).drop("columns")
    compared = now.join(then.withColumnRenamed("aggregate_checksum", "archived"), "table_name")
    verdict = compared.withColumn("matches", F.col("archived") == F.col("aggregate_checksum"))
    return run.write(verdict, "archive_verification")


def _archive(run: Run) -> int:
    return run.write(archival_manifest(_stored(run)), "archive")


# Steps with work behind them; a payload that asks for others is refused, unless the caller allows it.
JOBS: dict[str, Callable[[Run], int]] = {
    "validate_source": _checks,
    "calculate_checksums": _digests,
    "load_text_records": _content("documents", lambda df: df, "documents"),
    "load_documents": _content("documents", lambda df: df, "documents"),
    "index_document_metadata": _content("documents", content.metadata_index, "metadata_index"),
    "extract_text_from_pdf": _content("pages", content.page_text, "page_text"),
    "tokenise_text": _content("documents", content.term_counts, "terms"),
    "detect_language": _content("documents", content.stop_word_language, "languages"),
    "extract_named_entities": _content("documents", content.entities, "entities"),
    "run_sentiment_analysis": _sentiment,
    "run_document_classification": _classes,
    "compute_text_embeddings": _vectors,
    "clear_destination": lambda run: run.destination().stage(run.run_id).clear(),
    "transfer_embeddings": _transfer_vectors,
    "log_etl_run": _commit_export,
    "split_train_val_test": _content("documents", content.dataset_split, "dataset_split"),
    "export_dataset_manifest": _manifest,
    "validate_dataset_schema": _schema,
    "generate_data_dictionary": _dictionaries,
    "attach_provenance_metadata": _provenance,
    "compute_economic_indicators": _content("orders", profiles.economic_trend, "economic_indicators"),
    "build_timeline_index": _content(
        "events", lambda df: profiles.timeline(df, "user_id", "ts", "event_id"), "timeline"
    ),
    "apply_classification_labels": _labels,
    "link_cross_agency_records": _link,
    "export_cultural_heritage_manifest": _package("cultural_heritage", "linked_records"),
    "export_historical_record_manifest": _package("historical_record", "timeline"),
    "validate_scientific_schema": _scientific,
    "export_peer_review_package": _review,
    "compute_record_metrics": _metrics,
    "compute_time_series": lambda run: run.write(
        marts.time_series_monthly(run.domain.corrections), "time_series"
    ),
    "transfer_records": lambda run: run.serving("agencies", "corrections"),
    "transfer_metrics": lambda run: run.serving("agency_metrics", "cfr_title_stats"),
    "transfer_time_series": lambda run: run.serving("correction_time_series"),
    "export_structured_csv": _csv,
    "write_archival_manifest": _archive,
    "verify_long_term_checksums": _verify,
    "generate_dashboard_summary": lambda run: run.write(marts.summary_overview(run.domain), "dashboard"),
    "export_structured_summary": lambda run: run.write(
        reports.agency_metrics_top(run.domain, 10), "summary"
    ),
    "export_trend_report": lambda run: run.write(
        marts.trends_yearly(run.domain.corrections), "trend_report"
    ),
}


def _plan(spark: SparkSession, payload: dict) -> list[str]:
    """The payload's steps; a payload that breaks the contract is refused."""
    row = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    checked = contracts.apply_contract(row, contracts.PAYLOAD_RULES, "payload")
    doc = contracts.Document()
    names = {n: F.coalesce(doc.text(n), F.lit(v)) for n, v in steps.DEFAULTS.items()}
    plan = checked.select(
        "violations",
        steps.steps_for(names["stage"], names["content_type"], names["use_case"]).alias("steps"),
    ).first()
    if plan.violations:
        raise ValueError("payload refused: " + "; ".join(plan.violations))
    return plan.steps


def finished_steps(spark: SparkSession, ledger: str, run_id: str) -> set[str]:
    """Steps of a run that are done, from the ledger of earlier attempts."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    done = rows.filter((F.col("run_id") == run_id) & (F.col("status") == "done"))
    return {row.step for row in done.select("step").distinct().collect()}


def run_pipeline(
    spark: SparkSession,
    payload: dict,
    domain: Domain,
    folder: str,
    run_id: str,
    as_of: date,
    resume: bool = False,
    tables: dict[str, DataFrame] | None = None,
    allow_missing: bool = False,
) -> list[tuple[str, str, int]]:
    """Run a payload's steps in order and return (step, status, records).

    ``tables`` holds the content tables that text and dataset steps read.  A
    payload with a step that has no job is refused before anything runs; with
    ``allow_missing`` such steps are logged as ``no_job``.
    Every finished step is appended to the ledger.  With ``resume``, steps the
    ledger knows as done are skipped; a failing step is logged and raised.
    """
    plan = _plan(spark, payload)
    missing = [step for step in plan if step not in JOBS]
    if missing and not allow_missing:
        raise ValueError("steps without a job: " + ", ".join(missing))
    ledger = f"{folder}/_ledger"
    done = finished_steps(spark, ledger, run_id) if resume else set()
    run, outcome = Run(spark, domain, folder, as_of, tables or {}, run_id), []

    def log(number: int, step: str, status: str, records: int) -> None:
        outcome.append((step, status, records))
        row = (run_id, number, step, status, records, datetime.now())
        spark.createDataFrame([row], LEDGER).write.mode("append").parquet(ledger)

    for number, step in enumerate(plan, start=1):
        if step in done:
            outcome.append((step, "skipped", 0))
        elif step not in JOBS:
            log(number, step, "no_job", 0)
        else:
            try:
                records = JOBS[step](run)
            except Exception:
                log(number, step, "failed", 0)
                raise
            log(number, step, "done", records)
    return outcome
