"""Exports to JSON, CSV, parquet and JDBC, and the append-only logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexgauge.functions.checksums import table_digest
from lexgauge.operators.profiles import data_dictionary
from lexgauge.plans import marts, reports
from lexgauge.session import materialize
from lexgauge.sources.domain import Domain

ETL_LOG = (
    "run_timestamp timestamp_ntz, source string, records_processed bigint, status string, "
    "error_message string, duration_seconds bigint"
)
AUDIT_LOG = (
    "timestamp timestamp_ntz, user_id string, agency_id string, action string, resource_type string, "
    "resource_id string, success boolean, error_message string"
)

Target = Callable[[DataFrame, str], None]


def parquet_target(folder: str, partition_by: dict[str, list[str]] | None = None) -> Target:
    """Each table replaces its parquet folder; some are partitioned."""

    def write(df: DataFrame, table: str) -> None:
        writer = df.write.mode("overwrite")
        if partition_by and table in partition_by:
            writer = writer.partitionBy(*partition_by[table])
        writer.parquet(f"{folder}/{table}")

    return write


def jdbc_target(url: str, batch_size: int = 1000, **options: str) -> Target:
    """Each table is truncated and refilled by parallel batched inserts."""

    def write(df: DataFrame, table: str) -> None:
        (
            df.write.format("jdbc")
            .options(url=url, dbtable=table, batchsize=str(batch_size), truncate="true", **options)
            .mode("overwrite")
            .save()
        )

    return write


def serving_tables(domain: Domain) -> dict[str, DataFrame]:
    """The tables the serving store holds."""
    return {
        "agencies": domain.stored_agencies().select(
            "slug",
            "name",
            "short_name",
            "parent_slug",
            F.col("cfr_reference_count").alias("total_cfr_references"),
            "child_count",
            "checksum",
        ),
        "corrections": domain.stored_corrections(),
        "agency_metrics": marts.serving_metrics(domain).select(
            F.col("slug").alias("agency_slug"),
            "total_corrections",
            "years_with_corrections",
            "first_correction_year",
            "last_correction_year",
            "avg_correction_lag_days",
            "rvi",
            "word_count_estimate",
        ),
        "correction_time_series": marts.time_series_monthly(domain.corrections),
        "cfr_title_stats": marts.trends_by_title(domain.corrections),
    }


def transfer(
    spark: SparkSession, domain: Domain, target: Target, log_path: str, source: str = "lake"
) -> dict[str, int]:
    """Replace all serving tables and the table checksums, then log the run.

    Corrections feed four of the tables, so they are written once first.  A
    failure is logged with the rows moved so far and raised again.
    """
    started, moved = time.time(), {}
    try:
        kept = domain.with_(corrections=materialize(domain.corrections))
        for name, df in serving_tables(kept).items():
            seen = Observation(name)
            target(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
            moved[name] = seen.get["rows"]
        digests = table_digest(kept.stored_agencies(), "agencies").unionByName(
            table_digest(kept.stored_corrections(), "corrections")
        )
        target(digests, "data_checksums")
    except Exception as error:
        log_etl_run(spark, log_path, source, sum(moved.values()), "failed", str(error), started)
        raise
    log_etl_run(spark, log_path, source, sum(moved.values()), "success", None, started)
    return moved


def log_etl_run(
    spark: SparkSession,
    path: str,
    source: str,
    records: int,
    status: str,
    error: str | None,
    started: float,
) -> None:
    row = (datetime.now(), source, records, status, error, int(time.time() - started))
    spark.createDataFrame([row], ETL_LOG).write.mode("append").parquet(path)


def append_audit(spark: SparkSession, path: str, rows: Iterable[tuple]) -> None:
    """Append audit rows; existing rows are never rewritten."""
    spark.createDataFrame(list(rows), AUDIT_LOG).write.mode("append").parquet(path)


def export_json(domain: Domain, folder: str, metric_date: date) -> None:
    """The four export views and the summary lists as JSON records."""
    exports = {
        "agencies": reports.export_agencies(domain),
        "corrections": reports.export_corrections(domain.corrections),
        "agency_metrics": reports.export_agency_metrics(domain, metric_date),
        "time_series": marts.time_series_monthly(domain.corrections),
        "summary_overview": marts.summary_overview(domain),
        "summary_top_by_corrections": reports.agency_metrics_top(domain, 10),
        "summary_top_by_rvi": reports.top_rvi_lake(domain, 10),
        "summary_yearly_trends": marts.trends_yearly(domain.corrections),
        "summary_top_titles": reports.top_titles(domain.corrections, 10),
    }
    for name, df in exports.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def export_csv(df: DataFrame, folder: str, table_name: str) -> None:
    """A table as CSV with its data dictionary beside it."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{table_name}")
    dictionary = data_dictionary(df, table_name)
    dictionary.write.mode("overwrite").option("header", True).csv(f"{folder}/{table_name}_dictionary")
