"""Run ledger and privacy staging rows derived from the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.operators.contracts import CLASSIFICATIONS
from lexgauge.sources.tables import read_table

TENANTS = 25
RETENTION_CHOICES = [0, 7, 14, 21, 2555]
EVENT_NAMES = ["click", "view", "purchase", "signup", "error"]


def _tenant(user: Column) -> Column:
    return F.concat(F.lit("nation-"), user % TENANTS)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user, one tenant per nation."""
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), "user_id").alias("run_id"),
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("event_name"),
        F.col("props").alias("event_data"),
        _tenant(F.col("user_id")).alias("agency_id"),
    )


def saves_of(events: DataFrame) -> DataFrame:
    """Every event saves its run's checkpoint."""
    user = F.col("user_id")
    return events.select(
        F.concat(F.lit("run-"), user).alias("run_id"),
        F.col("event_id").alias("save_id"),
        F.col("ts").alias("saved_at"),
        _tenant(user).alias("agency_id"),
        F.concat(F.lit("provider-"), user % 3).alias("provider_name"),
        F.concat(F.lit("model-"), user % 4).alias("model"),
        F.upper("event_type").alias("status"),
        F.col("props").alias("payload"),
        F.col("event_type").alias("last_step"),
    )


def checkpoint_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saves_of(read_table(spark, sf_dir, "events"))


def tampered(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints of which every tenth run's stored hash was altered."""
    user = F.substring_index("run_id", "-", -1).cast("bigint")
    return checkpoints.withColumn(
        "checkpoint_hash",
        F.when(user % 10 == 3, F.reverse("checkpoint_hash")).otherwise(F.col("checkpoint_hash")),
    )


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint per event row, holding a list of one to four events."""
    names = F.array(*[F.lit(n) for n in EVENT_NAMES])
    key = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        key.alias("checkpoint_id"),
        F.transform(
            F.sequence(F.lit(0), (key % 4).cast("int")),
            lambda i: F.struct(
                (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), i)).alias("timestamp"),
                F.get(names, ((key + i) % len(EVENT_NAMES)).cast("int")).alias("event_name"),
            ),
        ).alias("events"),
    )


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(*[F.lit(r) for r in ("admin", "operator", "viewer", "analyzer", "guest")])
    user = F.col("user_id")
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.get(roles, (user % 5).cast("int")).alias("role"),
        F.concat(F.lit("nation-"), user % 3).alias("user_agency_id"),
        F.concat(F.lit("nation-"), F.col("event_id") % 3).alias("agency_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("service-"), user % 3).alias("service"),
        F.col("event_type").alias("status"),
        _tenant(user).alias("agency_id"),
        (F.col("value") / 100).alias("duration_seconds"),
    )


def staging_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before the privacy pass, with names, numbers and free text."""
    user, key = F.col("user_id"), F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(key % 41 != 0, F.concat(F.lit("person "), user)).alias("raw_name"),
        F.concat(F.lit("900-"), user).alias("raw_ssn"),
        F.when(key % 50 != 0, F.floor("value").cast("int")).alias("age"),
        F.col("ts").alias("encounter_ts"),
        F.col("props").alias("clinician_notes"),
        "event_type",
    )


def tenant_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification and retention per tenant."""
    n = F.col("n_nationkey")
    labels = F.array(*[F.lit(c) for c in CLASSIFICATIONS])
    days = F.array(*[F.lit(d) for d in RETENTION_CHOICES])
    return read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), n).alias("agency_id"),
        F.get(labels, n % len(CLASSIFICATIONS)).alias("data_classification"),
        F.get(days, n % len(RETENTION_CHOICES)).alias("retention_days"),
    )
