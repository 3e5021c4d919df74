"""Integrity checks: each returns the violating rows, empty when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.checksums import CHECKSUM_PATTERN
from lexgauge.plans.marts import time_series_monthly

RVI_TOLERANCE = 0.01


def null_values(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.filter(F.col(column).isNull()).select(key)


def malformed_checksums(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.filter(~F.col(column).rlike(CHECKSUM_PATTERN)).select(key, column)


def mismatches(df: DataFrame, key: str, stored: str, computed: Column) -> DataFrame:
    """Rows whose stored value is not the recomputed one; NULL counts as a value."""
    return (
        df.select(key, F.col(stored).alias("stored"), computed.alias("computed"))
        .filter(~F.col("stored").eqNullSafe(F.col("computed")))
    )


def duplicates(df: DataFrame, keys: Sequence[str], table_name: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
        .select(
            F.lit(table_name).alias("table_name"),
            F.concat_ws("|", *keys).alias("key"),
            "copies",
        )
    )


def orphans(rows: DataFrame, foreign: str, owners: DataFrame, owner: str) -> DataFrame:
    """Rows with a foreign key that no owner carries."""
    return rows.filter(F.col(foreign).isNotNull()).join(
        owners.select(F.col(owner).alias(foreign)), foreign, "left_anti"
    )


def child_count_mismatches(agencies: DataFrame) -> DataFrame:
    """Parents whose stored child count is not the number of children present."""
    actual = (
        agencies.filter(F.col("parent_slug").isNotNull())
        .groupBy(F.col("parent_slug").alias("slug"))
        .agg(F.count("*").alias("_actual"))
    )
    return (
        agencies.filter("child_count > 0")
        .join(actual, "slug", "left")
        .select("slug", "child_count", F.coalesce("_actual", F.lit(0)).alias("actual_children"))
        .filter("child_count != actual_children")
    )


def rvi_mismatches(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Agencies whose stored index is off by the tolerance or more."""
    return (
        stored.select("slug", F.col("rvi").alias("stored_rvi"))
        .join(computed.select("slug", F.col("rvi").alias("computed_rvi")), "slug")
        .filter(F.abs(F.col("stored_rvi") - F.col("computed_rvi")) >= RVI_TOLERANCE)
    )


def series_reconciliation(corrections: DataFrame) -> DataFrame:
    """Per year the series total next to the fact count."""
    series = (
        time_series_monthly(corrections)
        .groupBy("year")
        .agg(F.sum("correction_count").alias("series_total"))
    )
    facts = corrections.groupBy("year").agg(F.count("*").alias("fact_count"))
    return facts.join(series, "year", "left").select(
        "year",
        F.coalesce("series_total", F.lit(0)).alias("series_total"),
        "fact_count",
        (F.col("fact_count") - F.coalesce("series_total", F.lit(0))).alias("difference"),
    )


def _total(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_reconciliation(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per table: rows at the source, rows at the target, whether they agree."""
    rows = [
        _total(target, "target_count").select(
            F.lit(name).alias("table_name"),
            _total(source, "source_count").scalar().alias("source_count"),
            "target_count",
        )
        for name, (source, target) in pairs.items()
    ]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result.withColumn("matches", F.col("source_count") == F.col("target_count"))


def tallies(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Several row-wise checks in one pass: one output row per check."""
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in checks.items()])
    return counted.unpivot([], [F.col(f"`{name}`") for name in checks], "check_name", "violations")


def violations(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))


def extra_copies(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many rows a unique constraint would reject."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .agg(
            F.lit(name).alias("check_name"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("violations"),
        )
    )


def empty_view(name: str, view: DataFrame) -> DataFrame:
    """One violation when the view has no row; reads at most one."""
    return view.limit(1).agg(
        F.lit(name).alias("check_name"), (F.lit(1) - F.count("*")).cast("bigint").alias("violations")
    )


def report(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one table with their status."""
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result.withColumn(
        "status", F.when(F.col("violations") == 0, "pass").otherwise("fail")
    )
