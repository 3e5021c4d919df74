"""Stored copies of the domain tables with known faults, for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def landed_corrections(corrections: DataFrame) -> DataFrame:
    """Corrections with a stored checksum and lag; some of them are damaged."""
    key = F.col("ecfr_id")
    stored = (
        F.when(key % 997 == 0, None)
        .when(key % 991 == 1, F.upper("checksum"))
        .when(key % 89 == 3, F.reverse("checksum"))
        .otherwise(F.col("checksum"))
    )
    lag = F.when(key % 83 == 2, F.col("lag_days") + 1).otherwise(F.col("lag_days"))
    return corrections.withColumn("stored_checksum", stored).withColumn("stored_lag", lag)


def serving_agencies(agencies: DataFrame) -> DataFrame:
    """Agencies as served; some parents and some children did not arrive."""
    arrived = F.when(F.col("parent_slug").isNull(), (F.col("id") - 1) % 12 != 11).otherwise(
        (F.col("id") - 1_000_000) % 17 != 4
    )
    return agencies.filter(arrived)
