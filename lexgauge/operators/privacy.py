"""Privacy pass: hashed identifiers, generalised attributes, minimum group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.checksums import table_digest, with_record_checksum
from lexgauge.session import materialize

MIN_GROUP_SIZE = 5

# What the manifest contract assumes where nothing is said.
DEFAULT_CLASSIFICATION = "U"
DEFAULT_RETENTION_DAYS = 2555


def salted_hash(value: Column, salt: str | Column) -> Column:
    """SHA-256 of salt and value; NULL stays NULL, so unknowns never link."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(salt, value), 256)


def hash_identifiers(df: DataFrame, identifiers: dict[str, str], salt: str) -> DataFrame:
    """Replace raw identifier columns by hash columns (raw name -> hash name)."""
    hashed = {new: salted_hash(F.col(raw).cast("string"), salt) for raw, new in identifiers.items()}
    return df.withColumns(hashed).drop(*identifiers)


def number_band(value: Column, width: int = 10) -> Column:
    """``30_to_39`` for 37; NULL stays NULL."""
    low = (F.floor(value / width) * width).cast("int")
    return F.concat(low, F.lit("_to_"), low + (width - 1))


def time_bucket(value: Column, unit: str = "week") -> Column:
    """The first day of the value's week or month."""
    return F.trunc(value.cast("date"), unit)


def generalize(df: DataFrame, number: str, band: str, time: str, bucket: str, unit: str = "week") -> DataFrame:
    return (
        df.withColumn(band, number_band(F.col(number)))
        .withColumn(bucket, time_bucket(F.col(time), unit))
        .drop(number, time)
    )


def suppress_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leave free-text columns out of the result."""
    return df.drop(*columns)


def _group_sizes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    known = df
    for column in quasi:
        known = known.filter(F.col(column).isNotNull())
    return known.groupBy(*quasi).agg(F.count("*").alias("group_size"))


def k_anonymous(df: DataFrame, quasi: Sequence[str], k: int = MIN_GROUP_SIZE) -> DataFrame:
    """Rows whose quasi-identifier group has at least ``k`` members.

    Rows with an unknown quasi-identifier fall out.  Group sizes are counted
    map-side and only the large enough groups meet the rows again, so a very
    large group is never gathered.  The groups are written first: with their
    size known, a short list is broadcast and the rows are not shuffled.
    """
    safe = materialize(_group_sizes(df, quasi).filter(F.col("group_size") >= k).drop("group_size"))
    return df.join(safe, list(quasi), "left_semi")


def k_violations(df: DataFrame, quasi: Sequence[str], k: int = MIN_GROUP_SIZE) -> DataFrame:
    """Groups that are too small, with their sizes."""
    return _group_sizes(df, quasi).filter(F.col("group_size") < k)


def link_tokens(df: DataFrame, identifier: str, global_salt: str, agency_salt: str) -> DataFrame:
    """One row per person token: the shared token, the agency's own, record count."""
    value = F.col("_value").cast("string")
    return (
        df.filter(F.col(identifier).isNotNull())
        .groupBy(F.col(identifier).alias("_value"))
        .agg(F.count("*").alias("records"))
        .select(
            salted_hash(value, global_salt).alias("global_hash"),
            salted_hash(value, agency_salt).alias("agency_hash"),
            "records",
        )
    )


def link(left: DataFrame, right: DataFrame, authorized: bool = False) -> DataFrame:
    """Match two agencies' tokens on the shared hash.

    Both sides hold one row per token, so a person with very many records
    still gives one pair.  Without authorization only the agencies' own hashes
    are compared, which differ by design.
    """
    token = "global_hash" if authorized else "agency_hash"

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.col(token).alias("token"),
            F.col("agency_hash").alias(f"{name}_agency_hash"),
            F.col("records").alias(f"{name}_records"),
        )

    return side(left, "left").join(side(right, "right"), "token")


def with_row_checksum(df: DataFrame) -> DataFrame:
    """A checksum over all columns: integers as numbers, the rest as text."""
    members = {
        name: F.col(name) if kind in ("int", "bigint") else F.col(name).cast("string")
        for name, kind in df.dtypes
    }
    return with_record_checksum(df, members)


def provenance(steps: Sequence[tuple[str, str, DataFrame, DataFrame]]) -> DataFrame:
    """Per step: rows in and out and the digest of what came out.

    Each step is (name, transform, input, output).
    """
    result = None
    for number, (name, transform, before, after) in enumerate(steps, start=1):
        digest = table_digest(with_row_checksum(after), name)
        row = digest.select(
            F.lit(number).alias("step_number"),
            F.lit(name).alias("step"),
            F.lit(transform).alias("transform"),
            before.agg(F.count("*")).scalar().alias("rows_in"),
            F.col("record_count").alias("rows_out"),
            F.col("aggregate_checksum").alias("digest"),
        )
        result = row if result is None else result.unionByName(row)
    return result


def in_clearance(df: DataFrame, manifests: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows of agencies whose classification label is among ``labels``.

    Agencies without a manifest, or without a label in it, have the contract's default.
    """
    label = F.coalesce("data_classification", F.lit(DEFAULT_CLASSIFICATION))
    return (
        df.join(manifests.select("agency_id", "data_classification"), "agency_id", "left")
        .withColumn("data_classification", label)
        .filter(F.col("data_classification").isin(list(labels)))
    )


def within_retention(df: DataFrame, manifests: DataFrame, time: str, as_of: Column) -> DataFrame:
    """Rows not older than their agency's retention; 0 days keeps for ever.

    Agencies without a manifest, or without a period in it, have the contract's
    default; rows without a time cannot be shown to be too old and stay.
    """
    days = F.coalesce("retention_days", F.lit(DEFAULT_RETENTION_DAYS))
    oldest = as_of - F.make_dt_interval(F.col("retention_days"))
    return (
        df.join(manifests.select("agency_id", "retention_days"), "agency_id", "left")
        .withColumn("retention_days", days)
        .filter((F.col("retention_days") == 0) | F.col(time).isNull() | (F.col(time) >= oldest))
    )
