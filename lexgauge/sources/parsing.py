"""Nested records to the parsed tables: flattening, first reference, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_FORMAT = "yyyy-M-d"


def parse_date(text: Column) -> Column:
    """A date, or NULL where the text is not one."""
    return F.try_to_timestamp(text, F.lit(DATE_FORMAT)).cast("date")


def length_or_zero(values: Column) -> Column:
    return F.coalesce(F.array_size(values), F.lit(0)).cast("bigint")


def flatten_agencies(documents: DataFrame, agency: str = "agency") -> DataFrame:
    """Parents and their children, one level, in one table."""
    parents = documents.select(
        F.col(f"{agency}.slug"),
        F.col(f"{agency}.name"),
        F.col(f"{agency}.short_name"),
        F.lit(None).cast("string").alias("parent_slug"),
        length_or_zero(F.col(f"{agency}.cfr_references")).alias("cfr_reference_count"),
        length_or_zero(F.col(f"{agency}.children")).alias("child_count"),
    )
    children = documents.select(
        F.col(f"{agency}.slug").alias("parent_slug"), F.explode(f"{agency}.children").alias("child")
    ).select(
        F.col("child.slug"),
        F.col("child.name"),
        F.col("child.short_name"),
        "parent_slug",
        length_or_zero(F.col("child.cfr_references")).alias("cfr_reference_count"),
        F.lit(0).cast("bigint").alias("child_count"),
    )
    return parents.unionByName(children)


def flatten_references(documents: DataFrame, agency: str = "agency") -> DataFrame:
    """One row per reference of a parent or child."""
    owners = documents.select(
        F.explode(
            F.concat(
                F.array(
                    F.struct(
                        F.col(f"{agency}.slug").alias("slug"),
                        F.col(f"{agency}.cfr_references").alias("refs"),
                    )
                ),
                F.coalesce(
                    F.transform(
                        f"{agency}.children",
                        lambda c: F.struct(c["slug"].alias("slug"), c["cfr_references"].alias("refs")),
                    ),
                    F.array(),
                ),
            )
        ).alias("owner")
    )
    return owners.select(
        F.col("owner.slug").alias("agency_slug"), F.explode("owner.refs").alias("ref")
    ).select("agency_slug", "ref.title", "ref.chapter", "ref.subtitle", "ref.part")


def parse_corrections(
    documents: DataFrame, correction: str = "correction", keep: list[str] | None = None
) -> DataFrame:
    """The parsed correction: first reference, real dates, lag in days."""
    first = F.get(F.col(f"{correction}.cfr_references"), F.lit(0))
    occurred = parse_date(F.col(f"{correction}.error_occurred"))
    corrected = parse_date(F.col(f"{correction}.error_corrected"))
    return documents.select(
        F.col(f"{correction}.id").alias("ecfr_id"),
        F.coalesce(first["cfr_reference"], F.lit("")).alias("cfr_reference"),
        F.col(f"{correction}.title"),
        first["hierarchy"]["chapter"].alias("chapter"),
        first["hierarchy"]["part"].alias("part"),
        first["hierarchy"]["section"].alias("section"),
        F.col(f"{correction}.corrective_action"),
        occurred.alias("error_occurred"),
        corrected.alias("error_corrected"),
        F.date_diff(corrected, occurred).alias("lag_days"),
        F.col(f"{correction}.fr_citation"),
        F.col(f"{correction}.year"),
        *(keep or []),
    )


def raw_landing(documents: DataFrame, record: str, key: str) -> DataFrame:
    """The whole record as JSON text with its key; nulls are kept."""
    return documents.select(
        F.col(f"{record}.{key}").alias("record_key"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("data"),
    ).withColumn("checksum", F.sha2("data", 256))
