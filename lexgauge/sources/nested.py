"""Nested agency and correction records derived row by row from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.sources.tables import read_table


def _reference(title: Column, chapter: Column, part: Column) -> Column:
    return F.struct(
        title.cast("int").alias("title"),
        chapter.cast("string").alias("chapter"),
        F.lit(None).cast("string").alias("subtitle"),
        part.cast("string").alias("part"),
    )


def nested_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier: zero to two references, zero to two offices."""
    key = F.col("s_suppkey")
    none = F.lit(None)
    first = _reference(key % 50 + 1, F.lit("I"), none)
    second = _reference(key * 7 % 50 + 1, F.lit("II"), key % 900)
    office = [
        F.struct(
            F.concat("s_name", F.lit(f" office {n}")).alias("name"),
            F.lit(None).cast("string").alias("short_name"),
            F.concat(F.lit("supplier-"), key, F.lit(f"-office-{n}")).alias("slug"),
            F.array(_reference(key * n % 50 + 1, none, none)).alias("cfr_references"),
        )
        for n in (1, 2)
    ]
    return read_table(spark, sf_dir, "supplier").select(
        F.struct(
            F.col("s_name").alias("name"),
            F.when(key % 4 == 0, F.concat(F.lit("S"), key)).alias("short_name"),
            F.concat(F.lit("supplier-"), key).alias("slug"),
            F.when(key % 10 == 3, F.array().cast(f"array<{_REFERENCE}>"))
            .when(key % 10 != 4, F.when(key % 2 == 0, F.array(first)).otherwise(F.array(first, second)))
            .alias("cfr_references"),
            F.when(key % 3 == 1, F.array(office[0])).when(key % 3 == 2, F.array(*office)).alias("children"),
        ).alias("agency")
    )


_REFERENCE = "struct<title:int,chapter:string,subtitle:string,part:string>"


def nested_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order, with missing, malformed and early dates."""
    key = F.col("o_orderkey")
    title = key % 50 + 1

    def reference(offset: int) -> Column:
        part = key % 900 + offset
        return F.struct(
            F.concat(title, F.lit(" CFR "), part).alias("cfr_reference"),
            F.struct(
                F.concat(F.lit("ch-"), key % 9).alias("chapter"),
                part.cast("string").alias("part"),
                F.when(key % 5 == 0, F.concat(part, F.lit(".1"))).alias("section"),
            ).alias("hierarchy"),
        )

    occurred = F.col("o_orderdate").cast("date")
    corrected = F.date_add(occurred, (key % 400 - 20).cast("int"))
    return read_table(spark, sf_dir, "orders").select(
        F.struct(
            key.alias("id"),
            title.cast("int").alias("title"),
            F.year(occurred).alias("year"),
            F.when(key % 11 == 5, F.array(reference(1)).cast(f"array<{_CORRECTION_REFERENCE}>"))
            .when(key % 11 == 6, F.array().cast(f"array<{_CORRECTION_REFERENCE}>"))
            .when(key % 11 != 7, F.array(reference(1), reference(2)))
            .alias("cfr_references"),
            F.concat(F.lit("Amended: "), "o_orderpriority").alias("corrective_action"),
            F.when(key % 19 != 2, occurred.cast("string")).alias("error_occurred"),
            F.when(key % 23 == 4, F.lit("not a date"))
            .when(key % 7 != 3, corrected.cast("string"))
            .alias("error_corrected"),
            F.concat(F.year(occurred), F.lit(" FR "), "o_custkey").alias("fr_citation"),
        ).alias("correction")
    )


_CORRECTION_REFERENCE = (
    "struct<cfr_reference:string,hierarchy:struct<chapter:string,part:string,section:string>>"
)
