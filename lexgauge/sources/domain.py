"""Agencies, references and corrections derived from the driver tables.

Nations act as parent agencies and suppliers as their children; parts are
references to regulation titles; every order with lines is one correction.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.functions.checksums import with_record_checksum
from lexgauge.sources.tables import read_table

# Estimated words per reference by how specific it is.
WORDS_PER_PART = 2_000
WORDS_PER_CHAPTER = 10_000
WORDS_PER_TITLE = 50_000


@dataclass(frozen=True)
class Domain:
    """The three parsed tables every mart and report starts from.

    Stored reference counts and checksums are added where they are asked for,
    so that other jobs do not carry them along.
    """

    agencies: DataFrame
    references: DataFrame
    corrections: DataFrame

    def with_(self, **tables: DataFrame) -> Domain:
        return replace(self, **tables)

    def stored_agencies(self) -> DataFrame:
        return with_agency_checksum(with_reference_counts(self.agencies, self.references))

    def stored_references(self) -> DataFrame:
        return with_reference_checksum(self.references)

    def stored_corrections(self) -> DataFrame:
        return with_correction_checksum(self.corrections)


def with_correction_checksum(corrections: DataFrame, out: str = "checksum") -> DataFrame:
    """SHA-256 over the eight published fields of a parsed correction."""
    reference = F.struct("cfr_reference", F.struct("chapter", "part", "section").alias("hierarchy"))
    return with_record_checksum(
        corrections,
        {
            "id": "ecfr_id",
            "cfr_references": F.array(reference),
            "corrective_action": "corrective_action",
            "error_corrected": F.col("error_corrected").cast("string"),
            "error_occurred": F.col("error_occurred").cast("string"),
            "fr_citation": "fr_citation",
            "title": "title",
            "year": "year",
        },
        out,
    )


def with_agency_checksum(agencies: DataFrame) -> DataFrame:
    """SHA-256 over a parsed agency.

    The flat table knows references and children by their counts; the nested
    source (:mod:`lexgauge.sources.json_files`) hashes them in full.
    """
    names = ["name", "short_name", "slug", "parent_slug", "cfr_reference_count", "child_count"]
    return with_record_checksum(agencies, {n: n for n in names})


def with_reference_checksum(refs: DataFrame) -> DataFrame:
    names = ["agency_slug", "title", "chapter", "subtitle", "part"]
    return with_record_checksum(refs, {n: n for n in names})


def reference_words() -> Column:
    return (
        F.when(F.col("part").isNotNull(), WORDS_PER_PART)
        .when(F.col("chapter").isNotNull(), WORDS_PER_CHAPTER)
        .otherwise(WORDS_PER_TITLE)
    )


def agency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    supplier = read_table(spark, sf_dir, "supplier")
    parents = nation.select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
        F.concat(F.lit("nation-"), "n_nationkey").alias("slug"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("N"), "n_nationkey").alias("short_name"),
        F.lit(None).cast("string").alias("parent_slug"),
    )
    children = supplier.select(
        (F.col("s_suppkey") + 1_000_000).cast("bigint").alias("id"),
        F.concat(F.lit("supplier-"), "s_suppkey").alias("slug"),
        F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("short_name"),
        F.concat(F.lit("nation-"), "s_nationkey").alias("parent_slug"),
    )
    return parents.unionByName(children)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reference of an agency to a title, chapter or part."""
    nation = read_table(spark, sf_dir, "nation")
    part = read_table(spark, sf_dir, "part")
    supplier = read_table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    titles = nation.select(
        F.concat(F.lit("nation-"), "n_nationkey").alias("agency_slug"),
        (F.col("n_nationkey") + 1).cast("int").alias("title"),
        none.alias("chapter"),
        none.alias("subtitle"),
        none.alias("part"),
    )
    owner = F.col("p_partkey") % supplier.count()
    parts = part.withColumn("owner", owner).filter("owner <> 3").select(
        F.concat(F.lit("supplier-"), "owner").alias("agency_slug"),
        F.col("p_size").alias("title"),
        F.when(F.col("p_size") % 3 != 2, F.col("p_brand")).alias("chapter"),
        none.alias("subtitle"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("part"),
    )
    return titles.unionByName(parts)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines; unshipped orders stay open.

    Lines are reduced to their order before they are shuffled (the smallest
    part and the set of shipping days), so an order with very many lines
    reaches the join as one row per map task.
    """
    orders = read_table(spark, sf_dir, "orders")
    part = read_table(spark, sf_dir, "part")
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_partkey").alias("p_partkey"),
            F.collect_set(F.col("l_shipdate").cast("date")).alias("ship_days"),
        )
    )
    occurred = F.col("o_orderdate").cast("date")
    joined = (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
        .withColumn("error_occurred", occurred)
        .withColumn("error_corrected", F.array_min(F.filter("ship_days", lambda day: day >= occurred)))
        .join(part.select("p_partkey", "p_size", "p_brand", "p_type"), "p_partkey")
    )
    return joined.select(
        F.col("o_orderkey").alias("ecfr_id"),
        F.concat(F.col("p_size"), F.lit(" CFR "), F.col("p_partkey")).alias("cfr_reference"),
        F.col("p_size").alias("title"),
        F.col("p_brand").alias("chapter"),
        F.col("p_type").alias("part"),
        F.col("p_partkey").cast("string").alias("section"),
        F.concat(F.lit("Amended: "), F.col("o_orderpriority")).alias("corrective_action"),
        "error_occurred",
        "error_corrected",
        F.date_diff("error_corrected", "error_occurred").alias("lag_days"),
        F.concat(F.year("error_occurred"), F.lit(" FR "), F.col("o_custkey")).alias("fr_citation"),
        F.year("error_occurred").alias("year"),
    )


def with_reference_counts(agencies: DataFrame, refs: DataFrame) -> DataFrame:
    counts = refs.groupBy(F.col("agency_slug").alias("slug")).agg(F.count("*").alias("_refs"))
    return (
        agencies.join(counts, "slug", "left")
        .withColumn("cfr_reference_count", F.coalesce("_refs", F.lit(0)).cast("bigint"))
        .drop("_refs")
    )


def with_child_counts(agencies: DataFrame) -> DataFrame:
    children = (
        agencies.filter(F.col("parent_slug").isNotNull())
        .groupBy(F.col("parent_slug").alias("slug"))
        .agg(F.count("*").alias("_children"))
    )
    return (
        agencies.join(children, "slug", "left")
        .withColumn("child_count", F.coalesce("_children", F.lit(0)).cast("bigint"))
        .drop("_children")
    )


def load_domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(
        agencies=with_child_counts(agency_rows(spark, sf_dir)),
        references=references(spark, sf_dir),
        corrections=corrections(spark, sf_dir),
    )
