"""Comparison of two points in time by key and checksum."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.plans.marts import word_count_estimate
from lexgauge.sources.domain import Domain

CUT_OFF = date(2000, 7, 1)


def _one_per_key(df: DataFrame, key: str, columns: list[str], side: str) -> DataFrame:
    """Fold copies of a key into one row, whose checksum stands for all of them.

    Keys should be unique, and then nothing changes.  Were they not, a join
    would pair all copies of a key with all of its copies on the other side.
    """
    bits = F.xxhash64("checksum")
    folded = df.groupBy(key).agg(
        F.count("*").alias("_copies"),
        F.min("checksum").alias("_least"),
        F.max("checksum").alias("_most"),
        F.sum(bits.bitwiseAND(F.lit(0xFFFFFFF))).alias("_low"),
        F.sum(F.shiftrightunsigned(bits, 36)).alias("_high"),
        *[F.max(c).alias(f"{side}_{c}") for c in columns],
    )
    several = F.concat_ws(":", "_copies", "_least", "_most", "_low", "_high")
    return folded.select(
        key,
        F.when(F.col("_copies") == 1, F.col("_most")).otherwise(several).alias(f"{side}_checksum"),
        F.lit(True).alias(f"{side}_present"),
        *[f"{side}_{c}" for c in columns],
    )


def _joined(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return _one_per_key(old, key, columns, "old").join(
        _one_per_key(new, key, columns, "new"), key, "full_outer"
    )


def _change() -> Column:
    return (
        F.when(F.col("old_present").isNull(), "added")
        .when(F.col("new_present").isNull(), "removed")
        .when(F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "same")
        .otherwise("changed")
    )


def snapshot_diff(
    old: DataFrame, new: DataFrame, key: str, checksum: str = "checksum", include_same: bool = False
) -> DataFrame:
    """Which keys were added, removed or changed between two snapshots."""
    old = old.withColumnRenamed(checksum, "checksum")
    new = new.withColumnRenamed(checksum, "checksum")
    rows = _joined(old, new, key, []).select(key, "old_checksum", "new_checksum", _change().alias("change"))
    return rows if include_same else rows.filter("change != 'same'")


def impact_score(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per title: growth, amendment frequency and checksum variance, averaged.

    The three parts are named together as one score; their formulas are ours:
    net growth, changed rows and all differing rows, each as a share.  A title
    that only the later snapshot has is kept, without growth, frequency and score.
    """
    rows = _joined(old, new, "ecfr_id", ["title"]).select(
        F.coalesce("new_title", "old_title").alias("title"), _change().alias("change")
    )

    def tally(*changes: str) -> Column:
        return F.count_if(F.col("change").isin(*changes))

    counted = rows.groupBy("title").agg(
        tally("removed", "changed", "same").alias("old_count"),
        tally("added", "changed", "same").alias("new_count"),
        tally("changed").alias("changed_count"),
        tally("added", "removed", "changed").alias("differing"),
        F.count("*").alias("all_count"),
    )
    before = F.nullif(F.col("old_count"), F.lit(0))
    growth = (F.col("new_count") - F.col("old_count")) / before
    amended = F.col("changed_count") / before
    variance = F.col("differing") / F.col("all_count")
    return counted.select(
        "title",
        "old_count",
        "new_count",
        F.round(growth, 4).alias("growth_rate"),
        F.round(amended, 4).alias("amendment_frequency"),
        F.round(variance, 4).alias("checksum_variance"),
        F.round((growth + amended + variance) / 3 * 100, 2).alias("impact_score"),
    )


def word_count_growth(old_references: DataFrame, new_references: DataFrame) -> DataFrame:
    old = word_count_estimate(old_references).withColumnRenamed("word_count", "old_words")
    new = word_count_estimate(new_references).withColumnRenamed("word_count", "new_words")
    return old.join(new, "agency_slug", "full_outer").select(
        "agency_slug",
        F.coalesce("old_words", F.lit(0)).alias("old_words"),
        F.coalesce("new_words", F.lit(0)).alias("new_words"),
        F.when(
            F.col("old_words") > 0,
            F.round((F.coalesce("new_words", F.lit(0)) - F.col("old_words")) / F.col("old_words") * 100, 2),
        ).alias("growth_percent"),
    )


def earlier(domain: Domain) -> Domain:
    """The domain as it stood at the cut-off date."""
    return domain.with_(
        corrections=domain.corrections.filter(F.col("error_occurred") < F.lit(CUT_OFF)),
        references=domain.references.filter("title % 9 != 4"),
    )


def later(domain: Domain) -> Domain:
    """The domain after it: some corrections withdrawn, some reworded."""
    action = F.when(
        F.col("ecfr_id") % 37 == 1, F.concat("corrective_action", F.lit(" (revised)"))
    ).otherwise(F.col("corrective_action"))
    return domain.with_(
        corrections=domain.corrections.filter("ecfr_id % 101 != 5").withColumn(
            "corrective_action", action
        )
    )
