"""Metrics, trends and footprint marts over the parsed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgauge.session import materialize
from lexgauge.sources.domain import Domain, reference_words

AGENCY_METRICS = [
    "slug",
    "name",
    "short_name",
    "parent_slug",
    "cfr_reference_count",
    "child_count",
    "total_corrections",
    "years_with_corrections",
    "first_correction_year",
    "last_correction_year",
    "avg_correction_lag_days",
    "rvi",
]


def title_activity(corrections: DataFrame) -> DataFrame:
    """Per title: corrections, lag sums and the years they fall in."""
    return corrections.groupBy("title").agg(
        F.count("*").alias("corrections"),
        F.sum("lag_days").alias("lag_sum"),
        F.count("lag_days").alias("lag_count"),
        F.collect_set("year").alias("years"),
    )


def metrics_mart(domain: Domain) -> DataFrame:
    """Agency metrics, volatility index and estimated words in one pass.

    A correction counts for every agency that refers to its title.  Because
    ``ecfr_id`` is unique, corrections are summed per title first and the
    many-to-many join only meets titles; references collapse to (agency,
    title) before they are shuffled.  The title table is written first, so
    that the planner knows its size and broadcasts it only if it is small.
    """
    by_title = domain.references.groupBy("agency_slug", "title").agg(
        F.count("*").alias("references"), F.sum(reference_words()).alias("words")
    )
    per_agency = (
        by_title.join(materialize(title_activity(domain.corrections)), "title", "left")
        .groupBy(F.col("agency_slug").alias("slug"))
        .agg(
            F.sum("references").alias("references"),
            F.sum("words").alias("words"),
            F.sum("corrections").alias("corrections"),
            F.sum("lag_sum").alias("lag_sum"),
            F.sum("lag_count").alias("lag_count"),
            F.array_distinct(F.flatten(F.collect_set("years"))).alias("years"),
        )
    )
    total = F.coalesce("corrections", F.lit(0)).cast("bigint")
    return (
        domain.agencies.select("slug", "name", "short_name", "parent_slug", "child_count")
        .join(per_agency, "slug", "left")
        .select(
            "slug",
            "name",
            "short_name",
            "parent_slug",
            F.coalesce("references", F.lit(0)).cast("bigint").alias("cfr_reference_count"),
            "child_count",
            total.alias("total_corrections"),
            F.coalesce(F.array_size("years"), F.lit(0)).cast("bigint").alias("years_with_corrections"),
            F.array_min("years").alias("first_correction_year"),
            F.array_max("years").alias("last_correction_year"),
            F.when(F.col("lag_count") > 0, F.col("lag_sum") / F.col("lag_count")).alias(
                "avg_correction_lag_days"
            ),
            F.when(
                (F.col("references") > 0) & (F.col("corrections") > 0),
                F.round(F.col("corrections").cast("double") / F.col("references") * 100, 2),
            )
            .otherwise(F.lit(0.0))
            .alias("rvi"),
            F.coalesce("words", F.lit(0)).cast("bigint").alias("word_count_estimate"),
        )
    )


def serving_metrics(domain: Domain) -> DataFrame:
    """The mart as stored for serving: lag and index kept to two places."""
    return metrics_mart(domain).withColumn(
        "avg_correction_lag_days", F.round("avg_correction_lag_days", 2)
    )


def agency_metrics(domain: Domain) -> DataFrame:
    return metrics_mart(domain).select(
        *[c for c in AGENCY_METRICS if c != "avg_correction_lag_days"],
        F.round("avg_correction_lag_days", 6).alias("avg_correction_lag_days"),
    )


def word_count_estimate(references: DataFrame) -> DataFrame:
    return references.groupBy("agency_slug").agg(
        F.sum(reference_words()).cast("bigint").alias("word_count")
    )


def trends_yearly(corrections: DataFrame) -> DataFrame:
    """Per year over closed corrections only; the average weighs every row."""
    return (
        corrections.filter(F.col("lag_days").isNotNull())
        .groupBy("year", "title")
        .agg(
            F.count("*").alias("n"),
            F.sum("lag_days").alias("lag_sum"),
            F.min("lag_days").alias("lag_min"),
            F.max("lag_days").alias("lag_max"),
        )
        .groupBy("year")
        .agg(
            F.sum("n").alias("correction_count"),
            F.count("*").alias("unique_titles"),
            F.round(F.sum("lag_sum") / F.sum("n"), 1).alias("avg_lag_days"),
            F.min("lag_min").alias("min_lag_days"),
            F.max("lag_max").alias("max_lag_days"),
        )
        .orderBy("year")
    )


def trends_by_title(corrections: DataFrame, places: int = 2) -> DataFrame:
    """Per title over all corrections, open ones included."""
    return title_activity(corrections).select(
        "title",
        F.col("corrections").alias("correction_count"),
        F.array_size("years").cast("bigint").alias("years_active"),
        F.array_min("years").alias("first_year"),
        F.array_max("years").alias("last_year"),
        F.round(F.when(F.col("lag_count") > 0, F.col("lag_sum") / F.col("lag_count")), places).alias(
            "avg_lag_days"
        ),
    )


def time_series_monthly(corrections: DataFrame, year: int | None = None, places: int = 2) -> DataFrame:
    """Closed corrections by their own year and the month they were closed."""
    rows = corrections.filter(F.col("error_corrected").isNotNull())
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    return (
        rows.groupBy("year", F.month("error_corrected").alias("month"))
        .agg(
            F.count("*").alias("correction_count"),
            F.round(F.avg("lag_days"), places).alias("avg_lag_days"),
        )
        .orderBy("year", "month")
    )


def trends_yearly_serving(corrections: DataFrame) -> DataFrame:
    """Per year from the stored monthly series: the plain mean of months."""
    return (
        time_series_monthly(corrections)
        .groupBy("year")
        .agg(
            F.sum("correction_count").alias("total_corrections"),
            F.round(F.avg(F.col("avg_lag_days").cast("decimal(10,2)")), 4)
            .cast("double")
            .alias("avg_lag_days"),
        )
        .orderBy("year")
    )


def latest_years(corrections: DataFrame, years: int = 5) -> DataFrame:
    """The newest years of the trend, as the load report lists them."""
    newest = trends_yearly(corrections).orderBy(F.desc("year")).limit(years)
    return newest.select("year", "correction_count", "avg_lag_days")


def trends_total(corrections: DataFrame) -> DataFrame:
    """The sum of the yearly totals and the number of years."""
    return trends_yearly_serving(corrections).agg(
        F.sum("total_corrections").alias("total_corrections"), F.count("*").alias("years")
    )


def summary_overview(domain: Domain) -> DataFrame:
    facts = domain.corrections.agg(
        F.count("*").alias("total_corrections"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    return facts.select(
        domain.agencies.agg(F.count("*")).scalar().alias("total_agencies"),
        "total_corrections",
        domain.references.agg(F.count("*")).scalar().alias("total_cfr_references"),
        "first_year",
        "last_year",
    )


def agency_year_matrix(domain: Domain) -> DataFrame:
    """Corrections per agency and year, long form."""
    titles = domain.references.select("agency_slug", "title").distinct()
    yearly = materialize(domain.corrections.groupBy("title", "year").agg(F.count("*").alias("n")))
    return (
        titles.join(yearly, "title")
        .groupBy("agency_slug", "year")
        .agg(F.sum("n").alias("correction_count"))
    )


def agency_years(domain: Domain, slug: str) -> DataFrame:
    """One agency's corrections per year."""
    one = domain.with_(references=domain.references.filter(F.col("agency_slug") == slug))
    return agency_year_matrix(one).select("year", "correction_count")


def lag_histogram(corrections: DataFrame, width: int = 30) -> DataFrame:
    """Closed corrections in ``width``-day lag classes."""
    low = (F.floor(F.col("lag_days") / width) * width).cast("int")
    return (
        corrections.filter(F.col("lag_days").isNotNull())
        .groupBy(low.alias("lag_from"))
        .agg(F.count("*").alias("correction_count"))
        .withColumn("lag_to", F.col("lag_from") + width - 1)
        .orderBy("lag_from")
    )


def hierarchy_totals(domain: Domain) -> DataFrame:
    """Own and children's corrections per top-level agency."""
    metrics = metrics_mart(domain).select(
        F.coalesce("parent_slug", "slug").alias("root_slug"),
        F.col("parent_slug").isNull().alias("is_root"),
        "total_corrections",
    )
    return metrics.groupBy("root_slug").agg(
        F.sum(F.when(F.col("is_root"), F.col("total_corrections")).otherwise(0)).alias("own_corrections"),
        F.sum(F.when(F.col("is_root"), 0).otherwise(F.col("total_corrections"))).alias(
            "child_corrections"
        ),
        F.count(F.when(~F.col("is_root"), 1)).alias("children"),
    )
