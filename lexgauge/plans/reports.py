"""Reports over the marts: lists, top lists, pages and the scorecard.

Lists with a limit end in the natural key as last sort column, so ties have a
fixed order.  ``None`` for a filter means the filter is absent.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.ordering import with_ranks, with_row_number
from lexgauge.plans import marts
from lexgauge.session import materialize
from lexgauge.sources.domain import Domain, with_correction_checksum, with_reference_counts

# Row caps of the top lists, report weights in percent, grades.
VIEW_CAP = 50
RECENT_CAP = 100
SCORE_WEIGHTS = {"corrections": 30, "rvi": 25, "size": 20, "responsiveness": 25}
GRADES = [(20, "A"), (40, "B"), (60, "C"), (80, "D")]
LAST_GRADE = "F"
BADGES = [(20, "Top 20%"), (40, "Top 40%"), (60, "Middle"), (80, "Bottom 40%")]
LAST_BADGE = "Bottom 20%"

CORRECTION_COLUMNS = [
    "ecfr_id",
    "cfr_reference",
    "title",
    "corrective_action",
    "error_occurred",
    "error_corrected",
    "lag_days",
    "year",
]

AGENCY_SORTS = {"name": "name", "references": "total_cfr_references", "children": "child_count"}


def _stored_agencies(domain: Domain) -> DataFrame:
    return with_reference_counts(domain.agencies, domain.references).select(
        "slug",
        "name",
        "short_name",
        "parent_slug",
        F.col("cfr_reference_count").alias("total_cfr_references"),
        "child_count",
    )


# -- agencies ---------------------------------------------------------------


def stats(domain: Domain) -> DataFrame:
    overview = marts.summary_overview(domain)
    return overview.select("total_agencies", "total_corrections", "first_year", "last_year")


def agencies_page(domain: Domain, limit: int = 100, offset: int = 0) -> DataFrame:
    return (
        _stored_agencies(domain)
        .select("slug", "name", "short_name", "total_cfr_references", "child_count")
        .orderBy("name", "slug")
        .offset(offset)
        .limit(limit)
    )


def agencies_after(domain: Domain, name: str, slug: str, limit: int = 100) -> DataFrame:
    """The page after a known last row: a key range instead of a deep offset."""
    after = (F.col("name") > name) | ((F.col("name") == name) & (F.col("slug") > slug))
    return (
        _stored_agencies(domain)
        .select("slug", "name", "short_name", "total_cfr_references", "child_count")
        .filter(after)
        .orderBy("name", "slug")
        .limit(limit)
    )


def agencies_sorted(
    domain: Domain, sort: str = "name", descending: bool = False, search: str | None = None
) -> DataFrame:
    """All agencies by a chosen column, optionally those matching a search."""
    if sort not in AGENCY_SORTS:
        raise ValueError(f"sort must be one of {sorted(AGENCY_SORTS)}")
    rows = _stored_agencies(domain)
    if search:
        rows = rows.filter(matches(search, "name", "short_name"))
    column = F.col(AGENCY_SORTS[sort])
    return rows.orderBy(column.desc() if descending else column.asc(), "slug")


def agency_detail(domain: Domain, slug: str) -> DataFrame:
    """One agency with its metrics; empty when there is no such agency."""
    one = domain.with_(
        agencies=domain.agencies.filter(F.col("slug") == slug),
        references=domain.references.filter(F.col("agency_slug") == slug),
    )
    return marts.serving_metrics(one).select(
        "slug",
        "name",
        "short_name",
        "parent_slug",
        F.col("cfr_reference_count").alias("total_cfr_references"),
        "child_count",
        "total_corrections",
        "rvi",
        F.col("avg_correction_lag_days").alias("avg_lag_days"),
        "first_correction_year",
        "last_correction_year",
    )


def agency_hierarchy(domain: Domain) -> DataFrame:
    child = _stored_agencies(domain)
    parent = domain.agencies.select(
        F.col("slug").alias("parent_slug"), F.col("name").alias("parent_name")
    )
    return (
        child.join(parent, "parent_slug")
        .select(
            "parent_slug",
            "parent_name",
            F.col("slug").alias("child_slug"),
            F.col("name").alias("child_name"),
            F.col("total_cfr_references").alias("child_cfr_refs"),
        )
        .orderBy("parent_name", "child_name", "child_slug")
    )


def agency_metrics_top(domain: Domain, limit: int | None = None) -> DataFrame:
    ranked = (
        marts.metrics_mart(domain)
        .select(*marts.AGENCY_METRICS)
        .withColumn("avg_correction_lag_days", F.round("avg_correction_lag_days", 1))
        .orderBy(F.desc("total_corrections"), "slug")
    )
    return ranked if limit is None else ranked.limit(limit)


def top_rvi_lake(domain: Domain, limit: int = 20) -> DataFrame:
    """Highest index among agencies with corrections, straight from the lake."""
    return (
        marts.metrics_mart(domain)
        .filter("total_corrections > 0")
        .select("slug", "name", "short_name", "total_corrections", "cfr_reference_count", "rvi")
        .orderBy(F.desc("rvi"), "slug")
        .limit(limit)
    )


def _top(domain: Domain, measure: str, limit: int, cap: int | None) -> DataFrame:
    limit = limit if cap is None else min(limit, cap)
    return (
        marts.serving_metrics(domain)
        .filter(F.col(measure) > 0)
        .select(
            "slug",
            "name",
            "short_name",
            "total_corrections",
            "rvi",
            F.col("cfr_reference_count").alias("total_cfr_references"),
        )
        .orderBy(F.desc(measure), "slug")
        .limit(limit)
    )


def top_by_corrections(domain: Domain, limit: int = 20, cap: int | None = VIEW_CAP) -> DataFrame:
    """Most corrected agencies: the first min(limit, cap), as the view ends there; ``cap=None`` has no end."""
    return _top(domain, "total_corrections", limit, cap)


def top_by_rvi(domain: Domain, limit: int = 20, cap: int | None = VIEW_CAP) -> DataFrame:
    """Highest index: the first min(limit, cap), as the view ends there; ``cap=None`` has no end."""
    return _top(domain, "rvi", limit, cap)


# -- corrections ------------------------------------------------------------


def matches(term: str, *columns: str) -> Column:
    """Case-insensitive substring match in any of the columns."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))
    return hit


def corrections_list(
    corrections: DataFrame,
    year: int | None = None,
    title: int | None = None,
    occurred_from: date | None = None,
    occurred_to: date | None = None,
    min_lag: int | None = None,
    search: str | None = None,
    limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    """Corrections by year and closing date, newest first, open ones last."""
    rows = corrections.select(*CORRECTION_COLUMNS)
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    if title is not None:
        rows = rows.filter(F.col("title") == title)
    if occurred_from is not None:
        rows = rows.filter(F.col("error_occurred") >= F.lit(occurred_from))
    if occurred_to is not None:
        rows = rows.filter(F.col("error_occurred") <= F.lit(occurred_to))
    if min_lag is not None:
        rows = rows.filter(F.col("lag_days") >= min_lag)
    if search:
        rows = rows.filter(matches(search, "cfr_reference", "corrective_action"))
    ordered = rows.orderBy(F.desc("year"), F.desc_nulls_last("error_corrected"), "ecfr_id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def recent_corrections(corrections: DataFrame, limit: int = RECENT_CAP) -> DataFrame:
    return (
        corrections.select(*CORRECTION_COLUMNS)
        .orderBy(F.desc_nulls_last("error_corrected"), F.desc("year"), "ecfr_id")
        .limit(limit)
    )


def corrections_for_agency(domain: Domain, slug: str, limit: int = 100) -> DataFrame:
    titles = domain.references.filter(F.col("agency_slug") == slug).select("title").distinct()
    # Written first: with its size known, the corrections need no shuffle.
    titles = materialize(titles)
    return (
        domain.corrections.select(*CORRECTION_COLUMNS)
        .join(titles, "title", "left_semi")
        .orderBy(F.desc("year"), F.desc_nulls_last("error_corrected"), "ecfr_id")
        .limit(limit)
        .select(*CORRECTION_COLUMNS)
    )


def top_titles(corrections: DataFrame, limit: int = 20) -> DataFrame:
    return (
        marts.trends_by_title(corrections)
        .orderBy(F.desc("correction_count"), "title")
        .limit(limit)
    )


# -- footprint and scorecard ------------------------------------------------


def word_count_report(domain: Domain) -> DataFrame:
    return (
        marts.serving_metrics(domain)
        .filter("word_count_estimate > 0")
        .select(
            "slug",
            "name",
            "short_name",
            "word_count_estimate",
            "total_corrections",
            "rvi",
            F.col("cfr_reference_count").alias("total_cfr_references"),
        )
        .orderBy(F.desc("word_count_estimate"), "slug")
    )


def word_count_summary(domain: Domain) -> DataFrame:
    """Totals shown above the word-count list."""
    words = marts.word_count_estimate(domain.references).filter("word_count > 0")
    return words.agg(
        F.count("*").alias("agencies"),
        F.sum("word_count").alias("total_words"),
        F.round(F.sum("word_count") / F.count("*")).cast("bigint").alias("average_words"),
    )


def _by_percent(rank: Column, total: Column, steps: list[tuple[int, str]], last: str) -> Column:
    label = F.when(F.lit(False), F.lit(last))
    for percent, name in steps:
        label = label.when(rank * 100 <= total * percent, F.lit(name))
    return label.otherwise(F.lit(last))


def _ranked(domain: Domain) -> DataFrame:
    rows = materialize(
        marts.serving_metrics(domain).filter("total_corrections > 0").select(
            "slug",
            "name",
            "short_name",
            "total_corrections",
            "rvi",
            "word_count_estimate",
            "avg_correction_lag_days",
            F.col("cfr_reference_count").alias("total_cfr_references"),
        )
    )
    return with_ranks(
        rows,
        {
            "corrections_rank": -F.col("total_corrections"),
            "rvi_rank": -F.col("rvi"),
            "size_rank": -F.col("word_count_estimate"),
            "responsiveness_rank": F.col("avg_correction_lag_days"),
        },
        total="total_agencies",
    )


def _score(weights: dict[str, int]) -> Column:
    # Whole-number weights keep the sum exact until the one division.
    points = sum((F.col(f"{name}_rank") * weight for name, weight in weights.items()), F.lit(0))
    return F.round(points / F.col("total_agencies"), 2)


def scorecard(domain: Domain, weights: dict[str, int] | None = None) -> DataFrame:
    """Four ranks, their weighted score in percent, and an activity grade."""
    return (
        _ranked(domain)
        .withColumn("composite_score", _score(weights or SCORE_WEIGHTS))
        .withColumn(
            "activity_grade",
            _by_percent(F.col("corrections_rank"), F.col("total_agencies"), GRADES, LAST_GRADE),
        )
        .drop("total_agencies")
        .orderBy(F.desc("composite_score"), "slug")
    )


def scorecard_badges(domain: Domain) -> DataFrame:
    """The percentile label of every rank."""
    names = list(SCORE_WEIGHTS)
    return _ranked(domain).select(
        "slug",
        *[
            _by_percent(F.col(f"{n}_rank"), F.col("total_agencies"), BADGES, LAST_BADGE).alias(
                f"{n}_badge"
            )
            for n in names
        ],
    )


def scorecard_change(before: Domain, after: Domain, weights: dict[str, int]) -> DataFrame:
    """Scores of two points in time under chosen weights, and their change."""
    old = scorecard(before, weights).select("slug", F.col("composite_score").alias("score_before"))
    new = scorecard(after, weights).select("slug", F.col("composite_score").alias("score_after"))
    return old.join(new, "slug", "full_outer").select(
        "slug",
        "score_before",
        "score_after",
        F.round(F.col("score_after") - F.col("score_before"), 2).alias("score_change"),
    )


# -- export views -----------------------------------------------------------


def export_agencies(domain: Domain) -> DataFrame:
    return with_row_number(
        domain.stored_agencies().select(
            "slug",
            "name",
            "short_name",
            "parent_slug",
            F.col("cfr_reference_count").alias("total_cfr_references"),
            "checksum",
        ),
        ["slug"],
        "id",
    )


def export_corrections(corrections: DataFrame) -> DataFrame:
    return with_row_number(
        with_correction_checksum(corrections).select(*CORRECTION_COLUMNS, "checksum"),
        ["ecfr_id"],
        "id",
    )


def export_agency_metrics(domain: Domain, metric_date: date) -> DataFrame:
    """Metrics as exported, with the real word count in place of a constant."""
    return with_row_number(
        marts.metrics_mart(domain).select(
            F.col("slug").alias("agency_slug"),
            F.lit(metric_date).alias("metric_date"),
            F.col("word_count_estimate").alias("word_count"),
            F.col("total_corrections").alias("correction_count"),
            "rvi",
        ),
        ["agency_slug"],
        "id",
    )
