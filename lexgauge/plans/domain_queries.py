"""Registered queries over agencies, references and corrections."""

from __future__ import annotations

from datetime import date

from lexgauge.plans import marts, reports
from lexgauge.plans.registry import query
from lexgauge.plans.sql import AGENCIES, CORRECTIONS, METRICS, REFERENCES, SCORECARD, with_
from lexgauge.sources import domain as dom
from lexgauge.sources.domain import load_domain

_LIST_COLUMNS = (
    "ecfr_id, cfr_reference, title, corrective_action, error_occurred, error_corrected, lag_days, year"
)


@query(
    "agency_metrics",
    with_(METRICS)
    + """
    SELECT slug, name, short_name, parent_slug, cfr_reference_count, child_count, total_corrections,
           years_with_corrections, first_correction_year, last_correction_year,
           round(avg_lag, 6) AS avg_correction_lag_days, rvi FROM metrics""",
)
def _(spark, sf_dir):
    return marts.agency_metrics(load_domain(spark, sf_dir))


@query(
    "metrics_mart",
    with_(METRICS)
    + """
    SELECT slug, total_corrections, years_with_corrections, first_correction_year, last_correction_year,
           round(avg_lag, 2) AS avg_correction_lag_days, rvi, word_count_estimate FROM metrics""",
)
def _(spark, sf_dir):
    return marts.serving_metrics(load_domain(spark, sf_dir)).select(
        "slug",
        "total_corrections",
        "years_with_corrections",
        "first_correction_year",
        "last_correction_year",
        "avg_correction_lag_days",
        "rvi",
        "word_count_estimate",
    )


@query(
    "word_count_estimate",
    with_(REFERENCES)
    + """
    SELECT agency_slug, CAST(sum(CASE WHEN part IS NOT NULL THEN 2000
                                      WHEN chapter IS NOT NULL THEN 10000 ELSE 50000 END) AS BIGINT) AS word_count
    FROM refs GROUP BY agency_slug""",
)
def _(spark, sf_dir):
    return marts.word_count_estimate(dom.references(spark, sf_dir))


@query(
    "trends_yearly",
    with_(CORRECTIONS)
    + """
    SELECT year, count(*) AS correction_count, count(DISTINCT title) AS unique_titles,
           round(avg(lag_days), 1) AS avg_lag_days, min(lag_days) AS min_lag_days, max(lag_days) AS max_lag_days
    FROM corrections WHERE lag_days IS NOT NULL GROUP BY year""",
)
def _(spark, sf_dir):
    return marts.trends_yearly(dom.corrections(spark, sf_dir))


_BY_TITLE = """
    SELECT title, count(*) AS correction_count, count(DISTINCT year) AS years_active, min(year) AS first_year,
           max(year) AS last_year, round(avg(lag_days), 2) AS avg_lag_days
    FROM corrections GROUP BY title"""


@query("trends_by_title", with_(CORRECTIONS) + _BY_TITLE)
def _(spark, sf_dir):
    return marts.trends_by_title(dom.corrections(spark, sf_dir))


@query("top_titles", with_(CORRECTIONS) + _BY_TITLE + " ORDER BY correction_count DESC, title LIMIT 20")
def _(spark, sf_dir):
    return reports.top_titles(dom.corrections(spark, sf_dir))


_MONTHLY = """
    SELECT year, CAST(month(error_corrected) AS INTEGER) AS month, count(*) AS correction_count,
           round(avg(lag_days), 2) AS avg_lag_days
    FROM corrections WHERE error_corrected IS NOT NULL GROUP BY year, month(error_corrected)"""


@query("time_series_monthly", with_(CORRECTIONS) + _MONTHLY)
def _(spark, sf_dir):
    return marts.time_series_monthly(dom.corrections(spark, sf_dir))


@query(
    "trends_yearly_serving",
    with_(CORRECTIONS, f"series AS ({_MONTHLY})")
    + """
    SELECT year, CAST(sum(correction_count) AS BIGINT) AS total_corrections,
           round(avg(CAST(avg_lag_days AS DECIMAL(10,2))), 4) AS avg_lag_days
    FROM series GROUP BY year""",
)
def _(spark, sf_dir):
    return marts.trends_yearly_serving(dom.corrections(spark, sf_dir))


_OVERVIEW = """
    SELECT (SELECT count(*) FROM agencies) AS total_agencies, (SELECT count(*) FROM corrections) AS total_corrections,
           {refs} (SELECT min(year) FROM corrections) AS first_year, (SELECT max(year) FROM corrections) AS last_year"""


@query(
    "summary_overview",
    with_(AGENCIES, CORRECTIONS)
    + _OVERVIEW.format(refs="(SELECT count(*) FROM refs) AS total_cfr_references,"),
)
def _(spark, sf_dir):
    return marts.summary_overview(load_domain(spark, sf_dir))


@query("stats", with_(AGENCIES, CORRECTIONS) + _OVERVIEW.format(refs=""))
def _(spark, sf_dir):
    return reports.stats(load_domain(spark, sf_dir))


@query(
    "agencies_page",
    with_(AGENCIES)
    + """
    SELECT slug, name, short_name, cfr_reference_count AS total_cfr_references, child_count
    FROM agencies ORDER BY name, slug LIMIT 40 OFFSET 20""",
)
def _(spark, sf_dir):
    return reports.agencies_page(load_domain(spark, sf_dir), limit=40, offset=20)


@query(
    "agencies_page_after",
    with_(AGENCIES)
    + """
    SELECT slug, name, short_name, cfr_reference_count AS total_cfr_references, child_count
    FROM agencies WHERE name > 'NATION_5' OR (name = 'NATION_5' AND slug > 'nation-5')
    ORDER BY name, slug LIMIT 40""",
)
def _(spark, sf_dir):
    return reports.agencies_after(load_domain(spark, sf_dir), "NATION_5", "nation-5", limit=40)


@query(
    "agencies_sorted",
    with_(AGENCIES)
    + """
    SELECT slug, name, short_name, parent_slug, cfr_reference_count AS total_cfr_references, child_count
    FROM agencies WHERE contains(lower(name), 'supplier') OR contains(lower(coalesce(short_name, '')), 'supplier')""",
)
def _(spark, sf_dir):
    return reports.agencies_sorted(
        load_domain(spark, sf_dir), sort="references", descending=True, search="SUPPLIER"
    )


@query(
    "agency_detail",
    with_(METRICS)
    + """
    SELECT slug, name, short_name, parent_slug, cfr_reference_count AS total_cfr_references, child_count,
           total_corrections, rvi, round(avg_lag, 2) AS avg_lag_days, first_correction_year, last_correction_year
    FROM metrics WHERE slug = 'supplier-7'""",
)
def _(spark, sf_dir):
    return reports.agency_detail(load_domain(spark, sf_dir), "supplier-7")


@query(
    "agency_hierarchy",
    with_(AGENCIES)
    + """
    SELECT p.slug AS parent_slug, p.name AS parent_name, c.slug AS child_slug, c.name AS child_name,
           c.cfr_reference_count AS child_cfr_refs
    FROM agencies p JOIN agencies c ON c.parent_slug = p.slug""",
)
def _(spark, sf_dir):
    return reports.agency_hierarchy(load_domain(spark, sf_dir))


@query(
    "agency_metrics_top",
    with_(METRICS)
    + """
    SELECT slug, name, short_name, parent_slug, cfr_reference_count, child_count, total_corrections,
           years_with_corrections, first_correction_year, last_correction_year,
           round(avg_lag, 1) AS avg_correction_lag_days, rvi
    FROM metrics ORDER BY total_corrections DESC, slug LIMIT 10""",
)
def _(spark, sf_dir):
    return reports.agency_metrics_top(load_domain(spark, sf_dir), limit=10)


@query(
    "top_rvi_lake",
    with_(METRICS)
    + """
    SELECT slug, name, short_name, total_corrections, cfr_reference_count, rvi
    FROM metrics WHERE total_corrections > 0 ORDER BY rvi DESC, slug LIMIT 20""",
)
def _(spark, sf_dir):
    return reports.top_rvi_lake(load_domain(spark, sf_dir))


_TOP = """
    SELECT slug, name, short_name, total_corrections, rvi, cfr_reference_count AS total_cfr_references
    FROM metrics WHERE {0} > 0 ORDER BY {0} DESC, slug LIMIT {1}"""


@query("top_by_corrections", with_(METRICS) + _TOP.format("total_corrections", 20))
def _(spark, sf_dir):
    return reports.top_by_corrections(load_domain(spark, sf_dir))


@query("top_by_rvi", with_(METRICS) + _TOP.format("rvi", 75))
def _(spark, sf_dir):
    return reports.top_by_rvi(load_domain(spark, sf_dir), limit=75, cap=None)


@query(
    "corrections_list",
    with_(CORRECTIONS)
    + f"""
    SELECT {_LIST_COLUMNS} FROM corrections WHERE year = 1998 AND title = 12
    ORDER BY year DESC, error_corrected DESC NULLS LAST, ecfr_id LIMIT 100 OFFSET 5""",
)
def _(spark, sf_dir):
    return reports.corrections_list(dom.corrections(spark, sf_dir), year=1998, title=12, offset=5)


@query(
    "corrections_search",
    with_(CORRECTIONS)
    + f"""
    SELECT {_LIST_COLUMNS} FROM corrections
    WHERE contains(lower(cfr_reference), 'urgent') OR contains(lower(corrective_action), 'urgent')""",
)
def _(spark, sf_dir):
    return reports.corrections_list(dom.corrections(spark, sf_dir), search="Urgent", limit=None)


@query(
    "corrections_filtered",
    with_(CORRECTIONS)
    + f"""
    SELECT {_LIST_COLUMNS} FROM corrections
    WHERE error_occurred BETWEEN DATE '1997-03-01' AND DATE '1999-06-30' AND lag_days >= 200""",
)
def _(spark, sf_dir):
    return reports.corrections_list(
        dom.corrections(spark, sf_dir),
        occurred_from=date(1997, 3, 1),
        occurred_to=date(1999, 6, 30),
        min_lag=200,
        limit=None,
    )


@query(
    "recent_corrections",
    with_(CORRECTIONS)
    + f"""
    SELECT {_LIST_COLUMNS} FROM corrections
    ORDER BY error_corrected DESC NULLS LAST, year DESC, ecfr_id LIMIT 100""",
)
def _(spark, sf_dir):
    return reports.recent_corrections(dom.corrections(spark, sf_dir))


@query(
    "corrections_for_agency",
    with_(CORRECTIONS, REFERENCES)
    + f"""
    SELECT {_LIST_COLUMNS} FROM corrections
    WHERE title IN (SELECT title FROM refs WHERE agency_slug = 'supplier-7')
    ORDER BY year DESC, error_corrected DESC NULLS LAST, ecfr_id LIMIT 100""",
)
def _(spark, sf_dir):
    return reports.corrections_for_agency(load_domain(spark, sf_dir), "supplier-7")


@query(
    "word_count_report",
    with_(METRICS)
    + """
    SELECT slug, name, short_name, word_count_estimate, total_corrections, rvi,
           cfr_reference_count AS total_cfr_references FROM metrics WHERE word_count_estimate > 0""",
)
def _(spark, sf_dir):
    return reports.word_count_report(load_domain(spark, sf_dir))


@query(
    "word_count_summary",
    with_(METRICS)
    + """
    SELECT count(*) AS agencies, CAST(sum(word_count_estimate) AS BIGINT) AS total_words,
           CAST(round(sum(word_count_estimate) / count(*)) AS BIGINT) AS average_words
    FROM metrics WHERE word_count_estimate > 0""",
)
def _(spark, sf_dir):
    return reports.word_count_summary(load_domain(spark, sf_dir))


@query(
    "scorecard",
    with_(METRICS, SCORECARD)
    + """
    SELECT slug, name, short_name, total_corrections, rvi, word_count_estimate, avg_correction_lag_days,
           total_cfr_references, corrections_rank, rvi_rank, size_rank, responsiveness_rank,
           round((30 * corrections_rank + 25 * rvi_rank + 20 * size_rank + 25 * responsiveness_rank) / total, 2)
               AS composite_score,
           CASE WHEN corrections_rank * 100 <= total * 20 THEN 'A' WHEN corrections_rank * 100 <= total * 40 THEN 'B'
                WHEN corrections_rank * 100 <= total * 60 THEN 'C' WHEN corrections_rank * 100 <= total * 80 THEN 'D'
                ELSE 'F' END AS activity_grade
    FROM ranked""",
)
def _(spark, sf_dir):
    return reports.scorecard(load_domain(spark, sf_dir))


def _badge(name: str) -> str:
    rank = f"{name}_rank * 100 <= total"
    return (
        f"CASE WHEN {rank} * 20 THEN 'Top 20%' WHEN {rank} * 40 THEN 'Top 40%' WHEN {rank} * 60 THEN 'Middle' "
        f"WHEN {rank} * 80 THEN 'Bottom 40%' ELSE 'Bottom 20%' END AS {name}_badge"
    )


@query(
    "scorecard_badges",
    with_(METRICS, SCORECARD)
    + "SELECT slug, "
    + ", ".join(_badge(n) for n in reports.SCORE_WEIGHTS)
    + " FROM ranked",
)
def _(spark, sf_dir):
    return reports.scorecard_badges(load_domain(spark, sf_dir))


@query(
    "export_agencies",
    with_(AGENCIES)
    + """
    SELECT row_number() OVER (ORDER BY slug) AS id, slug, name, short_name, parent_slug,
           cfr_reference_count AS total_cfr_references, checksum FROM agencies""",
)
def _(spark, sf_dir):
    return reports.export_agencies(load_domain(spark, sf_dir))


@query(
    "export_corrections",
    with_(CORRECTIONS)
    + f"SELECT row_number() OVER (ORDER BY ecfr_id) AS id, {_LIST_COLUMNS}, checksum FROM corrections",
)
def _(spark, sf_dir):
    return reports.export_corrections(dom.corrections(spark, sf_dir))


@query(
    "export_agency_metrics",
    with_(METRICS)
    + """
    SELECT row_number() OVER (ORDER BY slug) AS id, slug AS agency_slug, DATE '2001-12-31' AS metric_date,
           word_count_estimate AS word_count, total_corrections AS correction_count, rvi FROM metrics""",
)
def _(spark, sf_dir):
    return reports.export_agency_metrics(load_domain(spark, sf_dir), date(2001, 12, 31))


@query(
    "agency_year_matrix",
    with_(CORRECTIONS, REFERENCES)
    + """
    SELECT agency_slug, year, count(DISTINCT ecfr_id) AS correction_count
    FROM refs JOIN corrections USING (title) GROUP BY agency_slug, year""",
)
def _(spark, sf_dir):
    return marts.agency_year_matrix(load_domain(spark, sf_dir))


@query(
    "lag_histogram",
    with_(CORRECTIONS)
    + """
    SELECT CAST(floor(lag_days / 30) * 30 AS INTEGER) AS lag_from, count(*) AS correction_count,
           CAST(floor(lag_days / 30) * 30 + 29 AS INTEGER) AS lag_to
    FROM corrections WHERE lag_days IS NOT NULL GROUP BY 1, 3""",
)
def _(spark, sf_dir):
    return marts.lag_histogram(dom.corrections(spark, sf_dir))


@query(
    "hierarchy_totals",
    with_(METRICS)
    + """
    SELECT coalesce(parent_slug, slug) AS root_slug,
           CAST(sum(CASE WHEN parent_slug IS NULL THEN total_corrections ELSE 0 END) AS BIGINT) AS own_corrections,
           CAST(sum(CASE WHEN parent_slug IS NULL THEN 0 ELSE total_corrections END) AS BIGINT) AS child_corrections,
           count(parent_slug) AS children
    FROM metrics GROUP BY 1""",
)
def _(spark, sf_dir):
    return marts.hierarchy_totals(load_domain(spark, sf_dir))


@query(
    "latest_years",
    with_(CORRECTIONS)
    + """
    SELECT year, count(*) AS correction_count, round(avg(lag_days), 1) AS avg_lag_days
    FROM corrections WHERE lag_days IS NOT NULL GROUP BY year ORDER BY year DESC LIMIT 5""",
)
def _(spark, sf_dir):
    return marts.latest_years(dom.corrections(spark, sf_dir))


@query(
    "trends_total",
    with_(CORRECTIONS)
    + """
    SELECT count(*) AS total_corrections, count(DISTINCT year) AS years
    FROM corrections WHERE error_corrected IS NOT NULL""",
)
def _(spark, sf_dir):
    return marts.trends_total(dom.corrections(spark, sf_dir))


@query(
    "agency_years",
    with_(CORRECTIONS, REFERENCES)
    + """
    SELECT year, count(*) AS correction_count FROM corrections
    WHERE title IN (SELECT title FROM refs WHERE agency_slug = 'supplier-7') GROUP BY year""",
)
def _(spark, sf_dir):
    return marts.agency_years(load_domain(spark, sf_dir), "supplier-7")
