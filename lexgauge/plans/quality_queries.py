"""Registered queries: sources, checksums, snapshots and integrity checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexgauge.functions.checksums import (
    CHECKSUM_PATTERN,
    table_digest,
    with_record_checksum,
)
from lexgauge.operators import hash_tree, quality, snapshots
from lexgauge.plans import marts, reports
from lexgauge.plans.registry import query
from lexgauge.plans.sql import (
    AGENCIES,
    CORRECTION_CHECKSUM,
    CORRECTIONS,
    METRICS,
    REFERENCE_CHECKSUM,
    REFERENCES,
    digest_sql,
    scored,
    with_,
)
from lexgauge.session import checkpoint_root, materialize
from lexgauge.sources import domain as dom
from lexgauge.sources import nested, parsing
from lexgauge.sources.copies import landed_corrections, serving_agencies
from lexgauge.sources.domain import load_domain
from lexgauge.sources.json_files import file_checksums, ingestion_log
from lexgauge.sources.tables import SCHEMAS, read_table

# -- nested sources ---------------------------------------------------------


@query(
    "agency_flatten",
    """
    SELECT concat('supplier-', s_suppkey) AS slug, s_name AS name,
           CASE WHEN s_suppkey % 4 = 0 THEN concat('S', s_suppkey) END AS short_name,
           CAST(NULL AS VARCHAR) AS parent_slug,
           CAST(CASE WHEN s_suppkey % 10 IN (3, 4) THEN 0 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT)
               AS cfr_reference_count,
           s_suppkey % 3 AS child_count
    FROM supplier
    UNION ALL
    SELECT concat('supplier-', s_suppkey, '-office-', n), concat(s_name, ' office ', n), NULL,
           concat('supplier-', s_suppkey), 1, 0
    FROM supplier JOIN (VALUES (1), (2)) office(n) ON n <= s_suppkey % 3""",
)
def _(spark, sf_dir):
    return parsing.flatten_agencies(nested.nested_agencies(spark, sf_dir))


@query(
    "reference_flatten",
    """
    SELECT concat('supplier-', s_suppkey) AS agency_slug, CAST(s_suppkey % 50 + 1 AS INTEGER) AS title,
           'I' AS chapter, CAST(NULL AS VARCHAR) AS subtitle, CAST(NULL AS VARCHAR) AS part
    FROM supplier WHERE s_suppkey % 10 NOT IN (3, 4)
    UNION ALL
    SELECT concat('supplier-', s_suppkey), CAST(s_suppkey * 7 % 50 + 1 AS INTEGER), 'II', NULL,
           CAST(s_suppkey % 900 AS VARCHAR)
    FROM supplier WHERE s_suppkey % 10 NOT IN (3, 4) AND s_suppkey % 2 = 1
    UNION ALL
    SELECT concat('supplier-', s_suppkey, '-office-', n), CAST(s_suppkey * n % 50 + 1 AS INTEGER), NULL, NULL, NULL
    FROM supplier JOIN (VALUES (1), (2)) office(n) ON n <= s_suppkey % 3""",
)
def _(spark, sf_dir):
    return parsing.flatten_references(nested.nested_agencies(spark, sf_dir))


_NESTED_CORRECTIONS = """
    source AS (
        SELECT o_orderkey AS k, o_orderkey % 50 + 1 AS title, o_orderkey % 900 + 1 AS part1, o_custkey, o_orderpriority,
               CAST(o_orderdate AS DATE) AS occurred,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 20 AS INTEGER) AS corrected,
               o_orderkey % 11 NOT IN (6, 7) AS has_reference
        FROM orders),
    records AS (
        SELECT k, CAST(title AS INTEGER) AS title, CAST(year(occurred) AS INTEGER) AS year, part1, has_reference,
               concat('Amended: ', o_orderpriority) AS corrective_action,
               CASE WHEN k % 19 <> 2 THEN CAST(occurred AS VARCHAR) END AS error_occurred,
               CASE WHEN k % 23 = 4 THEN 'not a date' WHEN k % 7 <> 3 THEN CAST(corrected AS VARCHAR) END
                   AS error_corrected,
               concat(year(occurred), ' FR ', o_custkey) AS fr_citation
        FROM source)"""


@query(
    "correction_parse",
    with_(_NESTED_CORRECTIONS)
    + """
    SELECT k AS ecfr_id, CASE WHEN has_reference THEN concat(title, ' CFR ', part1) ELSE '' END AS cfr_reference,
           title, CASE WHEN has_reference THEN concat('ch-', k % 9) END AS chapter,
           CASE WHEN has_reference THEN CAST(part1 AS VARCHAR) END AS part,
           CASE WHEN has_reference AND k % 5 = 0 THEN concat(part1, '.1') END AS section, corrective_action,
           TRY_CAST(error_occurred AS DATE) AS error_occurred, TRY_CAST(error_corrected AS DATE) AS error_corrected,
           CAST(date_diff('day', TRY_CAST(error_occurred AS DATE), TRY_CAST(error_corrected AS DATE)) AS INTEGER)
               AS lag_days, fr_citation, year
    FROM records""",
)
def _(spark, sf_dir):
    return parsing.parse_corrections(nested.nested_corrections(spark, sf_dir))


_HIERARCHY = """{{'cfr_reference': concat(title, ' CFR ', part1 + {0}), 'hierarchy': {{'chapter': concat('ch-', k % 9),
    'part': CAST(part1 + {0} AS VARCHAR), 'section': CASE WHEN k % 5 = 0 THEN concat(part1 + {0}, '.1') END}}}}"""


@query(
    "raw_landing",
    with_(_NESTED_CORRECTIONS)
    + f"""
    SELECT *, sha256(data) AS checksum FROM (
        SELECT k AS record_key, CAST(to_json({{'id': k, 'title': title, 'year': year,
               'cfr_references': CASE WHEN k % 11 = 5 THEN [{_HIERARCHY.format(0)}] WHEN k % 11 = 6 THEN []
                   WHEN k % 11 <> 7 THEN [{_HIERARCHY.format(0)}, {_HIERARCHY.format(1)}] END,
               'corrective_action': corrective_action, 'error_occurred': error_occurred,
               'error_corrected': error_corrected, 'fr_citation': fr_citation}}) AS VARCHAR) AS data
        FROM records)""",
)
def _(spark, sf_dir):
    return parsing.raw_landing(nested.nested_corrections(spark, sf_dir), "correction", "id")


@query("file_checksum")
def _(spark, sf_dir):
    return file_checksums(spark, f"{sf_dir}/*.parquet").drop("file_path")


@query("ingestion_log")
def _(spark, sf_dir):
    counts = None
    for name in SCHEMAS:
        rows = (
            read_table(spark, sf_dir, name)
            .groupBy(F.col("_metadata.file_path").alias("file_path"))
            .agg(F.count("*").alias("record_count"))
        )
        counts = rows if counts is None else counts.unionByName(rows)
    return ingestion_log(counts, file_checksums(spark, f"{sf_dir}/*.parquet"))


# -- checksums --------------------------------------------------------------


@query("record_checksum", with_(CORRECTIONS) + "SELECT ecfr_id, checksum FROM corrections")
def _(spark, sf_dir):
    rows = dom.with_correction_checksum(dom.corrections(spark, sf_dir))
    return rows.select("ecfr_id", "checksum")


@query(
    "table_checksum",
    with_(CORRECTIONS)
    + """,
    title_stats AS (
        SELECT title, sha256(concat('{"correction_count":', count(*), ',"first_year":', min(year),
               ',"last_year":', max(year), ',"title":', title, '}')) AS checksum
        FROM corrections GROUP BY title)
    SELECT count(*) AS record_count, md5(string_agg(checksum, '' ORDER BY title)) AS aggregate_checksum
    FROM title_stats""",
)
def _(spark, sf_dir):
    names = ["correction_count", "first_year", "last_year", "title"]
    title_stats = with_record_checksum(
        marts.trends_by_title(dom.corrections(spark, sf_dir)), {n: n for n in names}
    )
    # One row per title of the code, a closed list of about fifty; whole tables have table_digest.
    ordered = F.array_sort(F.collect_list(F.struct("title", "checksum")))
    return title_stats.agg(
        F.count("*").alias("record_count"),
        F.md5(F.array_join(F.transform(ordered, lambda r: r["checksum"]), "")).alias("aggregate_checksum"),
    )


@query(
    "table_digest_bucketed",
    with_(AGENCIES, CORRECTIONS, f"reference_sums AS (SELECT {REFERENCE_CHECKSUM} AS checksum FROM refs)")
    + " UNION ALL ".join(
        digest_sql(name, table)
        for name, table in (
            ("agencies", "agencies"),
            ("cfr_references", "reference_sums"),
            ("corrections", "corrections"),
        )
    ),
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    return (
        table_digest(domain.stored_agencies(), "agencies")
        .unionByName(table_digest(domain.stored_references(), "cfr_references"))
        .unionByName(table_digest(domain.stored_corrections(), "corrections"))
    )


_LANDED = (
    CORRECTIONS
    + """,
    landed AS (
        SELECT *, CASE WHEN ecfr_id % 997 = 0 THEN NULL WHEN ecfr_id % 991 = 1 THEN upper(checksum)
                       WHEN ecfr_id % 89 = 3 THEN reverse(checksum) ELSE checksum END AS stored_checksum,
               CASE WHEN ecfr_id % 83 = 2 THEN lag_days + 1 ELSE lag_days END AS stored_lag
        FROM corrections)"""
)


def _landed(spark, sf_dir):
    return landed_corrections(dom.with_correction_checksum(dom.corrections(spark, sf_dir)))


@query("null_checksums", with_(_LANDED) + "SELECT ecfr_id FROM landed WHERE stored_checksum IS NULL")
def _(spark, sf_dir):
    return quality.null_values(_landed(spark, sf_dir), "stored_checksum", "ecfr_id")


@query(
    "checksum_format",
    with_(_LANDED)
    + """
    SELECT ecfr_id, stored_checksum FROM landed WHERE NOT regexp_full_match(stored_checksum, '[a-f0-9]{64}')""",
)
def _(spark, sf_dir):
    return quality.malformed_checksums(_landed(spark, sf_dir), "stored_checksum", "ecfr_id")


@query(
    "checksum_verify",
    with_(_LANDED)
    + f"""
    SELECT ecfr_id, stored_checksum AS stored, {CORRECTION_CHECKSUM} AS computed FROM landed
    WHERE stored_checksum IS DISTINCT FROM {CORRECTION_CHECKSUM}""",
)
def _(spark, sf_dir):
    computed = dom.with_correction_checksum(_landed(spark, sf_dir), "computed_checksum")
    return quality.mismatches(computed, "ecfr_id", "stored_checksum", F.col("computed_checksum"))


@query(
    "lag_recheck",
    with_(_LANDED)
    + """
    SELECT ecfr_id, stored_lag AS stored, CAST(error_corrected - error_occurred AS INTEGER) AS computed
    FROM landed WHERE stored_lag IS DISTINCT FROM error_corrected - error_occurred""",
)
def _(spark, sf_dir):
    return quality.mismatches(
        _landed(spark, sf_dir), "ecfr_id", "stored_lag", F.date_diff("error_corrected", "error_occurred")
    )


# -- keys and relationships -------------------------------------------------

_SERVING = (
    AGENCIES
    + """,
    serving AS (
        SELECT * FROM agencies
        WHERE CASE WHEN parent_slug IS NULL THEN (id - 1) % 12 <> 11 ELSE (id - 1000000) % 17 <> 4 END)"""
)


@query(
    "duplicate_keys",
    with_(AGENCIES, CORRECTIONS)
    + """
    SELECT 'lineitem' AS table_name, concat(l_orderkey, '|', l_linenumber) AS key, count(*) AS copies
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'agencies', slug, count(*) FROM agencies GROUP BY slug HAVING count(*) > 1
    UNION ALL SELECT 'corrections', CAST(ecfr_id AS VARCHAR), count(*) FROM corrections
              GROUP BY ecfr_id HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    return (
        quality.duplicates(
            read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"
        )
        .unionByName(quality.duplicates(dom.agency_rows(spark, sf_dir), ["slug"], "agencies"))
        .unionByName(quality.duplicates(dom.corrections(spark, sf_dir), ["ecfr_id"], "corrections"))
    )


@query(
    "orphan_references",
    with_(_SERVING)
    + """
    SELECT agency_slug, title, chapter, subtitle, part FROM refs
    WHERE NOT EXISTS (SELECT 1 FROM serving WHERE slug = agency_slug)""",
)
def _(spark, sf_dir):
    served = serving_agencies(dom.agency_rows(spark, sf_dir))
    return quality.orphans(dom.references(spark, sf_dir), "agency_slug", served, "slug")


@query(
    "orphan_metrics",
    with_(METRICS, _SERVING.removeprefix(AGENCIES + ","))
    + """
    SELECT slug, total_corrections, rvi FROM metrics m
    WHERE NOT EXISTS (SELECT 1 FROM serving s WHERE s.slug = m.slug)""",
)
def _(spark, sf_dir):
    served = serving_agencies(dom.agency_rows(spark, sf_dir))
    mart = marts.metrics_mart(load_domain(spark, sf_dir)).select("slug", "total_corrections", "rvi")
    return quality.orphans(mart, "slug", served, "slug")


@query(
    "invalid_parents",
    with_(_SERVING)
    + """
    SELECT slug, parent_slug FROM serving c WHERE parent_slug IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM serving p WHERE p.slug = c.parent_slug)""",
)
def _(spark, sf_dir):
    served = serving_agencies(dom.agency_rows(spark, sf_dir))
    return quality.orphans(served.select("slug", "parent_slug"), "parent_slug", served, "slug")


@query(
    "child_count_check",
    with_(_SERVING)
    + """
    SELECT p.slug, p.child_count, count(c.slug) AS actual_children
    FROM serving p LEFT JOIN serving c ON c.parent_slug = p.slug WHERE p.child_count > 0
    GROUP BY p.slug, p.child_count HAVING p.child_count <> count(c.slug)""",
)
def _(spark, sf_dir):
    rows = dom.with_child_counts(dom.agency_rows(spark, sf_dir))
    return quality.child_count_mismatches(serving_agencies(rows))


_RECONCILE_TABLES = """
    SELECT 'agencies' AS table_name, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS source_count,
           (SELECT count(*) FROM serving) AS target_count
    UNION ALL
    SELECT 'cfr_references', (SELECT count(*) FROM nation) + (SELECT count(*) FROM part), (SELECT count(*) FROM refs)
    UNION ALL
    SELECT 'corrections', (SELECT count(DISTINCT l_orderkey) FROM lineitem), (SELECT count(*) FROM corrections)"""


@query(
    "count_reconcile",
    with_(_SERVING, CORRECTIONS)
    + f"SELECT *, source_count = target_count AS matches FROM ({_RECONCILE_TABLES})",
)
def _(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey")
    return quality.count_reconciliation(
        {
            "agencies": (nation.union(supplier), serving_agencies(dom.agency_rows(spark, sf_dir))),
            "cfr_references": (nation.union(part), dom.references(spark, sf_dir)),
            "corrections": (
                read_table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(),
                dom.corrections(spark, sf_dir),
            ),
        }
    )


@query(
    "series_reconcile",
    with_(CORRECTIONS)
    + """
    SELECT year, count(error_corrected) AS series_total, count(*) AS fact_count,
           count(*) - count(error_corrected) AS difference FROM corrections GROUP BY year""",
)
def _(spark, sf_dir):
    return quality.series_reconciliation(dom.corrections(spark, sf_dir))


# Snapshots: the earlier and the later state of the same tables.
_EARLIER_CORRECTIONS = "error_occurred < DATE '2000-07-01'"
_EARLIER_REFERENCES = "title % 9 <> 4"
_SNAPSHOTS = (
    CORRECTIONS
    + f""",
    old_rows AS (SELECT * FROM corrections WHERE {_EARLIER_CORRECTIONS}),
    new_rows AS (
        SELECT * EXCLUDE (checksum), {CORRECTION_CHECKSUM} AS checksum FROM (
            SELECT * REPLACE (CASE WHEN ecfr_id % 37 = 1 THEN concat(corrective_action, ' (revised)')
                                   ELSE corrective_action END AS corrective_action)
            FROM corrections WHERE ecfr_id % 101 <> 5)),
    compared AS (
        SELECT coalesce(o.ecfr_id, n.ecfr_id) AS ecfr_id, coalesce(n.title, o.title) AS title,
               o.checksum AS old_checksum, n.checksum AS new_checksum,
               CASE WHEN o.checksum IS NULL THEN 'added' WHEN n.checksum IS NULL THEN 'removed'
                    WHEN o.checksum <> n.checksum THEN 'changed' ELSE 'same' END AS change
        FROM old_rows o FULL JOIN new_rows n ON o.ecfr_id = n.ecfr_id)"""
)


@query(
    "snapshot_diff",
    with_(_SNAPSHOTS)
    + "SELECT ecfr_id, old_checksum, new_checksum, change FROM compared WHERE change <> 'same'",
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    return snapshots.snapshot_diff(
        snapshots.earlier(domain).stored_corrections(),
        snapshots.later(domain).stored_corrections(),
        "ecfr_id",
    )


@query(
    "snapshot_tree_diff",
    with_(_SNAPSHOTS)
    + "SELECT ecfr_id, old_checksum, new_checksum, change FROM compared WHERE change <> 'same'",
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    folder = f"{checkpoint_root(spark)}/snapshots/{uuid.uuid4().hex}"
    old, new = (
        hash_tree.write_snapshot(state(domain).stored_corrections(), f"{folder}/{name}", "ecfr_id", leaves=64, fanout=8)
        for name, state in (("old", snapshots.earlier), ("new", snapshots.later))
    )
    return hash_tree.tree_diff(old, new)


@query(
    "impact_score",
    with_(_SNAPSHOTS.replace("FROM corrections WHERE", "FROM corrections WHERE title <> 13 AND", 1))
    + """,
    counted AS (
        SELECT title, count(old_checksum) AS old_count, count(new_checksum) AS new_count,
               count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change <> 'same') AS differing,
               count(*) AS n FROM compared GROUP BY title)
    SELECT title, old_count, new_count, round((new_count - old_count) / old_count, 4) AS growth_rate,
           round(changed / old_count, 4) AS amendment_frequency, round(differing / n, 4) AS checksum_variance,
           round(((new_count - old_count) / old_count + changed / old_count + differing / n) / 3 * 100, 2)
               AS impact_score
    FROM (SELECT title, nullif(old_count, 0) AS old, * EXCLUDE (title) FROM counted)""".replace("/ old_count", "/ old"),
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    # Title 13 is new in the later snapshot.
    earlier = snapshots.earlier(domain).stored_corrections().filter("title <> 13")
    return snapshots.impact_score(earlier, snapshots.later(domain).stored_corrections())


_WORDS = "CASE WHEN part IS NOT NULL THEN 2000 WHEN chapter IS NOT NULL THEN 10000 ELSE 50000 END"


@query(
    "word_count_growth",
    with_(REFERENCES)
    + f"""
    SELECT agency_slug, old_words, new_words,
           CASE WHEN old_words > 0 THEN round((new_words - old_words) / old_words * 100, 2) END AS growth_percent
    FROM (SELECT agency_slug, CAST(sum(CASE WHEN {_EARLIER_REFERENCES} THEN {_WORDS} ELSE 0 END) AS BIGINT)
                     AS old_words, CAST(sum({_WORDS}) AS BIGINT) AS new_words
          FROM refs GROUP BY agency_slug)""",
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    return snapshots.word_count_growth(snapshots.earlier(domain).references, domain.references)


_WEIGHTS = {"corrections": 40, "rvi": 20, "size": 10, "responsiveness": 30}


@query(
    "scorecard_weighted",
    with_(
        AGENCIES,
        CORRECTIONS,
        scored("old", _EARLIER_CORRECTIONS, _EARLIER_REFERENCES, _WEIGHTS),
        scored("new", "ecfr_id % 101 <> 5", "true", _WEIGHTS),
    )
    + """
    SELECT coalesce(o.slug, n.slug) AS slug, o.score AS score_before, n.score AS score_after,
           round(n.score - o.score, 2) AS score_change
    FROM old_scores o FULL JOIN new_scores n ON o.slug = n.slug""",
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    return reports.scorecard_change(snapshots.earlier(domain), snapshots.later(domain), _WEIGHTS)


_OLD_NEW = scored("old", _EARLIER_CORRECTIONS, _EARLIER_REFERENCES, _WEIGHTS)


@query(
    "rvi_recheck",
    with_(METRICS, _OLD_NEW)
    + """
    SELECT slug, o.rvi AS stored_rvi, m.rvi AS computed_rvi
    FROM old_metrics o JOIN metrics m USING (slug) WHERE abs(o.rvi - m.rvi) >= 0.01""",
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    stored = marts.metrics_mart(snapshots.earlier(domain))
    return quality.rvi_mismatches(stored, marts.metrics_mart(domain))


# -- roll-ups ---------------------------------------------------------------


def _relationship_checks(spark, sf_dir):
    refs = dom.references(spark, sf_dir)
    agencies = dom.with_child_counts(dom.agency_rows(spark, sf_dir))
    served = serving_agencies(agencies)
    return [
        quality.violations("orphan_references", quality.orphans(refs, "agency_slug", served, "slug")),
        quality.violations("invalid_parents", quality.orphans(served, "parent_slug", served, "slug")),
        quality.violations("child_count", quality.child_count_mismatches(served)),
    ]


_RELATIONSHIPS = """
    SELECT 'orphan_references' AS check_name, count(*) AS violations FROM refs
    WHERE agency_slug NOT IN (SELECT slug FROM serving)
    UNION ALL SELECT 'invalid_parents', count(*) FROM serving WHERE parent_slug NOT IN (SELECT slug FROM serving)
    UNION ALL SELECT 'child_count', count(*) FROM serving p WHERE child_count > 0
              AND child_count <> (SELECT count(*) FROM serving c WHERE c.parent_slug = p.slug)"""


@query(
    "constraint_check",
    with_(_SERVING, _LANDED)
    + """
    SELECT *, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
        SELECT 'unique agencies.slug' AS check_name, count(*) - count(DISTINCT slug) AS violations FROM agencies
        UNION ALL SELECT 'unique corrections.ecfr_id', count(*) - count(DISTINCT ecfr_id) FROM landed
        UNION ALL SELECT 'unique lineitem key', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
        UNION ALL SELECT 'not null agencies.name', count(*) FROM agencies WHERE name IS NULL
        UNION ALL SELECT 'not null corrections.year', count(*) FROM landed WHERE year IS NULL
        UNION ALL SELECT 'not null corrections.checksum', count(*) FROM landed WHERE stored_checksum IS NULL
        UNION ALL SELECT 'not null corrections.cfr_reference', count(*) FROM landed WHERE cfr_reference IS NULL
        UNION ALL SELECT 'foreign key cfr_references.agency_slug', count(*) FROM refs
                  WHERE agency_slug NOT IN (SELECT slug FROM serving)
        UNION ALL SELECT 'foreign key agencies.parent_slug', count(*) FROM serving
                  WHERE parent_slug NOT IN (SELECT slug FROM serving))""",
)
def _(spark, sf_dir):
    agencies = dom.agency_rows(spark, sf_dir)
    served = serving_agencies(agencies)
    # Read by two checks: written once, with what they need.
    landed = materialize(
        _landed(spark, sf_dir).select(
            "ecfr_id",
            *[F.col(n).isNull().alias(f"no_{n}") for n in ("year", "stored_checksum", "cfr_reference")],
        )
    )
    return quality.report(
        [
            quality.extra_copies(agencies, ["slug"], "unique agencies.slug"),
            quality.extra_copies(landed, ["ecfr_id"], "unique corrections.ecfr_id"),
            quality.extra_copies(
                read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "unique lineitem key"
            ),
            quality.tallies(agencies, {"not null agencies.name": F.col("name").isNull()}),
            quality.tallies(
                landed,
                {
                    "not null corrections.year": F.col("no_year"),
                    "not null corrections.checksum": F.col("no_stored_checksum"),
                    "not null corrections.cfr_reference": F.col("no_cfr_reference"),
                },
            ),
            quality.violations(
                "foreign key cfr_references.agency_slug",
                quality.orphans(dom.references(spark, sf_dir), "agency_slug", served, "slug"),
            ),
            quality.violations(
                "foreign key agencies.parent_slug", quality.orphans(served, "parent_slug", served, "slug")
            ),
        ]
    )


@query(
    "quality_report",
    with_(_SERVING, _LANDED)
    + f"""
    SELECT *, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
        SELECT 'null_checksums' AS check_name, count(*) AS violations FROM landed WHERE stored_checksum IS NULL
        UNION ALL SELECT 'checksum_format', count(*) FROM landed
                  WHERE NOT regexp_full_match(stored_checksum, '[a-f0-9]{{64}}')
        UNION ALL SELECT 'checksum_verify', count(*) FROM landed WHERE stored_checksum IS DISTINCT FROM checksum
        UNION ALL SELECT 'lag_recheck', count(*) FROM landed
                  WHERE stored_lag IS DISTINCT FROM error_corrected - error_occurred
        UNION ALL SELECT 'duplicate_corrections', count(*) - count(DISTINCT ecfr_id) FROM landed
        UNION ALL SELECT 'duplicate_agencies', count(*) - count(DISTINCT slug) FROM agencies
        UNION ALL SELECT 'series_reconcile', count(*) FROM (
                  SELECT year FROM landed GROUP BY year HAVING count(*) <> count(error_corrected))
        UNION ALL SELECT 'agencies_empty', CASE WHEN EXISTS (SELECT 1 FROM serving) THEN 0 ELSE 1 END
        UNION ALL SELECT 'corrections_empty', CASE WHEN EXISTS (SELECT 1 FROM landed) THEN 0 ELSE 1 END
        UNION ALL {_RELATIONSHIPS})""",
)
def _(spark, sf_dir):
    stored = F.col("stored_checksum")
    row_checks = {
        "null_checksums": stored.isNull(),
        "checksum_format": ~stored.rlike(CHECKSUM_PATTERN),
        "checksum_verify": ~stored.eqNullSafe(F.col("computed_checksum")),
        "lag_recheck": ~F.col("stored_lag").eqNullSafe(F.date_diff("error_corrected", "error_occurred")),
    }
    # Read by four checks: written once, with what they need.
    landed = materialize(
        dom.with_correction_checksum(_landed(spark, sf_dir), "computed_checksum").select(
            "ecfr_id",
            "year",
            "error_corrected",
            "lag_days",
            *[condition.alias(name) for name, condition in row_checks.items()],
        )
    )
    agencies = dom.agency_rows(spark, sf_dir)
    return quality.report(
        [
            quality.tallies(landed, {name: F.col(name) for name in row_checks}),
            quality.extra_copies(landed, ["ecfr_id"], "duplicate_corrections"),
            quality.extra_copies(agencies, ["slug"], "duplicate_agencies"),
            quality.violations(
                "series_reconcile", quality.series_reconciliation(landed).filter("difference != 0")
            ),
            quality.empty_view("agencies_empty", serving_agencies(agencies)),
            quality.empty_view("corrections_empty", landed),
            *_relationship_checks(spark, sf_dir),
        ]
    )
