"""Registered queries: privacy pass, run ledger, activity and profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lexgauge.operators import ledger, privacy, profiles, snapshots
from lexgauge.operators.contracts import CLASSIFICATIONS
from lexgauge.plans.registry import query
from lexgauge.plans.sql import (
    AGENCIES,
    CORRECTION_CHECKSUM,
    CORRECTIONS,
    REFERENCE_CHECKSUM,
    digest_sql,
    lane_digest,
    with_,
)
from lexgauge.sources import runs
from lexgauge.sources.domain import load_domain
from lexgauge.sources.tables import read_table

SALT = "demo-salt-1"
_AS_OF = datetime(2024, 1, 31, 6)
_AS_OF_SQL = "TIMESTAMP '2024-01-31 06:00:00'"

# -- privacy ----------------------------------------------------------------

_STAGED = f"""
    staged AS (
        SELECT event_id, CASE WHEN event_id % 41 <> 0 THEN concat('person ', user_id) END AS raw_name,
               concat('900-', user_id) AS raw_ssn,
               CASE WHEN event_id % 50 <> 0 THEN CAST(floor(value) AS INTEGER) END AS age, ts AS encounter_ts,
               props AS clinician_notes, event_type FROM events),
    hashed AS (
        SELECT event_id, age, encounter_ts, clinician_notes, event_type,
               CASE WHEN raw_name IS NOT NULL THEN sha256('{SALT}' || raw_name) END AS person_hash,
               sha256('{SALT}' || raw_ssn) AS ssn_hash FROM staged),
    general AS (
        SELECT event_id, clinician_notes, event_type, person_hash, ssn_hash,
               CAST(CAST(floor(age / 10) * 10 AS INTEGER) AS VARCHAR) || '_to_'
                   || CAST(CAST(floor(age / 10) * 10 AS INTEGER) + 9 AS VARCHAR) AS age_band,
               CAST(date_trunc('week', encounter_ts) AS DATE) AS encounter_week FROM hashed),
    clean AS (SELECT * EXCLUDE (clinician_notes) FROM general),
    sizes AS (
        SELECT age_band, encounter_week, count(*) AS group_size FROM clean
        WHERE age_band IS NOT NULL AND encounter_week IS NOT NULL GROUP BY 1, 2),
    safe AS (
        SELECT c.* FROM clean c JOIN sizes s
        ON c.age_band = s.age_band AND c.encounter_week = s.encounter_week WHERE group_size >= 5)"""

_QUASI = ["age_band", "encounter_week"]


def _hashed(spark, sf_dir):
    return privacy.hash_identifiers(
        runs.staging_rows(spark, sf_dir), {"raw_name": "person_hash", "raw_ssn": "ssn_hash"}, SALT
    )


def _general(spark, sf_dir):
    return privacy.generalize(_hashed(spark, sf_dir), "age", "age_band", "encounter_ts", "encounter_week")


def _clean(spark, sf_dir):
    return privacy.suppress_text(_general(spark, sf_dir), ["clinician_notes"])


@query("hash_identifiers", with_(_STAGED) + "SELECT * FROM hashed")
def _(spark, sf_dir):
    return _hashed(spark, sf_dir)


@query("generalize", with_(_STAGED) + "SELECT * FROM general")
def _(spark, sf_dir):
    return _general(spark, sf_dir)


@query("suppress_text", with_(_STAGED) + "SELECT * FROM clean")
def _(spark, sf_dir):
    return _clean(spark, sf_dir)


@query("k_anonymity", with_(_STAGED) + "SELECT * FROM safe")
def _(spark, sf_dir):
    return privacy.k_anonymous(_clean(spark, sf_dir), _QUASI)


@query("k_violations", with_(_STAGED) + "SELECT * FROM sizes WHERE group_size < 5")
def _(spark, sf_dir):
    return privacy.k_violations(_clean(spark, sf_dir), _QUASI)


_GLOBAL, _LEFT, _RIGHT = "shared-salt-1", "left-salt-1", "right-salt-1"


@query(
    "linkage",
    f"""
    SELECT sha256('{_GLOBAL}' || c_custkey) AS token, sha256('{_LEFT}' || c_custkey) AS left_agency_hash,
           left_records, sha256('{_RIGHT}' || c_custkey) AS right_agency_hash, right_records
    FROM (SELECT c_custkey, count(*) AS left_records FROM customer GROUP BY 1)
    JOIN (SELECT user_id, count(*) AS right_records FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def _(spark, sf_dir):
    left = privacy.link_tokens(read_table(spark, sf_dir, "customer"), "c_custkey", _GLOBAL, _LEFT)
    right = privacy.link_tokens(read_table(spark, sf_dir, "events"), "user_id", _GLOBAL, _RIGHT)
    return privacy.link(left, right, authorized=True)


def _json_row(columns: dict[str, bool]) -> str:
    """SHA-256 of a row's canonical JSON; True marks numbers."""
    parts = []
    for i, name in enumerate(sorted(columns)):
        text = f"CAST({name} AS VARCHAR)"
        quoted = f"""'"' || replace({text}, '"', '\\"') || '"'"""
        value = f"coalesce({text if columns[name] else quoted}, 'null')"
        comma = "," if i else ""
        parts.append(f"""'{comma}"{name}":', {value}""")
    return "sha256(concat('{', " + ", ".join(parts) + ", '}'))"


def _provenance_sql(number: int, step: str, transform: str, before: str, after: str, columns: dict) -> str:
    return f"""
    SELECT CAST({number} AS INTEGER) AS step_number, '{step}' AS step, '{transform}' AS transform,
           (SELECT count(*) FROM {before}) AS rows_in, record_count AS rows_out, aggregate_checksum AS digest
    FROM ({digest_sql(step, f"(SELECT {_json_row(columns)} AS checksum FROM {after})")})"""


_HASHED_COLUMNS = {
    "event_id": True,
    "age": True,
    "clinician_notes": False,
    "event_type": False,
    "person_hash": False,
    "ssn_hash": False,
}
_CLEAN_COLUMNS = {
    "event_id": True,
    "event_type": False,
    "person_hash": False,
    "ssn_hash": False,
    "age_band": False,
    "encounter_week": False,
}
_STEPS = [
    ("identity", "salted sha256 of identifiers"),
    ("attributes", "bands, weeks, no free text"),
    ("risk", "groups of at least 5"),
]


@query(
    "provenance",
    with_(_STAGED)
    + " UNION ALL ".join(
        _provenance_sql(i + 1, *_STEPS[i], before, after, columns)
        for i, (before, after, columns) in enumerate(
            [
                ("staged", "hashed", _HASHED_COLUMNS),
                ("hashed", "clean", _CLEAN_COLUMNS),
                ("clean", "safe", _CLEAN_COLUMNS),
            ]
        )
    ),
)
def _(spark, sf_dir):
    staged, hashed, clean = (
        runs.staging_rows(spark, sf_dir),
        _hashed(spark, sf_dir),
        _clean(spark, sf_dir),
    )
    safe = privacy.k_anonymous(clean, _QUASI).select(*clean.columns)
    return privacy.provenance(
        [
            (*_STEPS[0], staged, hashed.drop("encounter_ts")),
            (*_STEPS[1], hashed, clean),
            (*_STEPS[2], clean, safe),
        ]
    )


_LABELS = "[" + ", ".join(f"'{c}'" for c in CLASSIFICATIONS) + "]"
_MANIFESTS = f"""
    manifests AS (
        SELECT concat('nation-', n_nationkey) AS agency_id, {_LABELS}[n_nationkey % 4 + 1] AS data_classification,
               CAST({runs.RETENTION_CHOICES}[n_nationkey % 5 + 1] AS INTEGER) AS retention_days FROM nation),
    run_events AS (
        SELECT concat('run-', user_id) AS run_id, event_id, ts AS timestamp, event_type AS event_name,
               props AS event_data, concat('nation-', user_id % 25) AS agency_id FROM events)"""


def _some_manifests(spark, sf_dir):
    """Three agencies have no manifest, so that the contract's defaults show."""
    return runs.tenant_manifests(spark, sf_dir).filter("agency_id NOT LIKE '%3'")


@query(
    "classification_scope",
    with_(_MANIFESTS)
    + """
    SELECT run_events.*, coalesce(m.data_classification, 'U') AS data_classification
    FROM run_events LEFT JOIN (FROM manifests WHERE agency_id NOT LIKE '%3') m USING (agency_id)
    WHERE m.data_classification IS NULL OR m.data_classification IN ('U', 'S')""",
)
def _(spark, sf_dir):
    return privacy.in_clearance(runs.run_events(spark, sf_dir), _some_manifests(spark, sf_dir), ["U", "S"])


@query(
    "retention_apply",
    with_(_MANIFESTS)
    + f"""
    SELECT run_events.*, coalesce(m.retention_days, 2555) AS retention_days
    FROM run_events LEFT JOIN (FROM manifests WHERE agency_id NOT LIKE '%3') m USING (agency_id)
    WHERE m.retention_days = 0 OR timestamp >= {_AS_OF_SQL} - to_days(coalesce(m.retention_days, 2555))""",
)
def _(spark, sf_dir):
    return privacy.within_retention(
        runs.run_events(spark, sf_dir), _some_manifests(spark, sf_dir), "timestamp", ledger.at(_AS_OF)
    )


# -- ledger -----------------------------------------------------------------


def _hash_sql(text: str) -> str:
    return (
        f"sha256(concat('{{\"agency_id\":\"', agency_id, '\",\"event_count\":', event_count, "
        f"',\"last_step\":\"', last_step, '\",\"payload\":\"', {text}, '\",\"run_id\":\"', run_id, '\"}}'))"
    )


_HASH = _hash_sql("replace(payload, '\"', '\\\"')")
_LATEST = f"""
    latest_rows AS (
        SELECT concat('run-', user_id) AS run_id, user_id, concat('nation-', user_id % 25) AS agency_id,
               concat('provider-', user_id % 3) AS provider_name, concat('model-', user_id % 4) AS model,
               upper(first(event_type ORDER BY ts, event_id)) AS status, last(props ORDER BY ts, event_id) AS payload,
               last(event_type ORDER BY ts, event_id) AS last_step, count(*) AS event_count, min(ts) AS created_at,
               max(ts) AS updated_at, min(ts) + INTERVAL 30 DAY AS expires_at, count(DISTINCT event_type) AS names
        FROM events GROUP BY user_id),
    latest AS (SELECT * EXCLUDE (user_id, names), {_HASH} AS checkpoint_hash, user_id, names FROM latest_rows),
    stored AS (SELECT * REPLACE (CASE WHEN user_id % 10 = 3 THEN reverse(checkpoint_hash) ELSE checkpoint_hash END
                                 AS checkpoint_hash) FROM latest)"""


def _latest(spark, sf_dir):
    return ledger.latest_checkpoints(runs.checkpoint_saves(spark, sf_dir))


LATEST_CHECKPOINTS = with_(_LATEST) + "SELECT * EXCLUDE (user_id, names) FROM latest"


@query("checkpoint_latest", LATEST_CHECKPOINTS)
def _(spark, sf_dir):
    return _latest(spark, sf_dir)


@query(
    "checkpoint_integrity",
    with_(_LATEST)
    + f"""
    SELECT run_id, checkpoint_hash AS computed_hash, {_HASH} AS verified_hash, checkpoint_hash = {_HASH} AS integrity_valid,
           {_AS_OF_SQL} AS last_verified_at, checkpoint_hash <> {_HASH} AS hash_mismatch_detected,
           CASE WHEN checkpoint_hash <> {_HASH} THEN {_AS_OF_SQL} END AS mismatch_detected_at
    FROM stored""",
)
def _(spark, sf_dir):
    return ledger.verify_integrity(runs.tampered(_latest(spark, sf_dir)), _AS_OF)


@query(
    "load_checkpoint",
    with_(_LATEST)
    + f"""
    SELECT run_id, payload, event_count, last_step, checkpoint_hash, checkpoint_hash = {_HASH} AS is_valid
    FROM stored WHERE run_id = 'run-13' AND agency_id = 'nation-13' AND expires_at > TIMESTAMP '2024-01-20'""",
)
def _(spark, sf_dir):
    now = datetime(2024, 1, 20)
    stored = runs.tampered(_latest(spark, sf_dir))
    return ledger.load_checkpoint(
        stored, ledger.verify_integrity(stored, now), "run-13", "nation-13", now
    )


@query(
    "checkpoint_summary",
    with_(_LATEST)
    + f"""
    SELECT run_id, agency_id, provider_name, model, status, event_count, created_at, updated_at, expires_at,
           date_diff('microsecond', created_at, {_AS_OF_SQL}) / 1000000 AS duration_seconds,
           expires_at > {_AS_OF_SQL} AS is_valid, names AS unique_events
    FROM latest""",
)
def _(spark, sf_dir):
    return ledger.checkpoint_summary(_latest(spark, sf_dir), runs.run_events(spark, sf_dir), _AS_OF)


@query(
    "expire_checkpoints",
    with_(_LATEST)
    + f"""
    SELECT count(*) FILTER (expires_at < {_AS_OF_SQL}) AS deleted_count,
           count(*) FILTER (expires_at >= {_AS_OF_SQL}) AS kept_count FROM latest""",
)
def _(spark, sf_dir):
    return ledger.expiry_counts(_latest(spark, sf_dir), _AS_OF)


@query(
    "tenant_scope",
    with_(_LATEST) + "SELECT * EXCLUDE (user_id, names) FROM latest WHERE agency_id = 'nation-3'",
)
def _(spark, sf_dir):
    return ledger.tenant_rows(_latest(spark, sf_dir), "nation-3")


@query(
    "event_explode",
    """
    SELECT event_id AS checkpoint_id, CAST(i AS INTEGER) AS event_index, ts + to_minutes(i) AS timestamp,
           ['click', 'view', 'purchase', 'signup', 'error'][(event_id + i) % 5 + 1] AS event_name
    FROM events JOIN range(4) AS r(i) ON i <= event_id % 4""",
)
def _(spark, sf_dir):
    return ledger.explode_events(runs.nested_events(spark, sf_dir))


@query(
    "event_log",
    with_(_MANIFESTS)
    + """
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp, event_id) - 1 AS event_index
    FROM run_events""",
)
def _(spark, sf_dir):
    return ledger.event_log(runs.run_events(spark, sf_dir))


@query(
    "event_replay",
    with_(_MANIFESTS)
    + """
    SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS position
    FROM run_events WHERE run_id = 'run-7'""",
)
def _(spark, sf_dir):
    return ledger.replay(runs.run_events(spark, sf_dir), "run-7")


@query(
    "event_search",
    with_(_MANIFESTS)
    + """
    SELECT * FROM run_events WHERE agency_id = 'nation-3' AND event_name = 'error'
    AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-25'
    ORDER BY timestamp DESC, event_id LIMIT 100""",
)
def _(spark, sf_dir):
    return ledger.search_events(
        runs.run_events(spark, sf_dir), "nation-3", "error", datetime(2024, 1, 10), datetime(2024, 1, 25)
    )


@query(
    "role_access",
    """
    SELECT *, user_agency_id = agency_id AND role <> 'guest' AS can_view,
           user_agency_id = agency_id AND role IN ('admin', 'operator') AS can_modify
    FROM (SELECT event_id, ['admin', 'operator', 'viewer', 'analyzer', 'guest'][user_id % 5 + 1] AS role,
                 concat('nation-', user_id % 3) AS user_agency_id, concat('nation-', event_id % 3) AS agency_id
          FROM events)""",
)
def _(spark, sf_dir):
    return ledger.with_access(runs.access_requests(spark, sf_dir))


@query(
    "run_metrics",
    "SELECT concat('service-', user_id % 3) AS service, event_type AS status, "
    "concat('nation-', user_id % 25) AS agency_id, count(*) AS requests_total, "
    "count(*) FILTER (event_type = 'error') AS errors_total, "
    + ", ".join(
        f"count(*) FILTER (value / 100 <= {bound}) AS le_{str(bound).replace('.', '_')}"
        for bound in ledger.DURATION_BOUNDS
    )
    + ", count(value) AS le_inf FROM events GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    return ledger.run_metrics(runs.requests(spark, sf_dir))


@query(
    "weighted_assign",
    """
    SELECT event_id, CASE WHEN point < 0.7 THEN 'model-a' WHEN point < 0.9 THEN 'model-b' ELSE 'model-c' END AS model
    FROM (SELECT event_id, CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296
                           AS point FROM events)""",
)
def _(spark, sf_dir):
    choice = ledger.weighted_choice(F.col("event_id"), "model-a:0.7,model-b:0.2,model-c:0.1", "model-a")
    return read_table(spark, sf_dir, "events").select("event_id", choice.alias("model"))


# -- activity and profiles --------------------------------------------------

EVENT_SERIES = """
    SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS event_count,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events GROUP BY 1, 2"""


@query("event_time_series", EVENT_SERIES)
def _(spark, sf_dir):
    return profiles.event_time_series(read_table(spark, sf_dir, "events"))


@query(
    "economic_trend",
    """
    SELECT month, order_count, order_value,
           round((order_value - lag(order_value) OVER (ORDER BY month)) / lag(order_value) OVER (ORDER BY month) * 100, 2)
               AS change_percent
    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS order_count,
                 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value FROM orders GROUP BY 1)""",
)
def _(spark, sf_dir):
    return profiles.economic_trend(read_table(spark, sf_dir, "orders"))


@query(
    "timeline_index",
    """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, ts, event_id, event_type
    FROM (SELECT * REPLACE (CASE WHEN event_id % 11 <> 4 THEN user_id END AS user_id) FROM events)""",
)
def _(spark, sf_dir):
    # Some events have no user; they have a timeline of their own.
    user = F.when(F.col("event_id") % 11 != 4, F.col("user_id")).alias("user_id")
    rows = read_table(spark, sf_dir, "events").select(user, "ts", "event_id", "event_type")
    return profiles.timeline(rows, "user_id", "ts", "event_id")


_DICTIONARY = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query(
    "data_dictionary",
    " UNION ALL ".join(
        f"""SELECT 'orders' AS table_name, CAST({i} AS INTEGER) AS position, '{name}' AS column_name,
        '{kind}' AS data_type, count({name}) AS filled, count(*) - count({name}) AS empty,
        CAST(min({name}) AS VARCHAR) AS min_value, CAST(max({name}) AS VARCHAR) AS max_value FROM orders"""
        for i, (name, kind) in enumerate(_DICTIONARY, start=1)
    ),
)
def _(spark, sf_dir):
    return profiles.data_dictionary(read_table(spark, sf_dir, "orders"), "orders")


_ARCHIVED = {
    "agencies": ("agencies", "id,slug,name,short_name,parent_slug,child_count,cfr_reference_count,checksum"),
    "cfr_references": ("reference_sums", "agency_slug,title,chapter,subtitle,part,checksum"),
    "corrections": (
        "corrections",
        "ecfr_id,cfr_reference,title,chapter,part,section,corrective_action,error_occurred,"
        "error_corrected,lag_days,fr_citation,year,checksum",
    ),
}


@query(
    "archival_manifest",
    with_(AGENCIES, CORRECTIONS, f"reference_sums AS (SELECT {REFERENCE_CHECKSUM} AS checksum FROM refs)")
    + " UNION ALL ".join(
        f"SELECT *, '{columns}' AS columns FROM ({digest_sql(name, table)})"
        for name, (table, columns) in _ARCHIVED.items()
    ),
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    tables = {
        "agencies": domain.stored_agencies(),
        "cfr_references": domain.stored_references(),
        "corrections": domain.stored_corrections(),
    }
    return profiles.archival_manifest(
        {name: df.select(*_ARCHIVED[name][1].split(",")) for name, df in tables.items()}
    )


@query(
    "archival_verify",
    with_(
        CORRECTIONS,
        f"""
    revised AS (
        SELECT {CORRECTION_CHECKSUM} AS checksum FROM (
            SELECT * REPLACE (CASE WHEN ecfr_id % 37 = 1 THEN concat(corrective_action, ' (revised)')
                                   ELSE corrective_action END AS corrective_action)
            FROM corrections WHERE ecfr_id % 101 <> 5)),
    archived AS ({lane_digest('corrections')}),
    present AS ({lane_digest('revised')})""",
    )
    + """
    SELECT bucket, coalesce(a.n, 0) AS archived_count, coalesce(p.n, 0) AS current_count,
           a.digest IS NOT DISTINCT FROM p.digest AS matches
    FROM archived a FULL JOIN present p USING (bucket)""",
)
def _(spark, sf_dir):
    domain = load_domain(spark, sf_dir)
    return profiles.verify_archive(
        domain.stored_corrections(), snapshots.later(domain).stored_corrections()
    )
