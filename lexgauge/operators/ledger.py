"""Run ledger: checkpoints, events, tenancy, roles, metrics, assignment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.checksums import with_record_checksum
from lexgauge.functions.ordering import with_row_number, with_row_number_per

RETENTION_DAYS = 30
SEARCH_CAP = 100

# What a role may do with its own agency's rows; histogram bounds.
ROLES = [
    ("admin", True, True),
    ("operator", True, True),
    ("viewer", True, False),
    ("analyzer", True, False),
]
DURATION_BOUNDS = [0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0]


def at(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


# -- checkpoints ------------------------------------------------------------


def with_checkpoint_hash(checkpoints: DataFrame, out: str = "checkpoint_hash") -> DataFrame:
    names = ["run_id", "agency_id", "payload", "last_step", "event_count"]
    return with_record_checksum(checkpoints, {n: n for n in names}, out)


def latest_checkpoints(saves: DataFrame) -> DataFrame:
    """Fold all saves of a run into its current checkpoint.

    A first save sets agency, provider, model, status and creation time; later
    saves replace payload, last step and update time.  Saves combine before
    the shuffle, so a run with very many saves is no burden.
    """
    order = F.struct("saved_at", "save_id")
    first = F.min(F.struct(order, "agency_id", "provider_name", "model", "status"))
    last = F.max(F.struct(order, "payload", "last_step"))
    folded = (
        saves.groupBy("run_id")
        .agg(first.alias("first"), last.alias("last"), F.count("*").alias("event_count"))
        .select(
            "run_id",
            "first.agency_id",
            "first.provider_name",
            "first.model",
            "first.status",
            "last.payload",
            "last.last_step",
            "event_count",
            F.col("first.col1.saved_at").alias("created_at"),
            F.col("last.col1.saved_at").alias("updated_at"),
        )
        .withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.lit(RETENTION_DAYS)))
    )
    return with_checkpoint_hash(folded)


def verify_integrity(checkpoints: DataFrame, as_of: datetime) -> DataFrame:
    """Stored hash against the recomputed one, with the time of a mismatch."""
    valid = F.col("checkpoint_hash") == F.col("verified_hash")
    return with_checkpoint_hash(checkpoints, "verified_hash").select(
        "run_id",
        F.col("checkpoint_hash").alias("computed_hash"),
        "verified_hash",
        valid.alias("integrity_valid"),
        at(as_of).alias("last_verified_at"),
        (~valid).alias("hash_mismatch_detected"),
        F.when(~valid, at(as_of)).alias("mismatch_detected_at"),
    )


def load_checkpoint(
    checkpoints: DataFrame, integrity: DataFrame, run_id: str, agency_id: str, as_of: datetime
) -> DataFrame:
    """One run's checkpoint if it is the tenant's and not expired, else nothing."""
    found = tenant_rows(checkpoints, agency_id).filter(
        (F.col("run_id") == run_id) & (F.col("expires_at") > at(as_of))
    )
    validity = integrity.filter(F.col("run_id") == run_id).select(
        "run_id", F.col("integrity_valid").alias("is_valid")
    )
    return (
        found.join(validity, "run_id", "left")
        .select("run_id", "payload", "event_count", "last_step", "checkpoint_hash", "is_valid")
        .limit(1)
    )


def checkpoint_summary(checkpoints: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    names = (
        events.groupBy("run_id", "event_name")
        .agg(F.lit(1).alias("_one"))
        .groupBy("run_id")
        .agg(F.count("*").alias("_names"))
    )
    return checkpoints.join(names, "run_id", "left").select(
        "run_id",
        "agency_id",
        "provider_name",
        "model",
        "status",
        "event_count",
        "created_at",
        "updated_at",
        "expires_at",
        (F.timestamp_diff("MICROSECOND", F.col("created_at"), at(as_of)) / 1_000_000).alias(
            "duration_seconds"
        ),
        (F.col("expires_at") > at(as_of)).alias("is_valid"),
        F.coalesce("_names", F.lit(0)).alias("unique_events"),
    )


def unexpired(checkpoints: DataFrame, as_of: datetime) -> DataFrame:
    """What a cleanup at ``as_of`` keeps; write it in place of the old set."""
    return checkpoints.filter(~(F.col("expires_at") < at(as_of)))


def expiry_counts(checkpoints: DataFrame, as_of: datetime) -> DataFrame:
    expired = F.col("expires_at") < at(as_of)
    return checkpoints.agg(
        F.count_if(expired).alias("deleted_count"), F.count_if(~expired).alias("kept_count")
    )


# -- events -----------------------------------------------------------------


def explode_events(checkpoints: DataFrame, events: str = "events") -> DataFrame:
    """Rows of the nested event lists with their position, starting at 0."""
    return checkpoints.select(
        "checkpoint_id", F.posexplode(events).alias("event_index", "event")
    ).select("checkpoint_id", "event_index", "event.timestamp", "event.event_name")


def event_log(events: DataFrame) -> DataFrame:
    """Number the events of every run from 0 in time order."""
    return with_row_number_per(events, "run_id", ["timestamp", "event_id"], "event_index", start=0)


def replay(events: DataFrame, run_id: str) -> DataFrame:
    """One run's events in order, numbered from 1 as they are listed."""
    one = events.filter(F.col("run_id") == run_id)
    return with_row_number(one, ["timestamp", "event_id"], "position")


def search_events(
    events: DataFrame,
    agency_id: str,
    event_name: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    limit: int | None = SEARCH_CAP,
) -> DataFrame:
    """A tenant's newest events, by name and time."""
    rows = tenant_rows(events, agency_id)
    if event_name is not None:
        rows = rows.filter(F.col("event_name") == event_name)
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= at(since))
    if until is not None:
        rows = rows.filter(F.col("timestamp") < at(until))
    ordered = rows.orderBy(F.desc("timestamp"), "event_id")
    return ordered if limit is None else ordered.limit(limit)


# -- tenancy and roles ------------------------------------------------------


def tenant_rows(df: DataFrame, agency_id: str) -> DataFrame:
    """The only way to a tenant's rows; the tenant must be named."""
    if not agency_id:
        raise ValueError("a tenant is required")
    return df.filter(F.col("agency_id") == agency_id)


def foreign_rows(df: DataFrame, agency_id: str) -> DataFrame:
    """Rows that do not belong to the tenant; empty when isolation holds."""
    return df.filter(~F.col("agency_id").eqNullSafe(agency_id))


def with_access(requests: DataFrame) -> DataFrame:
    """Add what each request's role may do; other agencies' rows are closed."""
    rows = ", ".join(f"('{role}', {view}, {modify})" for role, view, modify in ROLES)
    roles = requests.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS roles(role, _view, _modify)")
    own = F.col("user_agency_id") == F.col("agency_id")
    return (
        requests.join(roles, "role", "left")
        .withColumn("can_view", F.coalesce(own & F.col("_view"), F.lit(False)))
        .withColumn("can_modify", F.coalesce(own & F.col("_modify"), F.lit(False)))
        .drop("_view", "_modify")
    )


# -- metrics and assignment -------------------------------------------------


def run_metrics(requests: DataFrame) -> DataFrame:
    """Request counters and a cumulative duration histogram."""
    buckets = [
        F.count_if(F.col("duration_seconds") <= bound).alias(f"le_{str(bound).replace('.', '_')}")
        for bound in DURATION_BOUNDS
    ]
    return requests.groupBy("service", "status", "agency_id").agg(
        F.count("*").alias("requests_total"),
        F.count_if(F.col("status") == "error").alias("errors_total"),
        *buckets,
        F.count("duration_seconds").alias("le_inf"),
    )


def parse_weights(weights: str) -> list[tuple[str, float]]:
    """``name:weight,...`` as cumulative shares of 1; bad parts are left out."""
    parsed: list[tuple[str, float]] = []
    for part in weights.split(","):
        name, _, number = part.rpartition(":")
        try:
            weight = float(number)
        except ValueError:
            continue
        if name and weight > 0:
            parsed.append((name.strip(), weight))
    total = sum(weight for _, weight in parsed)
    shares, running = [], 0.0
    for name, weight in parsed:
        running += weight
        shares.append((name, running / total))
    return shares


def weighted_choice(key: Column, weights: str, default: str) -> Column:
    """A variant per row, fixed by the key's hash and shared by the weights."""
    shares = parse_weights(weights)
    if not shares:
        return F.lit(default)
    point = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 2**32
    choice = F.when(F.lit(False), F.lit(default))
    for name, upper in shares[:-1]:
        choice = choice.when(point < upper, F.lit(name))
    return choice.otherwise(F.lit(shares[-1][0]))
