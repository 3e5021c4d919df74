"""Current checkpoints, kept up to date from a stream of saves.

The state is a snapshot in buckets by run.  A batch folds its own saves first,
merges them with the buckets it touches and writes those anew under its batch
number; a commit then names the batch that each bucket is to be read from.
Readers see the last commit, so a batch that fails halfway, or is repeated,
changes nothing for them and is never counted twice.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgauge.operators import ledger
from lexgauge.session import materialize
from lexgauge.sources.runs import saves_of
from lexgauge.sources.tables import SCHEMAS

#: Buckets of the snapshot: a commit holds a row for each, and one for itself.
BUCKETS = 64
_ITSELF = -1
_STATE = (
    "run_id string, bucket int, first struct<saved_at: timestamp_ntz, save_id: bigint, agency_id: string, "
    "provider_name: string, model: string, status: string>, last struct<saved_at: timestamp_ntz, save_id: bigint, "
    "payload: string, last_step: string>, event_count bigint"
)
_COMMIT = "batch bigint, bucket int, version bigint, oldest timestamp_ntz, latest timestamp_ntz"


def read_saves(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files under a folder or glob as a stream of saves."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return saves_of(reader.parquet(path))


def fold_saves(saves: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per run: its first and last save and how many there were.

    Rows of this form can be merged in any order and number, as the smallest
    and largest save and a sum are all that is kept.
    """
    saved = ["saved_at", "save_id"]
    return saves.groupBy("run_id").agg(
        F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int").alias("bucket"),
        F.min(F.struct(*saved, "agency_id", "provider_name", "model", "status")).alias("first"),
        F.max(F.struct(*saved, "payload", "last_step")).alias("last"),
        F.count("*").alias("event_count"),
    )


def merge_folds(*folds: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, folds)
    return rows.groupBy("run_id", "bucket").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("event_count").alias("event_count")
    )


def _end(created: Column) -> Column:
    return created + F.make_dt_interval(F.lit(ledger.RETENTION_DAYS))


def as_checkpoints(folds: DataFrame) -> DataFrame:
    """Folded rows in the columns of ``latest_checkpoints``."""
    return ledger.with_checkpoint_hash(
        folds.select(
            "run_id",
            "first.agency_id",
            "first.provider_name",
            "first.model",
            "first.status",
            "last.payload",
            "last.last_step",
            "event_count",
            F.col("first.saved_at").alias("created_at"),
            F.col("last.saved_at").alias("updated_at"),
            _end(F.col("first.saved_at")).alias("expires_at"),
        )
    )



class CheckpointTable:
    """The snapshot under ``path``.

    With ``expire``, runs whose retention ended before the newest save that was
    seen are taken out of a bucket whenever it is written, and untouched
    buckets are written once their oldest run has ended; a run that is saved
    again after that starts anew.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, expire: bool = False) -> None:
        self.spark, self.path, self.buckets, self.expire = spark, path, buckets, expire

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMIT)

    def _commit_before(self, batch: int | None) -> list:
        """The rows of the last commit before ``batch`` (or of all): one per bucket that has any, and its own."""
        commits = self.commits() if batch is None else self.commits().where(F.col("batch") < batch)
        newest = commits.agg(F.max("batch")).first()[0]
        return [] if newest is None else commits.where(F.col("batch") == newest).collect()

    def _read(self, spark: SparkSession, commit: list, buckets: set[int] | None = None) -> DataFrame:
        wanted = [c for c in commit if c["bucket"] != _ITSELF and (buckets is None or c["bucket"] in buckets)]
        paths = [f"{self.path}/state/batch={c['version']}/bucket={c['bucket']}" for c in wanted]
        if not paths:
            return spark.createDataFrame([], _STATE)
        rows = spark.read.schema(_STATE).option("basePath", f"{self.path}/state").parquet(*paths)
        return rows.select("run_id", "bucket", "first", "last", "event_count")

    def folds(self) -> DataFrame:
        """The state as of the last commit."""
        return self._read(self.spark, self._commit_before(None))

    def current(self, as_of: datetime | None = None) -> DataFrame:
        """The checkpoints as of the last commit; with ``as_of``, without those that have ended by then."""
        rows = as_checkpoints(self.folds())
        return rows if as_of is None else ledger.unexpired(rows, as_of)

    def apply(self, saves: DataFrame, batch: int) -> None:
        """Merge the saves of one batch and commit; a repeated batch starts from the commit before it, as at first."""
        spark, before = saves.sparkSession, self._commit_before(batch)
        folded = materialize(fold_saves(saves, self.buckets))
        # A few numbers: the touched buckets and the newest save.
        seen = folded.agg(F.collect_set("bucket").alias("buckets"), F.max("last.saved_at").alias("latest")).first()
        latest = max((t for t in [seen["latest"], *(c["latest"] for c in before)] if t is not None), default=None)
        touched = set(seen["buckets"])
        if self.expire and latest is not None:
            touched |= {c["bucket"] for c in before if c["oldest"] is not None and self._ended(c["oldest"], latest)}
        rows = merge_folds(folded, self._read(spark, before, touched))
        if self.expire and latest is not None:
            rows = rows.where(~self._old(F.col("first.saved_at"), latest))
        state = f"{self.path}/state/batch={batch}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(state)
        written = spark.read.schema(_STATE).parquet(state)
        fresh = written.groupBy("bucket").agg(F.min("first.saved_at").alias("oldest")).collect()
        kept = [(c["bucket"], c["version"], c["oldest"]) for c in before if c["bucket"] not in touched | {_ITSELF}]
        commit = kept + [(r["bucket"], batch, r["oldest"]) for r in fresh] + [(_ITSELF, batch, None)]
        table = spark.createDataFrame([(batch, *c, latest) for c in commit], _COMMIT)
        # One file, so that a commit is there as a whole or not at all; its folder is the batch's own.
        table.coalesce(1).drop("batch").write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    @staticmethod
    def _ended(created: datetime, latest: datetime) -> bool:
        return (latest - created).total_seconds() > ledger.RETENTION_DAYS * 86_400

    @staticmethod
    def _old(created: Column, latest: datetime) -> Column:
        return _end(created) < ledger.at(latest)

    def follow(self, saves: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply a stream of saves batch by batch until its present end."""
        return (
            saves.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
