"""Event streams from parquet files: activity, de-duplicated log, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgauge.sources.tables import SCHEMAS

_COPY_SALTS = 16


# Watermarks need a TIMESTAMP: the zone-free time is counted from the epoch as
# if it were UTC, whatever the session zone, and turned back the same way.
_TO_INSTANT = "TIMESTAMP '1970-01-01 00:00:00Z' + ({0} - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
_TO_LOCAL = "TIMESTAMP_NTZ '1970-01-01 00:00:00' + ({0} - TIMESTAMP '1970-01-01 00:00:00Z')"


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files under a folder or glob as a stream with the event time ``at``."""
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("at", F.expr(_TO_INSTANT.format("ts"))).drop("ts")


def daily_activity(events: DataFrame, lateness: str) -> DataFrame:
    """Events per day and type; state of closed days is dropped.

    Choose ``lateness`` no smaller than the events' real delay: what arrives
    later, in a later batch, is not counted any more.  The batch job
    ``event_time_series`` counts everything.
    """
    return (
        events.withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("window"), "event_type")
        .agg(
            F.count("*").alias("event_count"),
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"),
        )
        .select(
            F.expr(_TO_LOCAL.format("window.start")).cast("date").alias("day"),
            "event_type",
            "event_count",
            "total_value",
        )
    )


def write_activity(activity: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write every batch's changed days into a folder of its own.

    A repeated batch replaces its folder, so a restart from the checkpoint
    never counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        activity.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_activity(spark: SparkSession, out: str) -> DataFrame:
    """The newest figures per day and type."""
    rows = spark.read.parquet(out)
    newest = F.max(F.struct("batch", "event_count", "total_value")).alias("newest")
    return rows.groupBy("day", "event_type").agg(newest).select(
        "day", "event_type", "newest.event_count", "newest.total_value"
    )


def distinct_events(events: DataFrame, lateness: str) -> DataFrame:
    """The event log without repeated deliveries.

    Repeats are told by id within the lateness, so state stays bounded; events
    that come in a later batch and even later than that are left out.  An
    event delivered a great many times is first thinned out in several tasks,
    before its last copies meet in one.
    """
    spread = events.withWatermark("at", lateness).withColumn(
        "_salt", F.spark_partition_id() % _COPY_SALTS
    )
    return (
        spread.dropDuplicatesWithinWatermark(["event_id", "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark(["event_id"])
        .withColumn("ts", F.expr(_TO_LOCAL.format("at")))
        .drop("at")
    )


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the state and were left out, over the batches the query still remembers."""
    return sum(
        state["numRowsDroppedByWatermark"] for batch in query.recentProgress for state in batch["stateOperators"]
    )


def write_log(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        events.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
