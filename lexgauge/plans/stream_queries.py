"""Registered queries that run a stream over the event files to its end."""

from __future__ import annotations

import uuid

from lexgauge.plans.ledger_queries import EVENT_SERIES, LATEST_CHECKPOINTS
from lexgauge.plans.registry import query
from lexgauge.session import checkpoint_root
from lexgauge.streaming import checkpoints
from lexgauge.streaming import events as stream


def _event_files(sf_dir: str) -> str:
    # As a glob it may name one file or a folder of files.
    return f"{sf_dir}/event[s].parquet"


def _work_folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"


@query("stream_activity", EVENT_SERIES)
def _(spark, sf_dir):
    folder = _work_folder(spark, "activity")
    activity = stream.daily_activity(stream.read_events(spark, _event_files(sf_dir)), "1 day")
    stream.write_activity(activity, f"{folder}/out", f"{folder}/state").awaitTermination()
    return stream.current_activity(spark, f"{folder}/out")


@query("stream_event_log", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(spark, sf_dir):
    folder = _work_folder(spark, "log")
    # Every event is delivered twice; the log keeps one of each.
    once = stream.read_events(spark, _event_files(sf_dir))
    twice = once.unionByName(stream.read_events(spark, _event_files(sf_dir)))
    stream.write_log(stream.distinct_events(twice, "1 day"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_checkpoints", LATEST_CHECKPOINTS)
def _(spark, sf_dir):
    folder = _work_folder(spark, "checkpoints")
    table = checkpoints.CheckpointTable(spark, f"{folder}/table")
    table.follow(checkpoints.read_saves(spark, _event_files(sf_dir)), f"{folder}/state").awaitTermination()
    return table.current()
