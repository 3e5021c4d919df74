from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexgauge.operators import ledger
from lexgauge.sources.runs import saves_of
from lexgauge.sources.tables import read_table
from lexgauge.streaming import checkpoints
from lexgauge.streaming.checkpoints import CheckpointTable

SAVES = (
    "run_id string, save_id bigint, saved_at timestamp_ntz, agency_id string, provider_name string, model string, "
    "status string, payload string, last_step string"
)


def rows_of(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=lambda r: r["run_id"])


def save(run, number, day, status="START"):
    moment = datetime(2024, 1, 1) + timedelta(days=day, minutes=number)
    return (run, number, moment, "a", "p", "m", status, f'{{"n":{number}}}', f"s{number}")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_any_split_into_batches(spark, sf_dir, tmp_path, parts):
    saves = saves_of(read_table(spark, sf_dir, "events"))
    table = CheckpointTable(spark, str(tmp_path), buckets=7)
    for batch in range(parts):
        # Not in time order: each part has saves from all over.
        table.apply(saves.where(F.pmod(F.xxhash64("save_id"), F.lit(parts)) == batch), batch)
    assert rows_of(table.current()) == rows_of(ledger.latest_checkpoints(saves))


def test_a_replayed_batch_changes_nothing(spark, sf_dir, tmp_path):
    saves = saves_of(read_table(spark, sf_dir, "events"))
    table = CheckpointTable(spark, str(tmp_path), buckets=5)
    halves = [saves.where("save_id % 2 = 0"), saves.where("save_id % 2 = 1")]
    for batch, half in [(0, halves[0]), (0, halves[0]), (1, halves[1]), (1, halves[1])]:
        table.apply(half, batch)
    assert rows_of(table.current()) == rows_of(ledger.latest_checkpoints(saves))


def test_a_batch_that_fails_leaves_the_last_commit(spark, tmp_path, monkeypatch):
    table = CheckpointTable(spark, str(tmp_path), buckets=3)
    first = spark.createDataFrame([save(f"r{k}", k, 0) for k in range(20)], SAVES)
    second = spark.createDataFrame([save(f"r{k}", 50 + k, 1) for k in range(10, 30)], SAVES)
    table.apply(first, 0)
    before = rows_of(table.current())
    # The state of the batch is there, its commit is not.
    rows = checkpoints.merge_folds(checkpoints.fold_saves(second, 3))
    rows.write.partitionBy("bucket").parquet(f"{tmp_path}/state/batch=1")
    assert rows_of(table.current()) == before
    table.apply(second, 1)
    assert rows_of(table.current()) == rows_of(ledger.latest_checkpoints(first.union(second)))


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = CheckpointTable(spark, str(tmp_path), buckets=16)
    table.apply(spark.createDataFrame([save(f"r{k}", k, 0) for k in range(200)], SAVES), 0)
    table.apply(spark.createDataFrame([save("r7", 999, 2)], SAVES), 1)
    versions = [c["version"] for c in table._commit_before(None) if c["bucket"] >= 0]
    assert len(versions) == 16 and versions.count(1) == 1
    assert {r["run_id"]: r["event_count"] for r in table.current().collect()}["r7"] == 2


def slow_with_expiry(batches):
    """The state after each batch, by a plain dictionary of runs."""
    state, latest = {}, datetime.min
    for batch in batches:
        for row in batch:
            latest = max(latest, row[2])
        for row in sorted(batch, key=lambda r: (r[2], r[1])):
            created, count, last = state.get(row[0], (row[2], 0, row[1:3] + row[7:8]))
            newest = max((last[1], last[0], last[2]), (row[2], row[1], row[7]))
            state[row[0]] = (min(created, row[2]), count + 1, (newest[1], newest[0], newest[2]))
        state = {k: v for k, v in state.items() if not v[0] + timedelta(days=ledger.RETENTION_DAYS) < latest}
    return {k: (created, count, last[2]) for k, (created, count, last) in state.items()}


def test_runs_end_as_state_ages(spark, tmp_path):
    batches = [
        [save("a", 1, 0), save("b", 2, 5), save("c", 3, 5)],
        [save("b", 4, 20), save("d", 5, 29)],
        [save("d", 6, 33)],  # a has ended, though its bucket is not touched
        [save("a", 7, 34), save("e", 8, 36)],  # a starts anew, b and c have ended
        [save("e", 9, 30)],
        [],
        [save("f", 10, 90)],
    ]
    table = CheckpointTable(spark, str(tmp_path), buckets=4, expire=True)
    for number, batch in enumerate(batches):
        for _ in range(2):
            table.apply(spark.createDataFrame(batch, SAVES), number)
        expected = slow_with_expiry(batches[: number + 1])
        found = {r["run_id"]: (r["created_at"], r["event_count"], r["payload"]) for r in table.current().collect()}
        assert found == expected


def test_current_as_of(spark, tmp_path):
    table = CheckpointTable(spark, str(tmp_path))
    assert table.current().count() == 0
    table.apply(spark.createDataFrame([save("a", 1, 0), save("b", 2, 20)], SAVES), 0)
    assert [r["run_id"] for r in table.current(datetime(2024, 2, 5)).collect()] == ["b"]


def test_stream_resumes(spark, sf_dir, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    events = read_table(spark, sf_dir, "events")
    table = CheckpointTable(spark, str(tmp_path / "table"), buckets=4)
    for part in (events.where("event_id % 3 = 0"), events.where("event_id % 3 > 0")):
        part.repartition(3).write.mode("append").parquet(source)
        table.follow(checkpoints.read_saves(spark, source, files_per_batch=2), state).awaitTermination()
    assert table.commits().select("batch").distinct().count() == 4
    assert rows_of(table.current()) == rows_of(ledger.latest_checkpoints(saves_of(events)))
