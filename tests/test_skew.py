"""Queries on data where one key holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexgauge.sources.tables import SCHEMAS, read_table
from tests.compare import difference, duck

NAMES = [
    "agency_metrics",
    "scorecard",
    "trends_yearly",
    "export_corrections",
    "agency_year_matrix",
    "child_count_check",
    "orphan_references",
    "duplicate_keys",
    "table_digest_bucketed",
    "k_anonymity",
    "linkage",
    "checkpoint_latest",
    "event_log",
    "event_replay",
    "timeline_index",
    "stream_event_log",
]


@pytest.fixture(scope="module")
def skewed(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))

    def hot(key, column, value):
        return {column: F.when(F.col(key) % 3 == 0, F.lit(value)).otherwise(F.col(column))}

    changes = {
        "lineitem": {**hot("l_orderkey", "l_orderkey", 3), **hot("l_partkey", "l_partkey", 5)},
        "events": hot("event_id", "user_id", 7),
        "part": hot("p_partkey", "p_size", 12),
        "supplier": hot("s_suppkey", "s_nationkey", 4),
        "orders": hot("o_orderkey", "o_custkey", 9),
    }
    for name, schema in SCHEMAS.items():
        df = read_table(spark, sf_dir, name).withColumns(changes.get(name, {"_": F.lit(1)})).drop("_")
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in read_table(spark, sf_dir, name).schema])
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, name):
    connection = duck(skewed)
    result = entry.queries()[name](spark, skewed)
    assert difference(result, connection, entry.oracle_sql()[name]) is None
