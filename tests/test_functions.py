"""Global order, ranks and digests: ties, skew and independence from layout."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexgauge.functions.checksums import bucket_digests, table_digest
from lexgauge.functions.ordering import with_ranks, with_row_number, with_row_number_per


def skewed(n=3000):
    """A third of all rows share one key."""
    rng = random.Random(7)
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", rng.randrange(1000)) for i in range(n)]


def test_row_number_is_the_sorted_position(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id int, key string, v int").repartition(7)
    got = {r.id: r.n for r in with_row_number(df, ["key", F.desc("v"), "id"], "n").collect()}
    expected = sorted(rows, key=lambda r: (r[1], -r[2], r[0]))
    assert got == {row[0]: i for i, row in enumerate(expected, start=1)}


def test_row_number_per_key(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id int, key string, v int").repartition(5)
    got = {r.id: r.n for r in with_row_number_per(df, "key", ["v", "id"], "n", start=0).collect()}
    expected, seen = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        expected[row[0]] = seen.get(row[1], 0)
        seen[row[1]] = expected[row[0]] + 1
    assert got == expected


def test_ranks_with_ties_and_nulls(spark):
    rows = [(i, None if i % 10 == 0 else float(i * 7 % 23), i % 2 * 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(3)
    ranked = with_ranks(df, {"up": F.col("a"), "down": -F.col("a"), "few": F.col("b")}, total="n")
    by_id = {r.id: r for r in ranked.collect()}

    def rank(values, mine):
        if mine is None:
            return 1 + sum(v is not None for v in values)
        return 1 + sum(v is not None and v < mine for v in values)

    ups, downs, fews = [r[1] for r in rows], [None if r[1] is None else -r[1] for r in rows], [r[2] for r in rows]
    assert len(by_id) == 400
    for i, (_, a, b) in enumerate(rows):
        assert by_id[i].up == rank(ups, a)
        assert by_id[i].down == rank(downs, None if a is None else -a)
        assert by_id[i].few == rank(fews, b)
        assert by_id[i].n == 400


def test_digest_ignores_order_but_not_copies(spark):
    rows = [(i, hashlib.sha256(str(i % 50).encode()).hexdigest()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, checksum string")

    def digest(frame):
        return table_digest(frame, "t").first().aggregate_checksum

    whole = digest(df)
    assert digest(df.orderBy(F.desc("id")).repartition(9)) == whole
    assert digest(df.filter("id != 3")) != whole
    assert digest(df.unionByName(df.limit(1))) != whole
    assert digest(df.withColumn("checksum", F.when(F.col("id") == 7, F.reverse("checksum")).otherwise(F.col("checksum")))) != whole
    assert table_digest(df, "t").first().record_count == 500


def test_digest_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, checksum string")
    assert bucket_digests(empty).count() == 0
    assert table_digest(empty, "t").first().record_count == 0


def test_digest_of_very_many_equal_rows_does_not_overflow(spark):
    df = spark.createDataFrame([("f" * 64,)], "checksum string").crossJoin(spark.range(3)).drop("id")
    lanes = bucket_digests(df)
    assert "decimal" in lanes._jdf.queryExecution().optimizedPlan().toString()
    assert lanes.first().record_count == 3
