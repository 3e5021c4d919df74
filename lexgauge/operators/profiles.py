"""Activity series, trends, timelines and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexgauge.functions.checksums import bucket_digests, table_digest
from lexgauge.functions.ordering import with_row_number_per
from lexgauge.operators.privacy import with_row_checksum


def event_time_series(events: DataFrame) -> DataFrame:
    """Events per day and type."""
    return events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(
        F.count("*").alias("event_count"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"),
    )


def economic_trend(orders: DataFrame) -> DataFrame:
    """Orders and value per month, with the change from the month before."""
    monthly = orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        F.count("*").alias("order_count"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("_value"),
    )
    # One row per calendar month reaches this window.
    before = F.lag("_value").over(Window.orderBy("month"))
    value = F.col("_value").cast("double")
    return monthly.withColumn("_before", before.cast("double")).select(
        "month",
        "order_count",
        value.alias("order_value"),
        F.round((value - F.col("_before")) / F.col("_before") * 100, 2).alias("change_percent"),
    )


def timeline(events: DataFrame, entity: str, time: str, key: str) -> DataFrame:
    """Every entity's events with their position in time, starting at 1."""
    return with_row_number_per(events, entity, [time, key], "position")


def data_dictionary(df: DataFrame, table_name: str) -> DataFrame:
    """Per column: type, filled and empty values, smallest and largest value."""
    measures = []
    for i, (name, _) in enumerate(df.dtypes):
        column = F.col(f"`{name}`")
        measures += [
            F.count(column).alias(f"_{i}_filled"),
            F.min(column).cast("string").alias(f"_{i}_min"),
            F.max(column).cast("string").alias(f"_{i}_max"),
        ]
    profile = df.agg(F.count("*").alias("_rows"), *measures)
    columns = F.array(
        *[
            F.struct(
                F.lit(table_name).alias("table_name"),
                F.lit(i + 1).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("data_type"),
                F.col(f"_{i}_filled").alias("filled"),
                (F.col("_rows") - F.col(f"_{i}_filled")).alias("empty"),
                F.col(f"_{i}_min").alias("min_value"),
                F.col(f"_{i}_max").alias("max_value"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
    )
    return profile.select(F.inline(columns))


def archival_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, digest and columns, to be verified later."""
    result = None
    for name, df in tables.items():
        row = table_digest(df, name).withColumn("columns", F.lit(",".join(df.columns)))
        result = row if result is None else result.unionByName(row)
    return result


def package_manifest(tables: dict[str, DataFrame], package: str) -> DataFrame:
    """Per table of a package: its place, rows, digest over all columns, columns, and a chain of the digests so far.

    The chain of the last table stands for the whole package: no table can be
    altered, left out or moved without changing it.  Tables come in the order
    in which they are given.
    """
    order = {name: place for place, name in enumerate(tables, start=1)}
    digested = archival_manifest({name: with_row_checksum(df) for name, df in tables.items()})
    places = F.create_map(*(x for name, place in order.items() for x in (F.lit(name), F.lit(place))))
    entry = F.struct(
        F.element_at(places, F.col("table_name")).alias("position"),
        "table_name",
        "record_count",
        "aggregate_checksum",
        F.regexp_replace("columns", ",checksum$", "").alias("columns"),
    )
    # One row per table of the package.
    gathered = digested.agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def chained(upto: Column) -> Column:
        before = F.slice("entries", 1, upto)
        return F.aggregate(
            before, F.sha2(F.lit(package), 256), lambda chain, e: F.sha2(F.concat_ws("|", chain, e["table_name"], e["record_count"], e["aggregate_checksum"]), 256)
        )

    rows = F.transform("entries", lambda e, k: F.struct(F.lit(package).alias("package"), e["position"].alias("position"), e["table_name"].alias("table_name"), e["record_count"].alias("record_count"), e["aggregate_checksum"].alias("digest"), e["columns"].alias("columns"), chained(k + 1).alias("chain")))
    return gathered.select(F.inline(rows))


def schema_problems(tables: dict[str, DataFrame], expected: dict[str, str]) -> DataFrame:
    """A row per column that a table lacks, has in another type or has beside the expected ones.

    ``expected`` holds schemas as DDL text by table; tables without one are not looked at.
    """
    found = []
    for name, df in tables.items():
        if name not in expected:
            continue
        wanted = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(expected[name])}
        has = dict(df.dtypes)
        found += [(name, c, "missing") for c in wanted if c not in has]
        found += [(name, c, f"{has[c]} instead of {kind}") for c, kind in wanted.items() if has.get(c, kind) != kind]
        found += [(name, c, "unexpected") for c in has if c not in wanted]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "table_name string, column_name string, problem string")


def verify_archive(archived: DataFrame, current: DataFrame) -> DataFrame:
    """Bucket by bucket, whether a table still is what was archived."""
    then = bucket_digests(archived).select(
        "bucket", F.col("record_count").alias("archived_count"), F.col("digest").alias("_then")
    )
    now = bucket_digests(current).select(
        "bucket", F.col("record_count").alias("current_count"), F.col("digest").alias("_now")
    )
    return then.join(now, "bucket", "full_outer").select(
        "bucket",
        F.coalesce("archived_count", F.lit(0)).alias("archived_count"),
        F.coalesce("current_count", F.lit(0)).alias("current_count"),
        F.col("_then").eqNullSafe(F.col("_now")).alias("matches"),
    )
