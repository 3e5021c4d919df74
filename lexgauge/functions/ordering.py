"""Global positions and ranks that never gather a table in one task."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.session import materialize

# monotonically_increasing_id() keeps the partition number above this bit.
_PARTITION_SHIFT = 33
_LEAST_SLICES = 64
# Ranked values keep whole numbers beyond 2**53 apart, which doubles do not.
_RANK_TYPE = "decimal(38,6)"


def with_row_number(df: DataFrame, order_by: list[Column | str], out: str = "row_number") -> DataFrame:
    """Number all rows 1..n in the order of ``order_by``, which must be unique.

    Rows are split by range over the whole ordering key and sorted inside each
    slice, so a hot leading key spreads over several slices.  The slices are
    written once; only their sizes, one row per slice, are summed centrally.
    """
    placed = materialize(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_place", _PARTITION_SHIFT))
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .agg(F.count("*").alias("_size"))
        # At most one row per shuffle partition reaches this window.
        .select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.col("_place") - F.shiftleft("_slice", _PARTITION_SHIFT)
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(out, (F.col("_offset") + inside + 1).cast("bigint"))
        .drop("_place", "_slice", "_offset")
    )


def with_row_number_per(
    df: DataFrame, key: str, order_by: list[Column | str], out: str = "row_number", start: int = 1
) -> DataFrame:
    """Number the rows of each ``key`` by ``order_by``, ``start`` first.

    The global number minus the key's smallest global number; no key's rows
    have to meet in one task.  Rows without a key are numbered together.  The
    smallest numbers are written first, so that the planner knows whether they
    are few enough to broadcast.
    """
    numbered = with_row_number(df, [key, *order_by], "_global")
    firsts = materialize(numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_global").alias("_first")))
    return (
        numbered.join(firsts, F.col(key).eqNullSafe(F.col("_key")))
        .withColumn(out, (F.col("_global") - F.col("_first") + start).cast("bigint"))
        .drop("_global", "_first", "_key")
    )


def _sql_array(numbers: Iterable[object], kind: str) -> str:
    return f"CAST(array({', '.join(str(n) for n in numbers)}) AS array<{kind}>)"


def with_ranks(df: DataFrame, ranks: dict[str, Column], total: str | None = None) -> DataFrame:
    """Add competition ranks (ties share the smallest rank, gaps follow).

    ``ranks`` maps an output column to a numeric expression ranked ascending
    (to six decimal places); pass a negated value for descending.  NULL ranks last.  ``total`` names a
    column for the row count.

    All rankings work on their distinct values with the row counts, which are
    written once.  The values are cut into slices at quantiles and counted up
    inside each slice; only the cuts and the slice sizes, a few dozen numbers
    per ranking, pass through the driver.  ``df`` is read twice and should be
    a written table.
    """
    names = list(ranks)
    pairs = [
        F.struct(F.lit(i).alias("_rank"), ranks[name].cast(_RANK_TYPE).alias("_value"))
        for i, name in enumerate(names)
    ]
    values = materialize(
        df.select(F.inline(F.array(*pairs)))
        .groupBy("_rank", "_value")
        .agg(F.count("*").alias("_count"))
    )
    slices = max(_LEAST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / slices for i in range(1, slices)]
    quantiles = values.groupBy("_rank").agg(F.percentile_approx("_value", probs, 10_000).alias("cuts"))
    cuts = {row["_rank"]: sorted(set(row["cuts"] or [])) for row in quantiles.collect()}
    all_cuts = ", ".join(_sql_array(cuts.get(i, []), _RANK_TYPE) for i in range(len(names)))
    sliced = values.withColumn(
        "_slice",
        F.expr(
            f"CASE WHEN _value IS NULL THEN {slices} "
            f"ELSE size(filter(get(array({all_cuts}), _rank), c -> c <= _value)) END"
        ),
    )
    sizes = sliced.groupBy("_rank", "_slice").agg(F.sum("_count").alias("_size"))
    found = {(row["_rank"], row["_slice"]): row["_size"] for row in sizes.collect()}
    ahead = ", ".join(
        _sql_array(accumulate((found.get((i, s), 0) for s in range(slices)), initial=0), "bigint")
        for i in range(len(names))
    )
    ranked = sliced.selectExpr(
        "_rank",
        "_value",
        f"get(get(array({ahead}), _rank), _slice) + 1 + coalesce(sum(_count) OVER "
        "(PARTITION BY _rank, _slice ORDER BY _value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "AS _place",
    )
    result = df
    for i, name in enumerate(names):
        places = ranked.filter(F.col("_rank") == i).select("_value", F.col("_place").alias(name))
        result = result.join(places, ranks[name].cast(_RANK_TYPE).eqNullSafe(F.col("_value"))).drop("_value")
    if total:
        rows = sum(size for (i, _), size in found.items() if i == 0)
        result = result.withColumn(total, F.lit(rows).cast("bigint"))
    return result
