"""Snapshots with a hash tree, so that two of them are compared by what differs.

A snapshot's rows lie in leaves by the hash of their key, a folder for each; a
branch is a run of neighbouring leaves.  Leaves and branches carry sums over the
row checksums, which do not depend on the rows' order.  A comparison descends
from the root to the branches and leaves whose sums differ, and only their files
are opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexgauge.operators.snapshots import snapshot_diff

#: Leaves of a snapshot and leaves of a branch; both snapshots of a comparison need the same.
LEAVES = 1024
FANOUT = 32
_LANES = 4
_DIGESTS = "level string, node int, rows bigint, digest string"


#: The leaf of rows without a key, which never match and are always compared.
KEYLESS = -1


def leaf_of(key: str, leaves: int) -> Column:
    return F.when(F.col(key).isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64(F.col(key)), F.lit(leaves))).cast("int")


def _sums(rows: DataFrame, checksum: str) -> DataFrame:
    """Rows of each leaf and sums over pieces of a hash of key and checksum, which add up over leaves."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("_key", checksum)]
    mixed = F.sha2(F.concat_ws("|", *parts, F.col("_key").isNull(), F.col(checksum).isNull()), 256)
    pieces = [F.conv(F.substring("_mixed", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(_LANES)]
    return rows.withColumn("_mixed", mixed).groupBy("leaf").agg(
        F.count("*").alias("rows"), *[F.sum(p).alias(f"lane{i}") for i, p in enumerate(pieces)]
    )


def _node(rows: DataFrame, level: str, node: Column) -> DataFrame:
    """Digests of one level; ``rows`` holds a row for each leaf."""
    lanes = [f"lane{i}" for i in range(_LANES)]
    summed = rows.groupBy(node.cast("int").alias("node")).agg(F.sum("rows").alias("rows"), *[F.sum(x).alias(x) for x in lanes])
    return summed.select(F.lit(level).alias("level"), "node", "rows", F.md5(F.concat_ws(":", "rows", *lanes)).alias("digest"))


@dataclass(frozen=True)
class Snapshot:
    """A written snapshot: its folder, key and shape."""

    spark: SparkSession
    path: str
    key: str
    leaves: int = LEAVES
    fanout: int = FANOUT

    def placed_rows(self) -> DataFrame:
        """The rows with their leaf."""
        columns = self.spark.read.parquet(f"{self.path}/schema").schema
        schema = StructType([*columns.fields, StructField("leaf", IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def rows(self, leaves: list[int] | None = None) -> DataFrame:
        """The rows, of some leaves only; files of the others are not opened."""
        read = self.placed_rows()
        return (read if leaves is None else read.where(F.col("leaf").isin(leaves))).drop("leaf")

    def digests(self, level: str, parents: list[int] | None = None) -> DataFrame:
        """Digests of one level, under some nodes of the level above."""
        read = self.spark.read.schema(_DIGESTS).parquet(f"{self.path}/digests").where(F.col("level") == level)
        return read if parents is None else read.where(F.floor(F.col("node") / self.fanout).cast("int").isin(parents))


def write_snapshot(
    df: DataFrame, path: str, key: str, checksum: str = "checksum", leaves: int = LEAVES, fanout: int = FANOUT
) -> Snapshot:
    """Write ``df`` with its tree; ``checksum`` tells a row's content.

    Leaves are dealt by the hash of the key; a leaf that is far larger than
    others, as one key's many rows make it, is split over several files.
    """
    placed = df.withColumn("leaf", leaf_of(key, leaves)).hint("rebalance", "leaf")
    placed.write.partitionBy("leaf").parquet(f"{path}/rows")
    df.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    snapshot = Snapshot(df.sparkSession, path, key, leaves, fanout)
    sums = _sums(snapshot.placed_rows().withColumn("_key", F.col(key)), checksum)
    # At most one row per leaf from here on.
    levels = [
        _node(sums, "leaf", F.col("leaf")),
        _node(sums, "branch", F.floor(F.col("leaf") / fanout)),
        _node(sums, "root", F.lit(0)),
    ]
    tree = levels[0].unionByName(levels[1]).unionByName(levels[2])
    tree.coalesce(1).write.partitionBy("level").parquet(f"{path}/digests")
    return snapshot


def _differing(old: Snapshot, new: Snapshot, level: str, parents: list[int] | None) -> list[int]:
    """Nodes of a level whose digests differ; at most as many as the tree has."""
    then = old.digests(level, parents).select("node", F.col("digest").alias("_then"))
    now = new.digests(level, parents).select("node", F.col("digest").alias("_now"))
    both = then.join(now, "node", "full_outer").where(~F.col("_then").eqNullSafe(F.col("_now")))
    return sorted(r["node"] for r in both.select("node").collect())


def changed_leaves(old: Snapshot, new: Snapshot) -> list[int]:
    """Leaves that hold a difference, found from the root down."""
    if (old.leaves, old.fanout, old.key) != (new.leaves, new.fanout, new.key):
        raise ValueError("the snapshots have different trees")
    if not _differing(old, new, "root", None):
        return []
    branches = _differing(old, new, "branch", None)
    return _differing(old, new, "leaf", branches)


def tree_diff(old: Snapshot, new: Snapshot, checksum: str = "checksum") -> DataFrame:
    """Which keys were added, removed or changed: the rows of ``snapshot_diff``, reading differing leaves only.

    Equal keys with equal checksums may be repeated; a key counts as changed if
    any of its copies differ.  Rows without a key never match, as in a join.
    """
    leaves = [*changed_leaves(old, new), KEYLESS]
    return snapshot_diff(old.rows(leaves), new.rows(leaves), old.key, checksum)


def write_changes(old: Snapshot, new: Snapshot, path: str, checksum: str = "checksum") -> DataFrame:
    """What a copy of the old snapshot needs to become the new one, written by leaf: key, change and the new row's columns."""
    leaves = changed_leaves(old, new)
    changes = snapshot_diff(old.rows(leaves), new.rows(leaves), old.key, checksum).select(old.key, "change")
    rows = changes.where("change <> 'removed'").join(new.rows(leaves), old.key, "left")
    gone = changes.where("change = 'removed'")
    rows.unionByName(gone, allowMissingColumns=True).write.parquet(path)
    return old.spark.read.parquet(path)
