"""Several tables published as one: all of them change for readers, or none.

A version's tables are written beside the published ones and counted and
digested while they are written.  A commit reads every table back, compares
counts and digests, and then writes one manifest; readers take what the newest
manifest names.  Whatever fails before that leaves them on the version before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexgauge.session import materialize

_STAGED = "table_name string, path string, rows bigint, digest string, columns string"
_MANIFEST = f"sequence bigint, version string, published_at timestamp_ntz, {_STAGED}"


class PublicationError(ValueError):
    """What was written is not what was meant to be published."""


def _measures(columns: list[str]) -> list[Column]:
    """Row count and sums over a hash of all columns; they do not depend on the rows' order."""
    mark = F.xxhash64(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(0)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.shiftrightunsigned(mark, 32)), F.lit(0)).alias("high"),
    ]


def _digest(measured: dict) -> str:
    return f"{measured['low']:x}:{measured['high']:x}"


def _rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Publication:
    """Published tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def manifests(self) -> DataFrame:
        """All manifests: a row for each table of each published version."""
        return _rows_of(self.spark, f"{self.root}/manifests", _MANIFEST)

    def manifest(self) -> list:
        """The newest manifest's rows, one per table."""
        rows = self.manifests()
        newest = rows.agg(F.max("sequence")).first()[0]
        return [] if newest is None else rows.where(F.col("sequence") == newest).collect()

    def read(self, table: str) -> DataFrame:
        """A table of the newest version."""
        for row in self.manifest():
            if row["table_name"] == table:
                return self.spark.read.parquet(f"{self.root}/{row['path']}")
        raise PublicationError(f"no table {table} is published")

    def stage(self, version: str) -> Staging:
        """A new version, or one that an earlier attempt has begun."""
        return Staging(self, version)

    def publish(self, version: str, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> dict[str, int]:
        """Write all tables as one version and commit it; returns the rows of each."""
        staging = self.stage(version)
        moved = {name: staging.add(name, df() if callable(df) else df) for name, df in tables.items()}
        staging.commit()
        return moved


class Staging:
    """The tables of a version that is not published yet."""

    def __init__(self, publication: Publication, version: str) -> None:
        self.publication, self.version = publication, version
        self.spark = publication.spark
        self.path = f"versions/{version}"

    def staged(self) -> list:
        """What has been written so far; of a table that was written again, the last."""
        rows = _rows_of(self.spark, f"{self.publication.root}/{self.path}/_staged/*", _STAGED)
        return rows.collect()

    def clear(self) -> int:
        """Begin anew: no table is staged, and readers still have the version before."""
        gone = len(self.staged())
        empty = self.spark.createDataFrame([], _STAGED)
        for row in self.staged():
            empty.write.mode("overwrite").parquet(f"{self.publication.root}/{self.path}/_staged/{row['table_name']}")
        return gone

    def add(self, name: str, df: DataFrame) -> int:
        """Write one table and return its rows."""
        seen = Observation(name)
        path = f"{self.path}/{name}"
        df.observe(seen, *_measures(df.columns)).write.mode("overwrite").parquet(f"{self.publication.root}/{path}")
        measured = seen.get
        row = (name, path, measured["rows"], _digest(measured), ",".join(df.columns))
        note = self.spark.createDataFrame([row], _STAGED).coalesce(1)
        note.write.mode("overwrite").parquet(f"{self.publication.root}/{self.path}/_staged/{name}")
        return measured["rows"]

    def verify(self) -> DataFrame:
        """Per staged table the rows and digest as written and as read back, and whether they match."""
        result = None
        for row in self.staged():
            read = self.spark.read.parquet(f"{self.publication.root}/{row['path']}")
            back = read.agg(*_measures(row["columns"].split(",") if row["columns"] else [])).select(
                F.lit(row["table_name"]).alias("table_name"),
                F.lit(row["rows"]).cast("bigint").alias("rows_written"),
                F.col("rows").alias("rows_read"),
                F.lit(row["digest"]).alias("digest_written"),
                F.concat(F.lower(F.hex("low")), F.lit(":"), F.lower(F.hex("high"))).alias("digest_read"),
            )
            result = back if result is None else result.unionByName(back)
        if result is None:
            raise PublicationError(f"version {self.version} has no tables")
        same = (F.col("rows_written") == F.col("rows_read")) & (F.col("digest_written") == F.col("digest_read"))
        return result.withColumn("matches", same)

    def commit(self) -> int:
        """Check all staged tables and make them the published ones; returns how many there are.

        A version that is published already stays as it is.
        """
        manifests = self.publication.manifests()
        done = manifests.where(F.col("version") == self.version).count()
        if done:
            return done
        checked = materialize(self.verify())
        # One row per table.
        wrong = sorted(r["table_name"] for r in checked.where("NOT matches").collect())
        if wrong:
            raise PublicationError("tables that differ from what was written: " + ", ".join(wrong))
        sequence = (manifests.agg(F.max("sequence")).first()[0] or 0) + 1
        rows = [(sequence, self.version, datetime.now(), *row) for row in self.staged()]
        # One file in a folder that must be new: of two commits at once, one fails.
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).drop("sequence")
        manifest.write.mode("errorifexists").parquet(f"{self.publication.root}/manifests/sequence={sequence}")
        return len(rows)
