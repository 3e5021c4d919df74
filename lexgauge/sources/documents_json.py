"""JSON payloads and manifests derived from the tables, some of them broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.operators.contracts import AGENCY_SLUGS, CLASSIFICATIONS, USE_CASES
from lexgauge.sources.tables import read_table

SLUG_CHOICES = [*AGENCY_SLUGS, "other-archive", "Bad Agency!"]


def _quoted(value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit('"'), value, F.lit('"'))


def _choice(values: list[str | None], index: Column) -> Column:
    """One of the JSON texts by row; None leaves the member out."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _object(members: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in members.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _texts(values: list[str]) -> list[str]:
    return [f'"{v}"' for v in values]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run payload per document."""
    k = F.col("doc_id")
    digest = F.md5(k.cast("string"))
    uuid = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    folder = F.concat("source", F.lit("/batch-"), k)
    members = {
        "agency": F.when(k % 13 == 0, None)
        .when(k % 17 == 1, F.lit("5"))
        .when(k % 19 == 2, F.lit("null"))
        .otherwise(_choice(_texts(SLUG_CHOICES), k)),
        "content_type": _choice(
            ['"images"', '"documents"', '"text"', '"mixed"', '"video"', None, "true"], k
        ),
        "use_case": _choice([*_texts(USE_CASES), '"general"', None, "7"], k),
        "stage": F.when(k % 29 == 3, F.lit("1")).otherwise(
            _choice(['"ingest"', '"transform"', '"export"', '"full"', None, '"archive"'], k)
        ),
        "source": F.when(k % 5 == 1, _quoted(F.concat(F.lit("s3://lake/"), folder)))
        .when(k % 5 == 2, _quoted(F.concat(F.lit("gs://lake/"), folder)))
        .when(k % 5 == 3, _quoted(F.concat(F.lit("ftp://lake/"), folder))),
        "checkpoint_id": F.when(k % 4 == 1, _quoted(uuid)).when(k % 4 == 2, _quoted("not-a-uuid")),
        "metadata": F.when(k % 8 == 0, F.concat(F.lit('{"lang":"'), "lang", F.lit('"}'))).when(
            k % 8 == 1, _quoted("text")
        ),
        "dry_run": F.when(k % 31 == 4, F.lit("true")),
    }
    return read_table(spark, sf_dir, "documents").select("doc_id", _object(members).alias("payload"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per customer."""
    k = F.col("c_custkey")
    members = {
        "slug": F.when(k % 7 == 0, None)
        .when(k % 7 == 1, F.lit("12"))
        .otherwise(_choice(_texts(SLUG_CHOICES), k)),
        "name": F.when(k % 10 == 2, _quoted(""))
        .when(k % 10 == 3, None)
        .when(k % 10 == 4, _quoted("ab"))
        .otherwise(_quoted(F.col("c_name"))),
        "abbreviation": _choice([None, '"A"', '"ABC"', '"ABCDEFGHIJKL"'], k),
        "supported_content_types": _choice(['["text"]', "[]", '["text","video"]', '"text"', None], k),
        "supported_use_cases": _choice(['["research"]', '["general"]', None], k),
        "data_classification": _choice([*_texts(CLASSIFICATIONS), '"X"', None], k),
        "retention_days": _choice(["0", "2555", "36500", "36501", "-1", "30.5", None, '"30"'], k),
        "enabled": _choice(["true", "false", '"yes"', None], k),
        "owner": F.when(k % 23 == 5, F.lit('"someone"')),
    }
    return read_table(spark, sf_dir, "customer").select("c_custkey", _object(members).alias("manifest"))
