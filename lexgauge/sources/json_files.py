"""Agency and correction JSON files.

Records stay VARIANT until they are parsed, so their checksums cover exactly
the members the file holds.  Two layouts are read: ``document``, one object
with an array under a root key (one task per file), and ``lines``, one record
per line, which splits and is the layout for large inputs.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.functions.checksums import with_json_checksum
from lexgauge.sources.file_digests import LEAST_BYTES, line_digests
from lexgauge.sources.parsing import length_or_zero, parse_corrections

AGENCIES_ROOT = "agencies"
CORRECTIONS_ROOT = "ecfr_corrections"
#: Files up to this size are hashed as one value.
WHOLE_BYTES = 16 << 20

_REFERENCE = "struct<title:int,chapter:string,subtitle:string,part:string>"
_CHILD = f"struct<name:string,short_name:string,slug:string,cfr_references:array<{_REFERENCE}>>"
AGENCY_TYPE = (
    f"struct<name:string,short_name:string,slug:string,cfr_references:array<{_REFERENCE}>,"
    f"children:array<{_CHILD}>>"
)
CORRECTION_TYPE = (
    "struct<id:bigint,title:int,year:int,cfr_references:array<struct<cfr_reference:string,"
    "hierarchy:struct<chapter:string,part:string,section:string>>>,corrective_action:string,"
    "error_occurred:string,error_corrected:string,fr_citation:string>"
)


def read_records(spark: SparkSession, path: str, root: str, layout: str = "document") -> DataFrame:
    """One VARIANT column ``record`` per agency or correction."""
    if layout == "lines":
        return spark.read.option("singleVariantColumn", "record").json(path)
    if layout != "document":
        raise ValueError("layout must be document or lines")
    documents = spark.read.schema(f"{root} array<variant>").option("multiLine", True).json(path)
    return documents.select(F.explode(root).alias("record"))


def _member(record: Column, name: str) -> Column:
    """A member's JSON text; NULL where the record lacks it."""
    return F.to_json(F.variant_get(record, f"$.{name}", "variant"))


def _without_checksum(record: Column) -> Column:
    members = F.map_filter(record.cast("map<string,variant>"), lambda name, _: name != "checksum")
    return F.to_json(members)


def _object(parts: dict[str, Column]) -> Column:
    pieces: list[Column] = []
    for i, name in enumerate(sorted(parts)):
        pieces += [F.lit(("," if i else "{") + f'"{name}":'), parts[name]]
    return F.concat(*pieces, F.lit("}"))


def _members(record: Column, names: list[str]) -> dict[str, Column]:
    parts = {n: F.coalesce(_member(record, n), F.lit("null")) for n in names}
    parts["cfr_references"] = F.coalesce(_member(record, "cfr_references"), F.lit("[]"))
    return parts


def with_agency_checksum(rows: DataFrame, record: str = "record") -> DataFrame:
    """SHA-256 over name, short name, slug, references and children.

    A variant keeps object keys sorted, so its JSON text is canonical.
    """
    parts = _members(F.col(record), ["name", "short_name", "slug"])
    listed = F.variant_get(record, "$.children", "array<variant>")
    parts["children"] = F.concat(
        F.lit("["),
        F.coalesce(F.array_join(F.transform(listed, _without_checksum), ","), F.lit("")),
        F.lit("]"),
    )
    return with_json_checksum(rows, _object(parts))


def with_correction_checksum(rows: DataFrame, record: str = "record") -> DataFrame:
    """SHA-256 over the eight published fields."""
    names = [
        "id",
        "corrective_action",
        "error_corrected",
        "error_occurred",
        "fr_citation",
        "title",
        "year",
    ]
    return with_json_checksum(rows, _object(_members(F.col(record), names)))


def load_agencies(
    spark: SparkSession, path: str, layout: str = "document"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw landing rows, parsed agencies and references of one file or folder."""
    records = read_records(spark, path, AGENCIES_ROOT, layout)
    everyone = records.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.col("record"), F.lit(None).cast("string").alias("parent_slug"))),
                F.coalesce(
                    F.transform(
                        F.variant_get("record", "$.children", "array<variant>"),
                        lambda c: F.struct(
                            c.alias("record"),
                            F.variant_get(F.col("record"), "$.slug", "string").alias("parent_slug"),
                        ),
                    ),
                    F.array(),
                ),
            )
        ).alias("entry")
    ).select("entry.record", "entry.parent_slug")
    parsed_record = F.from_json(F.to_json("record"), AGENCY_TYPE)
    rows = with_agency_checksum(everyone).select(
        parsed_record.alias("agency"), "parent_slug", F.to_json("record").alias("data"), "checksum"
    )
    identity = ["agency.slug", "agency.name", "agency.short_name", "parent_slug"]
    raw = rows.select(*identity, "data", "checksum")
    parsed = rows.select(
        *identity,
        length_or_zero(F.col("agency.cfr_references")).alias("cfr_reference_count"),
        # Only one level is kept: a child counts no children of its own.
        F.when(F.col("parent_slug").isNull(), length_or_zero(F.col("agency.children")))
        .otherwise(0)
        .alias("child_count"),
        "checksum",
    )
    refs = rows.select("agency.slug", F.explode("agency.cfr_references").alias("ref")).select(
        F.col("slug").alias("agency_slug"), "ref.title", "ref.chapter", "ref.subtitle", "ref.part"
    )
    return raw, parsed, refs


def load_corrections(
    spark: SparkSession, path: str, layout: str = "document"
) -> tuple[DataFrame, DataFrame]:
    """Raw landing rows and parsed corrections of one file or folder."""
    records = read_records(spark, path, CORRECTIONS_ROOT, layout)
    rows = with_correction_checksum(records)
    raw = rows.select(
        F.variant_get("record", "$.id", "bigint").alias("ecfr_id"),
        F.to_json("record").alias("data"),
        "checksum",
    )
    documents = rows.select(
        F.from_json(F.to_json("record"), CORRECTION_TYPE).alias("correction"), "checksum"
    )
    return raw, parse_corrections(documents, keep=["checksum"])


def file_checksums(
    spark: SparkSession,
    paths: str | list[str],
    glob: str | None = None,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """Name, size and SHA-256 of whole files.

    The hash runs through a file from front to back, so one file is one task's
    work.  Files over ``whole_bytes`` are hashed line by line.  Those without a
    plain extension, or that overlapping paths list twice, are held whole like
    small ones, and the reader refuses them over 2 GB.
    """

    def files(kind: str, chosen: Column, **options: str) -> DataFrame:
        if glob:
            options["pathGlobFilter"] = glob
        return spark.read.format(kind).options(**options).load(paths).filter(chosen)

    # Conditions on the listing alone, so that files left out are not opened.
    extension = F.regexp_extract("_metadata.file_name", r"\.[A-Za-z0-9_-]+$", 0)
    large = (F.col("_metadata.file_size") > max(whole_bytes, LEAST_BYTES)) & (extension != "")
    listed = files("binaryFile", large).groupBy(extension.alias("extension"))
    kinds = listed.agg(F.count("*").alias("files"), F.count_distinct("_metadata.file_path").alias("paths"))
    by_line = sorted(r.extension for r in kinds.collect() if r.files == r.paths)
    rest = ~(large & extension.isin(by_line)) if by_line else F.lit(True)
    found = files("binaryFile", rest).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("length").alias("file_bytes"),
        F.sha2("content", 256).alias("file_checksum"),
    )
    for kind in by_line:
        digests = line_digests(kind, partial(files, "text", large & (extension == kind)))
        found = found.union(
            digests.select(
                "file_path",
                F.substring_index("file_path", "/", -1).alias("source_file"),
                "file_bytes",
                "file_checksum",
            )
        )
    return found


def ingestion_log(counts: DataFrame, files: DataFrame, status: str = "success") -> DataFrame:
    """Log rows: file, record count, file checksum and status."""
    return counts.join(files, "file_path").select(
        "source_file", "record_count", "file_checksum", F.lit(status).alias("status")
    )
