"""Record checksums over canonical JSON, and table digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKSUM_PATTERN = "^[a-f0-9]{64}$"

_LANES = 8
_LANE_DIGITS = 7  # 28 bits

# JSON text in ASCII: a character outside it can only stand inside a string
# and becomes a lower-case escape, two of them beyond the basic plane.  Escapes
# the JSON writer made itself (control characters) are put in lower case.
_ESCAPE = r"concat(r'\u', lower(lpad(hex({code}), 4, '0')))"
_ASCII_JSON = (
    r"CASE WHEN {text} RLIKE r'^[ -~]*$' AND NOT {text} RLIKE r'\\u00[01][A-F]' THEN {text} ELSE "
    r"array_join(transform(split({lowered}, ''), c -> CASE "
    r"WHEN ascii(c) BETWEEN 32 AND 126 THEN c "
    r"WHEN ascii(c) > 65535 THEN concat({high}, {low}) "
    r"ELSE {single} END), '') END"
)


def _ascii_json(text: str) -> str:
    lowered = text
    for digit in "ABCDEF":
        pattern = rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}"
        lowered = f"regexp_replace({lowered}, r'{pattern}', '$1{digit.lower()}')"
    return _ASCII_JSON.format(
        text=text,
        lowered=lowered,
        single=_ESCAPE.format(code="ascii(c)"),
        high=_ESCAPE.format(code="55296 + shiftright(ascii(c) - 65536, 10)"),
        low=_ESCAPE.format(code="56320 + ((ascii(c) - 65536) & 1023)"),
    )


def canonical_json(members: dict[str, Column | str]) -> Column:
    """Members as JSON under sorted keys; nulls are kept.

    Nested structs must name their own members in sorted order.
    """
    fields = [
        (F.col(value) if isinstance(value, str) else value).alias(name)
        for name, value in sorted(members.items())
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def with_json_checksum(df: DataFrame, text: Column, out: str = "checksum") -> DataFrame:
    """Add the SHA-256 of canonical JSON text, brought to ASCII first."""
    return df.withColumn(out, text).withColumn(out, F.expr(f"sha2({_ascii_json(out)}, 256)"))


def with_record_checksum(
    df: DataFrame, members: dict[str, Column | str], out: str = "checksum"
) -> DataFrame:
    """Add the SHA-256 of one record's canonical JSON."""
    return with_json_checksum(df, canonical_json(members), out)


def bucket_digests(df: DataFrame, checksum: str = "checksum") -> DataFrame:
    """Order-free digests of the row checksums in 256 buckets.

    Each checksum is cut into numbers that are summed, so partial sums combine
    before the shuffle and equal rows cost nothing extra, however many there
    are.  Two tables differ exactly in the buckets whose digests differ.
    """
    lanes = [
        F.sum(
            F.conv(F.substring(checksum, i * _LANE_DIGITS + 1, _LANE_DIGITS), 16, 10).cast("decimal(10,0)")
        ).alias(f"_lane{i}")
        for i in range(_LANES)
    ]
    sums = df.groupBy(F.substring(checksum, 63, 2).alias("bucket")).agg(
        F.count("*").alias("record_count"), *lanes
    )
    return sums.select(
        "bucket",
        "record_count",
        F.md5(
            F.concat_ws(":", "record_count", *[F.col(f"_lane{i}") for i in range(_LANES)])
        ).alias("digest"),
    )


def table_digest(df: DataFrame, table_name: str, checksum: str = "checksum") -> DataFrame:
    """One row: table name, record count and the digest of the bucket digests."""
    buckets = bucket_digests(df, checksum)
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "digest")))  # at most 257 rows
    return buckets.agg(
        F.lit(table_name).alias("table_name"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("bigint").alias("record_count"),
        F.md5(F.array_join(F.transform(ordered, lambda b: b["digest"]), "")).alias("aggregate_checksum"),
    )
