"""Payload and manifest contracts over JSON text, and the error classes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's allowed slugs, types, cases, stages and labels.
AGENCY_SLUGS = [
    "national-archives",
    "national-gallery-of-art",
    "library-of-congress",
    "national-park-service",
    "nasa",
    "noaa",
    "national-science-foundation",
    "national-endowment-for-the-arts",
    "national-endowment-for-the-humanities",
]
CONTENT_TYPES = ["images", "documents", "text", "mixed"]
USE_CASES = [
    "vr",
    "ai-training",
    "research",
    "education",
    "preservation",
    "accessibility",
    "public-engagement",
    "policy",
    "economic-development",
    "national-security",
    "environmental",
    "cultural",
    "historical",
    "scientific",
]
STAGES = ["ingest", "transform", "export", "full"]
CLASSIFICATIONS = ["U", "S", "TS", "SCI"]
SLUG_PATTERN = "^[a-z0-9-]+$"
SOURCE_PATTERN = "^(s3://|gs://)[a-zA-Z0-9._/-]+$"
UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
DEFAULT_STAGE = "full"
DEFAULT_CLASSIFICATION = "U"
DEFAULT_RETENTION_DAYS = 2555
MAX_RETENTION_DAYS = 36500

# The validators' messages and the hints behind a refused value.
MISSING_FIELD = "missing required field: "
NOT_TEXT = " must be a string"
INVALID = "invalid "
AGENCY_HINT = " (must be lowercase alphanumeric with hyphens)"
AGENCY_HINT_STRICT = " (must match pattern: ^[a-z0-9-]+$)"
CONTENT_TYPE_HINT = " (must be one of: images, documents, text, mixed)"
STAGE_HINT = " (must be one of: ingest, transform, export, full)"
MANIFEST_MISSING_FIELD = "manifest missing required field: "
MANIFEST_INVALID_SLUG = "invalid agency slug: "
MANIFEST_EMPTY_NAME = "name must be a non-empty string"

# Error class, status code, whether a retry makes sense.
ERROR_CLASSES = [
    ("VALIDATION_ERROR", 400, False),
    ("TRANSIENT_ERROR", 503, True),
    ("TERMINAL_ERROR", 500, False),
    ("DATA_ISOLATION_ERROR", 403, False),
    ("CHECKPOINT_ERROR", 500, True),
    ("AUTHENTICATION_ERROR", 401, False),
    ("AUTHORIZATION_ERROR", 403, False),
]
UNKNOWN_ERROR = (500, False)


@dataclass(frozen=True)
class Rule:
    """One line of a contract: a field, the rule's name and its argument."""

    field: str
    name: str
    argument: Any = None

    @property
    def label(self) -> str:
        return f"{self.field}: {self.name}"


PAYLOAD_RULES = [
    Rule("agency", "required"),
    Rule("agency", "type", "string"),
    Rule("agency", "pattern", SLUG_PATTERN),
    Rule("agency", "minLength", 3),
    Rule("agency", "maxLength", 64),
    Rule("content_type", "required"),
    Rule("content_type", "enum", CONTENT_TYPES),
    Rule("use_case", "required"),
    Rule("use_case", "enum", USE_CASES),
    Rule("stage", "enum", STAGES),
    Rule("source", "type", "string"),
    Rule("source", "pattern", SOURCE_PATTERN),
    Rule("checkpoint_id", "type", "string"),
    Rule("checkpoint_id", "pattern", UUID_PATTERN),
    Rule("metadata", "type", "object"),
]

MANIFEST_RULES = [
    Rule("slug", "required"),
    Rule("slug", "type", "string"),
    Rule("slug", "pattern", SLUG_PATTERN),
    Rule("name", "required"),
    Rule("name", "type", "string"),
    Rule("name", "minLength", 3),
    Rule("name", "maxLength", 256),
    Rule("abbreviation", "type", "string"),
    Rule("abbreviation", "minLength", 2),
    Rule("abbreviation", "maxLength", 10),
    Rule("supported_content_types", "type", "array"),
    Rule("supported_content_types", "items", CONTENT_TYPES),
    Rule("supported_content_types", "minItems", 1),
    Rule("supported_use_cases", "type", "array"),
    Rule("supported_use_cases", "items", USE_CASES),
    Rule("supported_use_cases", "minItems", 1),
    Rule("data_classification", "enum", CLASSIFICATIONS),
    Rule("retention_days", "type", "integer"),
    Rule("retention_days", "minimum", 0),
    Rule("retention_days", "maximum", MAX_RETENTION_DAYS),
    Rule("enabled", "type", "boolean"),
]

# The published contracts as JSON Schema documents.
PAYLOAD_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["agency", "content_type", "use_case"],
    "properties": {
        "agency": {"type": "string", "pattern": SLUG_PATTERN, "minLength": 3, "maxLength": 64},
        "content_type": {"type": "string", "enum": CONTENT_TYPES},
        "use_case": {"type": "string", "enum": USE_CASES},
        "stage": {"type": "string", "enum": STAGES, "default": DEFAULT_STAGE},
        "source": {"type": "string", "pattern": SOURCE_PATTERN},
        "checkpoint_id": {"type": "string", "format": "uuid"},
        "metadata": {"type": "object", "additionalProperties": True},
    },
    "additionalProperties": False,
}
MANIFEST_SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["slug", "name"],
    "properties": {
        "slug": {"type": "string", "pattern": SLUG_PATTERN},
        "name": {"type": "string", "minLength": 3, "maxLength": 256},
        "abbreviation": {"type": "string", "minLength": 2, "maxLength": 10},
        "supported_content_types": {"type": "array", "items": {"enum": CONTENT_TYPES}, "minItems": 1},
        "supported_use_cases": {"type": "array", "items": {"enum": USE_CASES}, "minItems": 1},
        "data_classification": {"type": "string", "enum": CLASSIFICATIONS, "default": DEFAULT_CLASSIFICATION},
        "retention_days": {"type": "integer", "minimum": 0, "maximum": MAX_RETENTION_DAYS, "default": DEFAULT_RETENTION_DAYS},
        "enabled": {"type": "boolean", "default": True},
    },
    "additionalProperties": False,
}

_TYPE_NAMES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
}


class Document:
    """Column expressions over a VARIANT column holding one JSON object."""

    def __init__(self, column: str = "document"):
        self.column = column

    def exists(self, field: str) -> Column:
        return F.variant_get(self.column, f"$.{field}", "variant").isNotNull()

    def is_type(self, field: str, json_type: str) -> Column:
        found = F.schema_of_variant(F.variant_get(self.column, f"$.{field}", "variant"))
        hit = F.lit(False)
        for name in _TYPE_NAMES[json_type]:
            hit = hit | F.startswith(found, F.lit(name))
        return F.coalesce(hit, F.lit(False))

    def get(self, field: str, spark_type: str) -> Column:
        return F.try_variant_get(self.column, f"$.{field}", spark_type)

    def text(self, field: str) -> Column:
        return F.when(self.is_type(field, "string"), self.get(field, "string"))


def _broken(rule: Rule, doc: Document) -> Column:
    """True where the rule applies and does not hold."""
    text, items = doc.text(rule.field), doc.get(rule.field, "array<string>")
    if rule.name == "required":
        return ~doc.exists(rule.field)
    if rule.name == "type":
        return doc.exists(rule.field) & ~doc.is_type(rule.field, rule.argument)
    if rule.name == "enum":
        return doc.exists(rule.field) & ~F.coalesce(text.isin(rule.argument), F.lit(False))
    if rule.name == "pattern":
        return ~text.rlike(rule.argument)
    if rule.name == "minLength":
        return F.length(text) < rule.argument
    if rule.name == "maxLength":
        return F.length(text) > rule.argument
    if rule.name == "items":
        allowed = F.array(*[F.lit(v) for v in rule.argument])
        return F.array_size(F.array_except(items, allowed)) > 0
    if rule.name == "minItems":
        return F.array_size(items) < rule.argument
    number = F.when(doc.is_type(rule.field, "number"), doc.get(rule.field, "double"))
    if rule.name == "minimum":
        return number < rule.argument
    if rule.name == "maximum":
        return number > rule.argument
    raise ValueError(f"unknown rule {rule.name}")


def contract_violations(rules: list[Rule], json_text: str, doc: Document) -> Column:
    """Labels of all broken rules, unknown members last, as an array."""
    labels = [F.when(_broken(rule, doc), F.lit(rule.label)) for rule in rules]
    known = F.array(*[F.lit(f) for f in dict.fromkeys(rule.field for rule in rules)])
    unknown = F.transform(
        F.array_sort(F.array_except(F.json_object_keys(json_text), known)),
        lambda name: F.concat(name, F.lit(": not allowed")),
    )
    return F.concat(F.array_compact(F.array(*labels)), F.coalesce(unknown, F.array()))


def apply_contract(df: DataFrame, rules: list[Rule], json_text: str) -> DataFrame:
    """Add ``violations`` and ``accepted``; the rows not accepted are the quarantine."""
    return (
        df.withColumn("document", F.try_parse_json(json_text))
        .withColumn(
            "violations",
            F.when(F.col("document").isNull(), F.array(F.lit("not valid JSON"))).otherwise(
                contract_violations(rules, json_text, Document())
            ),
        )
        .withColumn("accepted", F.array_size("violations") == 0)
    )


def _payload_checks(doc: Document, strict: bool) -> list[tuple[Column, Column]]:
    """Conditions with their messages, in reporting order."""
    domains = {
        "agency": (AGENCY_SLUGS, AGENCY_HINT_STRICT if strict else AGENCY_HINT),
        "content_type": (CONTENT_TYPES, CONTENT_TYPE_HINT),
        "use_case": (USE_CASES, ""),
    }
    checks = [(~doc.exists(field), F.lit(MISSING_FIELD + field)) for field in domains]
    if not strict:
        domains["stage"] = (STAGES, STAGE_HINT)
    for field, (allowed, hint) in domains.items():
        value = doc.text(field)
        checks.append((doc.exists(field) & value.isNull(), F.lit(field + NOT_TEXT)))
        refused = F.concat(F.lit(f"{INVALID}{field}: "), value, F.lit(hint))
        checks.append((~value.isin(allowed), refused))
    return checks


def first_payload_error() -> Column:
    """The first error of the payload in ``document``; NULL when it is valid."""
    return F.coalesce(
        *[F.when(broken, message) for broken, message in _payload_checks(Document(), strict=False)]
    )


def all_payload_errors() -> Column:
    """All errors of the payload in ``document``; the stage is not looked at."""
    checks = _payload_checks(Document(), strict=True)
    return F.array_compact(F.array(*[F.when(broken, message) for broken, message in checks]))


def first_manifest_error() -> Column:
    """The first error of the manifest in ``document``; NULL when it is valid."""
    doc = Document()
    slug, name = doc.text("slug"), doc.text("name")
    return F.coalesce(
        *[F.when(~doc.exists(f), F.lit(MANIFEST_MISSING_FIELD + f)) for f in ("slug", "name")],
        F.when(slug.isNull(), F.lit("slug" + NOT_TEXT)),
        F.when(~slug.isin(AGENCY_SLUGS), F.concat(F.lit(MANIFEST_INVALID_SLUG), slug)),
        F.when(F.coalesce(name, F.lit("")) == "", F.lit(MANIFEST_EMPTY_NAME)),
    )


def classify_errors(df: DataFrame, error_class: str) -> DataFrame:
    """Add status code and retry flag; unknown classes get the general ones."""
    rows = ", ".join(f"('{name}', {status}, {retry})" for name, status, retry in ERROR_CLASSES)
    classes = df.sparkSession.sql(
        f"SELECT * FROM VALUES {rows} AS classes({error_class}, _status, _retry)"
    )
    return (
        df.join(classes, error_class, "left")
        .withColumn("http_status", F.coalesce("_status", F.lit(UNKNOWN_ERROR[0])))
        .withColumn("retryable", F.coalesce("_retry", F.lit(UNKNOWN_ERROR[1])))
        .drop("_status", "_retry")
    )
