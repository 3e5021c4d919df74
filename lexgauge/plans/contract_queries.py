"""Registered queries: payload and manifest contracts, steps, error classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgauge.operators import contracts as c
from lexgauge.operators import json_schema
from lexgauge.operators import steps as st
from lexgauge.plans.registry import query
from lexgauge.plans.sql import with_
from lexgauge.sources.documents_json import SLUG_CHOICES, manifests, payloads
from lexgauge.sources.tables import read_table


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


def _pick(values, key: str) -> str:
    return f"{_list(values)}[{key} % {len(values)} + 1]"


def _texts(values) -> list[str]:
    return [f'"{v}"' for v in values]


def _member(name: str, value: str) -> str:
    return f"""concat('"{name}":', 1) IS NULL""" if value is None else f"""'"{name}":' || ({value})"""


def _object(members: dict[str, str]) -> str:
    parts = ", ".join(_member(n, v) for n, v in members.items())
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


_DIGEST = "md5(CAST(doc_id AS VARCHAR))"
_UUID = " || '-' || ".join(
    f"substr({_DIGEST}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
)
_PAYLOADS = "payloads AS (SELECT doc_id, " + _object(
    {
        "agency": "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 1 THEN '5' "
        f"WHEN doc_id % 19 = 2 THEN 'null' ELSE {_pick(_texts(SLUG_CHOICES), 'doc_id')} END",
        "content_type": _pick(
            ['"images"', '"documents"', '"text"', '"mixed"', '"video"', None, "true"], "doc_id"
        ),
        "use_case": _pick([*_texts(c.USE_CASES), '"general"', None, "7"], "doc_id"),
        "stage": "CASE WHEN doc_id % 29 = 3 THEN '1' ELSE "
        + _pick(['"ingest"', '"transform"', '"export"', '"full"', None, '"archive"'], "doc_id")
        + " END",
        "source": "CASE doc_id % 5 WHEN 1 THEN '\"s3://lake/' WHEN 2 THEN '\"gs://lake/' "
        "WHEN 3 THEN '\"ftp://lake/' END || source || '/batch-' || doc_id || '\"'",
        "checkpoint_id": f"CASE doc_id % 4 WHEN 1 THEN '\"' || {_UUID} || '\"' "
        "WHEN 2 THEN '\"not-a-uuid\"' END",
        "metadata": "CASE doc_id % 8 WHEN 0 THEN '{\"lang\":\"' || lang || '\"}' WHEN 1 THEN '\"text\"' END",
        "dry_run": "CASE WHEN doc_id % 31 = 4 THEN 'true' END",
    }
) + " AS payload FROM documents)"

_MANIFESTS = "manifests AS (SELECT c_custkey, " + _object(
    {
        "slug": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '12' "
        f"ELSE {_pick(_texts(SLUG_CHOICES), 'c_custkey')} END",
        "name": "CASE c_custkey % 10 WHEN 2 THEN '\"\"' WHEN 3 THEN NULL WHEN 4 THEN '\"ab\"' "
        "ELSE '\"' || c_name || '\"' END",
        "abbreviation": _pick([None, '"A"', '"ABC"', '"ABCDEFGHIJKL"'], "c_custkey"),
        "supported_content_types": _pick(
            ['["text"]', "[]", '["text","video"]', '"text"', None], "c_custkey"
        ),
        "supported_use_cases": _pick(['["research"]', '["general"]', None], "c_custkey"),
        "data_classification": _pick([*_texts(c.CLASSIFICATIONS), '"X"', None], "c_custkey"),
        "retention_days": _pick(
            ["0", "2555", "36500", "36501", "-1", "30.5", None, '"30"'], "c_custkey"
        ),
        "enabled": _pick(["true", "false", '"yes"', None], "c_custkey"),
        "owner": "CASE WHEN c_custkey % 23 = 5 THEN '\"someone\"' END",
    }
) + " AS manifest FROM customer)"


def _exists(doc: str, field: str) -> str:
    return f"json_type({doc}, '$.{field}') IS NOT NULL"


def _is_text(doc: str, field: str) -> str:
    return f"coalesce(json_type({doc}, '$.{field}') = 'VARCHAR', false)"


def _text(doc: str, field: str) -> str:
    return f"CASE WHEN {_is_text(doc, field)} THEN json_extract_string({doc}, '$.{field}') END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _payload_errors(strict: bool) -> list[str]:
    cases = [
        f"CASE WHEN NOT ({_exists('payload', f)}) THEN 'missing required field: {f}' END"
        for f in ("agency", "content_type", "use_case")
    ]
    hint = "must match pattern: ^[a-z0-9-]+$" if strict else "must be lowercase alphanumeric with hyphens"
    fields = [
        ("agency", c.AGENCY_SLUGS, f" ({hint})"),
        ("content_type", c.CONTENT_TYPES, " (must be one of: images, documents, text, mixed)"),
        ("use_case", c.USE_CASES, ""),
    ]
    if not strict:
        fields.append(("stage", c.STAGES, " (must be one of: ingest, transform, export, full)"))
    for field, allowed, note in fields:
        value = _text("payload", field)
        cases.append(
            f"CASE WHEN {_exists('payload', field)} AND NOT {_is_text('payload', field)} "
            f"THEN '{field} must be a string' END"
        )
        cases.append(
            f"CASE WHEN ({value}) NOT IN {_in(allowed)} THEN concat('invalid {field}: ', {value}, '{note}') END"
        )
    return cases


@query(
    "payload_validate",
    with_(_PAYLOADS)
    + f"SELECT doc_id, payload, coalesce({', '.join(_payload_errors(False))}) AS error FROM payloads",
)
def _(spark, sf_dir):
    return (
        payloads(spark, sf_dir)
        .withColumn("document", F.try_parse_json("payload"))
        .select("doc_id", "payload", c.first_payload_error().alias("error"))
    )


@query(
    "payload_validate_strict",
    with_(_PAYLOADS)
    + f"""
    SELECT doc_id, errors = '' AS valid, errors
    FROM (SELECT doc_id, concat_ws('; ', {', '.join(_payload_errors(True))}) AS errors FROM payloads)""",
)
def _(spark, sf_dir):
    return (
        payloads(spark, sf_dir)
        .withColumn("document", F.try_parse_json("payload"))
        .withColumn("found", c.all_payload_errors())
        .select(
            "doc_id",
            (F.array_size("found") == 0).alias("valid"),
            F.array_join("found", "; ").alias("errors"),
        )
    )


_JSON_TYPES = {
    "string": ["VARCHAR"],
    "integer": ["BIGINT", "UBIGINT"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
}


def _rule_sql(rule: c.Rule, doc: str) -> str:
    field, value = rule.field, _text(doc, rule.field)
    kind = f"json_type({doc}, '$.{field}')"
    number = f"CASE WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({doc}->>'$.{field}' AS DOUBLE) END"
    items = f"CASE WHEN {kind} = 'ARRAY' THEN CAST(json_extract({doc}, '$.{field}') AS VARCHAR[]) END"
    broken = {
        "required": lambda: f"{kind} IS NULL",
        "type": lambda: f"{kind} NOT IN {_in(_JSON_TYPES[rule.argument])}",
        "enum": lambda: f"{kind} IS NOT NULL AND coalesce(({value}) NOT IN {_in(rule.argument)}, true)",
        "pattern": lambda: f"NOT regexp_matches({value}, '{rule.argument}')",
        "minLength": lambda: f"length({value}) < {rule.argument}",
        "maxLength": lambda: f"length({value}) > {rule.argument}",
        "items": lambda: f"len(list_filter({items}, lambda x: x NOT IN {_in(rule.argument)})) > 0",
        "minItems": lambda: f"len({items}) < {rule.argument}",
        "minimum": lambda: f"({number}) < {rule.argument}",
        "maximum": lambda: f"({number}) > {rule.argument}",
    }[rule.name]()
    return f"CASE WHEN {broken} THEN '{rule.label}' END"


def _violations_sql(rules: list[c.Rule], doc: str, unknown: str) -> str:
    cases = ", ".join(_rule_sql(rule, doc) for rule in rules)
    extra = f"CASE WHEN {_exists(doc, unknown)} THEN '{unknown}: not allowed' END"
    return f"concat_ws('; ', {cases}, {extra})"


@query(
    "contract_apply",
    with_(_PAYLOADS)
    + f"""
    SELECT doc_id, violations = '' AS accepted, violations,
           CASE WHEN violations = '' THEN coalesce(json_extract_string(payload, '$.stage'), 'full') END AS stage
    FROM (SELECT *, {_violations_sql(c.PAYLOAD_RULES, 'payload', 'dry_run')} AS violations FROM payloads)""",
)
def _(spark, sf_dir):
    doc = c.Document()
    return c.apply_contract(payloads(spark, sf_dir), c.PAYLOAD_RULES, "payload").select(
        "doc_id",
        "accepted",
        F.array_join("violations", "; ").alias("violations"),
        F.when(F.col("accepted"), F.coalesce(doc.text("stage"), F.lit(c.DEFAULT_STAGE))).alias("stage"),
    )


@query(
    "manifest_validate",
    with_(_MANIFESTS)
    + f"""
    SELECT c_custkey, coalesce(
               CASE WHEN NOT ({_exists('manifest', 'slug')}) THEN 'manifest missing required field: slug' END,
               CASE WHEN NOT ({_exists('manifest', 'name')}) THEN 'manifest missing required field: name' END,
               CASE WHEN NOT {_is_text('manifest', 'slug')} THEN 'slug must be a string' END,
               CASE WHEN ({_text('manifest', 'slug')}) NOT IN {_in(c.AGENCY_SLUGS)}
                    THEN concat('invalid agency slug: ', {_text('manifest', 'slug')}) END,
               CASE WHEN coalesce({_text('manifest', 'name')}, '') = '' THEN 'name must be a non-empty string' END)
               AS error, violations,
           coalesce(json_extract_string(manifest, '$.data_classification'), 'U') AS data_classification,
           CASE WHEN {_exists('manifest', 'retention_days')}
                THEN CASE WHEN json_type(manifest, '$.retention_days') IN ('BIGINT', 'UBIGINT')
                          THEN CAST(manifest->>'$.retention_days' AS BIGINT) END
                ELSE 2555 END AS retention_days
    FROM (SELECT *, {_violations_sql(c.MANIFEST_RULES, 'manifest', 'owner')} AS violations FROM manifests)""",
)
def _(spark, sf_dir):
    doc = c.Document()
    days = F.when(
        doc.exists("retention_days"),
        F.when(doc.is_type("retention_days", "integer"), doc.get("retention_days", "bigint")),
    ).otherwise(F.lit(c.DEFAULT_RETENTION_DAYS).cast("bigint"))
    return c.apply_contract(manifests(spark, sf_dir), c.MANIFEST_RULES, "manifest").select(
        "c_custkey",
        c.first_manifest_error().alias("error"),
        F.array_join("violations", "; ").alias("violations"),
        F.coalesce(doc.text("data_classification"), F.lit(c.DEFAULT_CLASSIFICATION)).alias(
            "data_classification"
        ),
        days.alias("retention_days"),
    )


def _schema_sql(doc: str, schema: dict, unknown: str) -> str:
    """Sorted violations of a flat schema: every keyword of every member, and the one unknown member."""
    cases = []
    for name in schema["required"]:
        cases.append(_rule_sql(c.Rule(name, "required"), doc))
    for name, sub in schema["properties"].items():
        for keyword, argument in sub.items():
            if keyword in ("type", "pattern", "enum", "minLength", "maxLength", "minimum", "maximum", "minItems"):
                cases.append(_rule_sql(c.Rule(name, keyword, argument), doc))
            elif keyword == "format":
                cases.append(_rule_sql(c.Rule(name, "pattern", c.UUID_PATTERN), doc).replace(": pattern'", ": format'"))
    listed = f"[{', '.join(cases)}, CASE WHEN {_exists(doc, unknown)} THEN '{unknown}: not allowed' END]"
    for name, sub in schema["properties"].items():
        if "items" in sub:
            items = f"CAST(json_extract({doc}, '$.{name}') AS VARCHAR[])"
            label = f"CASE WHEN {items}[i] NOT IN {_in(sub['items']['enum'])} THEN '{name}[' || (i - 1) || ']: enum' END"
            each = f"list_transform(range(1, len({items}) + 1), lambda i: {label})"
            listed = f"list_concat({listed}, CASE WHEN json_type({doc}, '$.{name}') = 'ARRAY' THEN {each} ELSE [] END)"
    return f"array_to_string(list_sort(list_filter({listed}, lambda v: v IS NOT NULL)), '; ')"


@query(
    "contract_schema",
    with_(_PAYLOADS)
    + f"""
    SELECT doc_id, violations = '' AS accepted, violations,
           CASE WHEN violations = '' THEN coalesce(json_extract_string(payload, '$.stage'), 'full') END AS stage
    FROM (SELECT *, {_schema_sql('payload', c.PAYLOAD_SCHEMA, 'dry_run')} AS violations FROM payloads)""",
)
def _(spark, sf_dir):
    return json_schema.apply_schema(payloads(spark, sf_dir), c.PAYLOAD_SCHEMA, "payload").select(
        "doc_id",
        "accepted",
        F.array_join("violations", "; ").alias("violations"),
        F.get_json_object("completed", "$.stage").alias("stage"),
    )


@query(
    "manifest_schema",
    with_(_MANIFESTS)
    + f"""
    SELECT c_custkey, violations = '' AS accepted, violations,
           CASE WHEN violations = '' THEN coalesce(json_extract_string(manifest, '$.data_classification'), 'U') END
               AS data_classification,
           CASE WHEN violations = '' THEN coalesce(CAST(manifest->>'$.retention_days' AS BIGINT), 2555) END AS retention_days,
           CASE WHEN violations = '' THEN coalesce(manifest->>'$.enabled', 'true') = 'true' END AS enabled
    FROM (SELECT *, {_schema_sql('manifest', c.MANIFEST_SCHEMA, 'owner')} AS violations FROM manifests)""",
)
def _(spark, sf_dir):
    def completed(name: str, kind: str):
        return F.get_json_object("completed", f"$.{name}").cast(kind).alias(name)

    return json_schema.apply_schema(manifests(spark, sf_dir), c.MANIFEST_SCHEMA, "manifest").select(
        "c_custkey",
        "accepted",
        F.array_join("violations", "; ").alias("violations"),
        completed("data_classification", "string"),
        completed("retention_days", "bigint"),
        completed("enabled", "boolean"),
    )


def _case(key: str, table: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {_list(steps)}" for name, steps in table.items())
    return f"coalesce(CASE {key} {whens} END, [])"


@query(
    "payload_steps",
    with_(
        _PAYLOADS,
        f"""
    resolved AS (
        SELECT doc_id, coalesce({_text('payload', 'stage')}, 'full') AS stage,
               coalesce({_text('payload', 'content_type')}, 'mixed') AS content_type,
               coalesce({_text('payload', 'use_case')}, 'general') AS use_case FROM payloads),
    planned AS (
        SELECT doc_id,
               CASE WHEN stage IN ('ingest', 'full')
                    THEN list_concat({_list(st.INGEST_BASE)}, {_case('content_type', st.INGEST)}) ELSE [] END
               || CASE WHEN stage IN ('transform', 'full')
                    THEN list_concat({_list(st.TRANSFORM_BASE)}, {_case('content_type', st.TRANSFORM)}) ELSE [] END
               || CASE WHEN stage IN ('export', 'full') THEN {_list(st.EXPORT)} ELSE [] END
               || {_case('use_case', st.USE_CASE)} AS steps
        FROM resolved
        WHERE stage IN {_in(c.STAGES)} AND content_type IN {_in(c.CONTENT_TYPES)}
          AND use_case IN {_in([*c.USE_CASES, 'general'])})""",
    )
    + """
    SELECT doc_id, CAST(unnest(range(1, len(steps) + 1)) AS INTEGER) AS step_number, unnest(steps) AS step
    FROM planned""",
)
def _(spark, sf_dir):
    doc = c.Document()
    resolved = payloads(spark, sf_dir).withColumn("document", F.try_parse_json("payload")).select(
        "doc_id",
        *[F.coalesce(doc.text(name), F.lit(value)).alias(name) for name, value in st.DEFAULTS.items()],
    )
    known = (
        F.col("stage").isin(c.STAGES)
        & F.col("content_type").isin(c.CONTENT_TYPES)
        & F.col("use_case").isin([*c.USE_CASES, "general"])
    )
    steps = st.steps_for(F.col("stage"), F.col("content_type"), F.col("use_case"))
    return resolved.filter(known).select("doc_id", F.posexplode(steps).alias("at", "step")).select(
        "doc_id", (F.col("at") + 1).alias("step_number"), "step"
    )


_ERROR_NAMES = [name for name, _, _ in c.ERROR_CLASSES] + ["OTHER_ERROR"]


@query(
    "error_classify",
    f"""
    SELECT event_id, error_class, CAST(coalesce(status, 500) AS INTEGER) AS http_status,
           coalesce(retry, false) AS retryable
    FROM (SELECT event_id, {_pick(_ERROR_NAMES, 'event_id')} AS error_class FROM events WHERE event_type = 'error')
    LEFT JOIN (VALUES {', '.join(f"('{n}', {s}, {r})" for n, s, r in c.ERROR_CLASSES)}) e(name, status, retry)
           ON name = error_class""",
)
def _(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _ERROR_NAMES])
    errors = read_table(spark, sf_dir, "events").filter("event_type = 'error'")
    kind = F.element_at(names, (F.col("event_id") % len(_ERROR_NAMES) + 1).cast("int"))
    return c.classify_errors(errors.select("event_id", kind.alias("error_class")), "error_class")
