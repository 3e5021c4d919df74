import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgauge.operators import contracts, json_schema
from lexgauge.operators.json_schema import SchemaError

NESTED = {
    "type": "object",
    "required": ["id", "owner"],
    "$defs": {
        "slug": {"type": "string", "pattern": "^[a-z-]+$", "minLength": 2},
        "place": {"anyOf": [{"type": "string", "format": "uri"}, {"type": "null"}]},
    },
    "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100, "multipleOf": 3},
        "owner": {
            "type": "object",
            "required": ["slug"],
            "properties": {
                "slug": {"$ref": "#/$defs/slug"},
                "level": {"enum": [1, 2.5, "high", None, True, ["x"]], "default": 1},
                "rights": {"type": "object", "properties": {"read": {"type": "boolean", "default": True}}, "maxProperties": 2},
            },
            "additionalProperties": {"type": "string", "maxLength": 3},
        },
        "tags": {
            "type": "array",
            "minItems": 1,
            "maxItems": 3,
            "uniqueItems": True,
            "items": {
                "type": "object",
                "required": ["name"],
                "properties": {"name": {"$ref": "#/$defs/slug"}, "weight": {"type": "number", "default": 0.5}},
                "additionalProperties": False,
            },
        },
        "source": {"$ref": "#/$defs/place"},
        "when": {"oneOf": [{"format": "date", "type": "string"}, {"type": "string", "maxLength": 4}]},
        "odd name": {"not": {"type": "array"}, "allOf": [{"minLength": 1}, {"const": "x"}]},
    },
    "additionalProperties": False,
}


def kind(value):
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def equal(a, b):
    return kind(a) == kind(b) and a == b


def slow(schema, value, path, root):
    """A plain validator, one value at a time."""
    name = path or "document"
    if isinstance(schema, bool):
        return [] if schema else [f"{name}: not allowed"]
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].split("/")[1:]:
            target = target[step]
        return slow(target, value, path, root)
    inner = lambda member: f"{path}.{member}" if path else member
    found = []

    def broken(keyword, is_broken):
        if keyword in schema and is_broken(schema[keyword]):
            found.append(f"{name}: {keyword}")

    def has(wanted):
        return kind(value) == wanted or wanted == "integer" and kind(value) == "number" and value == math.floor(value)

    broken("type", lambda a: not any(map(has, [a] if isinstance(a, str) else a)))
    broken("enum", lambda a: not any(equal(value, x) for x in a))
    broken("const", lambda a: not equal(value, a))
    if kind(value) == "string":
        broken("pattern", lambda a: not re.search(a, value))
        broken("format", lambda a: not re.search(json_schema.FORMATS[a], value))
        broken("minLength", lambda a: len(value) < a)
        broken("maxLength", lambda a: len(value) > a)
    if kind(value) == "number":
        broken("minimum", lambda a: value < a)
        broken("exclusiveMaximum", lambda a: value >= a)
        broken("multipleOf", lambda a: value / a != math.floor(value / a))
    if kind(value) == "array":
        broken("minItems", lambda a: len(value) < a)
        broken("maxItems", lambda a: len(value) > a)
        broken("uniqueItems", lambda a: len({json.dumps(x, sort_keys=True) for x in value}) < len(value))
        for i, item in enumerate(value):
            found += slow(schema.get("items", True), item, f"{path}[{i}]", root)
    if kind(value) == "object":
        broken("maxProperties", lambda a: len(value) > a)
        found += [f"{inner(m)}: required" for m in schema.get("required", []) if m not in value]
        for member, inside in value.items():
            sub = schema.get("properties", {}).get(member, schema.get("additionalProperties", True))
            found += slow(sub, inside, inner(member), root)
    for sub in schema.get("allOf", []):
        found += slow(sub, value, path, root)
    for keyword, right in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        broken(keyword, lambda subs: not right(sum(not slow(s, value, path, root) for s in subs)))
    broken("not", lambda sub: not slow(sub, value, path, root))
    return found


def slow_defaults(schema, value, root):
    if isinstance(schema, dict) and "$ref" in schema:
        return slow_defaults(root["$defs"][schema["$ref"].split("/")[-1]], value, root)
    if isinstance(schema, dict) and isinstance(value, dict):
        subs = schema.get("properties", {})
        value = {k: slow_defaults(subs.get(k, True), v, root) for k, v in value.items()}
        return value | {k: s["default"] for k, s in subs.items() if "default" in s and k not in value}
    if isinstance(schema, dict) and isinstance(value, list):
        return [slow_defaults(schema.get("items", True), v, root) for v in value]
    return value


def some_documents(seed, count):
    """Documents put together at random from good and bad parts."""
    chance = np.random.default_rng(seed)
    pick = lambda values: values[chance.integers(0, len(values))]
    leaves = [1, 3, 99, 102, 0, 2.5, 6.0, "x", "ab-c", "Ab", "", "https://a.b/c", "no uri", None, True, False, [], ["x"], {}, "2024-02-03", 'q"\\é']

    def some(members, odd):
        out = {m: f() for m, f in members.items() if chance.random() < 0.8}
        return out | ({odd: pick(leaves)} if chance.random() < 0.2 else {})

    def tag():
        return some({"name": lambda: pick(["ab", "cd", "A", 1]), "weight": lambda: pick([1, 0.5, "w"])}, "odd")

    def owner():
        rights = lambda: some({"read": lambda: pick([True, "no"])}, "write")
        parts = {"slug": lambda: pick(["nasa", "N", 3, "noaa"]), "level": lambda: pick(leaves), "rights": rights}
        return some(parts, pick(["nick", "a.b", "c d"]))

    members = {
        "id": lambda: pick([3, 6, 99, 6.0, *leaves]),
        "owner": lambda: owner() if chance.random() < 0.8 else pick(leaves),
        "tags": lambda: [tag() for _ in range(chance.integers(0, 5))] if chance.random() < 0.8 else pick(leaves),
        "source": lambda: pick(leaves),
        "when": lambda: pick(["2024-02-03", "now", "2024", "longer than four", 4]),
        "odd name": lambda: pick(["x", "y", "", [], 1]),
    }
    return [some(members, "extra") if chance.random() < 0.95 else pick(leaves) for _ in range(count)]


def applied(spark, schema, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return json_schema.apply_schema(df, schema, "text").orderBy("k").collect()


def test_equal_to_a_plain_validator(spark):
    good = [
        {"id": 9.0, "owner": {"slug": "noaa", "nick": "abc"}},
        {"id": 3, "owner": {"slug": "ab", "level": ["x"]}, "tags": [{"name": "ab"}, {"name": "cd", "weight": 1}], "odd name": "x"},
        {"id": 99, "owner": {"slug": "ab", "rights": {"write": 1}}, "source": None, "when": "now"},
    ]
    documents = some_documents(1, 400) + good
    rows = applied(spark, NESTED, [json.dumps(d) for d in documents])
    for row, document in zip(rows, documents):
        assert row["violations"] == sorted(set(slow(NESTED, document, "", NESTED))), document
        assert row["accepted"] == (not row["violations"])
    assert sum(r["accepted"] for r in rows) > len(good) and all(r["accepted"] for r in rows[-len(good) :])


def test_defaults_are_filled_at_every_level(spark):
    documents = [d for d in some_documents(2, 300)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents)], "k int, text string")
    filled = df.select("k", json_schema.with_defaults(NESTED, F.parse_json("text")).alias("t")).orderBy("k").collect()
    for row, document in zip(filled, documents):
        assert json.loads(row["t"]) == slow_defaults(NESTED, document, NESTED)


def test_text_that_is_no_json(spark):
    rows = applied(spark, NESTED, ["{", None, "", "7", "null", '{"id":3,"owner":{"slug":"ab"}}'])
    assert [r["violations"] for r in rows[:3]] == [["not valid JSON"]] * 3
    assert rows[3]["violations"] == rows[4]["violations"] == ["document: type"]
    assert rows[5]["accepted"] and json.loads(rows[5]["completed"]) == {"id": 3, "owner": {"level": 1, "slug": "ab"}}
    assert rows[0]["completed"] is None


def test_published_contracts(spark):
    good = '{"agency":"nasa","content_type":"text","use_case":"vr","metadata":{"any":[1]},"checkpoint_id":"' + "0" * 8 + "-0000" * 3 + "-" + "0" * 12 + '"}'
    bad = '{"agency":"N","content_type":"film","metadata":1,"checkpoint_id":"x","stage":null,"other":1}'
    rows = applied(spark, contracts.PAYLOAD_SCHEMA, [good, bad])
    assert rows[0]["accepted"] and json.loads(rows[0]["completed"])["stage"] == "full"
    assert rows[1]["violations"] == [
        "agency: minLength", "agency: pattern", "checkpoint_id: format", "content_type: enum", "metadata: type",
        "other: not allowed", "stage: enum", "stage: type", "use_case: required",
    ]
    manifest = '{"slug":"nasa","name":"NASA","retention_days":7.5,"supported_content_types":["text","film",3]}'
    (row,) = applied(spark, contracts.MANIFEST_SCHEMA, [manifest])
    assert row["violations"] == ["retention_days: type", "supported_content_types[1]: enum", "supported_content_types[2]: enum"]


@pytest.mark.parametrize(
    "schema, message",
    [
        ({"typo": "string"}, "unknown keywords: typo"),
        ({"properties": {"a": {"format": "colour"}}}, "unknown format"),
        ({"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}}, "reference to itself"),
        ({"$ref": "#/$defs/none"}, "reference to nothing"),
        ({"$ref": "other.json#/a"}, "another document"),
        ({"properties": {'a"b': True}}, "double quote"),
    ],
)
def test_schemas_that_are_refused(spark, schema, message):
    with pytest.raises(SchemaError, match=message):
        json_schema.violations(schema, F.parse_json(F.lit("{}")))
