"""JSON Schema documents compiled into column expressions.

A schema is read once, on the driver; what comes out is one expression over a
VARIANT column, so documents are checked and completed inside the tasks without
any Python.  Keywords that the compiler does not know are refused, never
passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Schema = dict[str, Any] | bool

#: How VARIANT names the JSON types (fixed values).
_KINDS = {
    "string": ["STRING"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}
#: Patterns of the formats (fixed values).
FORMATS = {
    "uuid": "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$",
    "date": "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "date-time": "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]"
    "([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$",
    "email": "^[^@ ]+@[^@ ]+[.][^@ ]+$",
    "ipv4": "^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]|$)){4}(?<![.])$",
}
#: Keywords that say nothing about a document's validity (fixed values).
_NOTES = {
    "$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "examples", "default", "deprecated",
    "readOnly", "writeOnly",
}


class SchemaError(ValueError):
    """The schema itself cannot be compiled."""


def _member(value: Column, name: str) -> Column:
    """A member of an object as VARIANT; NULL where there is none."""
    if '"' in name:
        raise SchemaError(f"a property may not have a double quote in its name: {name}")
    return F.variant_get(value, f'$["{name}"]', "variant")


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is(value: Column, *json_types: str) -> Column:
    """Whether the value is of one of the types; a whole number is an integer however it is written."""
    found = F.schema_of_variant(value)
    hit = F.lit(False)
    for json_type in json_types:
        names = _KINDS["number" if json_type == "integer" else json_type]
        fits = F.lit(False)
        for name in names:
            fits = fits | F.startswith(found, F.lit(name))
        if json_type == "integer":
            number = F.try_variant_get(value, "$", "double")
            fits = fits & (number == F.floor(number))
        hit = hit | fits
    return F.coalesce(hit, F.lit(False))


def _text(value: Column) -> Column:
    return F.when(_is(value, "string"), F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    return F.when(_is(value, "number"), F.try_variant_get(value, "$", "double"))


def _equals(value: Column, constant: Any) -> Column:
    if isinstance(constant, str):
        same = _text(value) == constant
    elif isinstance(constant, bool):
        same = F.when(_is(value, "boolean"), F.try_variant_get(value, "$", "boolean")) == constant
    elif isinstance(constant, (int, float)):
        same = _number(value) == float(constant)
    elif constant is None:
        same = _is(value, "null")
    else:
        same = F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))
    return F.coalesce(same, F.lit(False))


def _one_of(value: Column, allowed: list) -> Column:
    texts = [c for c in allowed if isinstance(c, str)]
    hit = F.coalesce(_text(value).isin(texts), F.lit(False)) if texts else F.lit(False)
    for constant in allowed:
        if not isinstance(constant, str):
            hit = hit | _equals(value, constant)
    return hit


#: Keywords of one value: from the value and the keyword's argument, whether it is broken; NULL where it does not apply.
_BROKEN: dict[str, Callable[[Column, Any], Column]] = {
    "type": lambda v, a: ~_is(v, *([a] if isinstance(a, str) else a)),
    "enum": lambda v, a: ~_one_of(v, a),
    "const": lambda v, a: ~_equals(v, a),
    "pattern": lambda v, a: ~_text(v).rlike(a),
    "format": lambda v, a: ~_text(v).rlike(FORMATS[a]),
    "minLength": lambda v, a: F.length(_text(v)) < a,
    "maxLength": lambda v, a: F.length(_text(v)) > a,
    "minimum": lambda v, a: _number(v) < a,
    "maximum": lambda v, a: _number(v) > a,
    "exclusiveMinimum": lambda v, a: _number(v) <= a,
    "exclusiveMaximum": lambda v, a: _number(v) >= a,
    "multipleOf": lambda v, a: _number(v) / a != F.floor(_number(v) / a),
    "minItems": lambda v, a: F.size(F.when(_is(v, "array"), _elements(v))) < a,
    "maxItems": lambda v, a: F.size(F.when(_is(v, "array"), _elements(v))) > a,
    "uniqueItems": lambda v, a: F.when(
        F.lit(a) & _is(v, "array"),
        F.size(F.array_distinct(F.transform(_elements(v), lambda x: F.to_json(x)))) < F.size(_elements(v)),
    ),
    "minProperties": lambda v, a: F.size(F.when(_is(v, "object"), _members(v))) < a,
    "maxProperties": lambda v, a: F.size(F.when(_is(v, "object"), _members(v))) > a,
}
_NESTED = {"properties", "required", "additionalProperties", "items", "allOf", "anyOf", "oneOf", "not", "$ref"}


class Compiler:
    """One schema document, with what its references lead to."""

    def __init__(self, document: Schema) -> None:
        self.document = document

    def resolve(self, schema: Schema, seen: tuple[str, ...]) -> tuple[Schema, tuple[str, ...]]:
        """The schema with its reference followed; a document that holds itself has no end and is refused."""
        while isinstance(schema, dict) and "$ref" in schema:
            reference = schema["$ref"]
            if reference in seen:
                raise SchemaError(f"reference to itself: {reference}")
            if not reference.startswith("#"):
                raise SchemaError(f"reference to another document: {reference}")
            target: Any = self.document
            for step in reference.lstrip("#").split("/")[1:]:
                try:
                    target = target[step.replace("~1", "/").replace("~0", "~")]
                except (KeyError, TypeError):
                    raise SchemaError(f"reference to nothing: {reference}") from None
            beside = {k: v for k, v in schema.items() if k != "$ref"}
            schema = {**beside, "allOf": [*beside.get("allOf", []), target]} if beside.keys() - _NOTES else target
            seen = (*seen, reference)
        return schema, seen

    def violations(self, schema: Schema, value: Column, path: Column | None, seen: tuple[str, ...] = ()) -> Column:
        """Labels ``path: keyword`` of all that the value breaks, as an array; none where it is NULL."""
        schema, seen = self.resolve(schema, seen)
        name = F.lit("document") if path is None else path

        def label(keyword: str) -> Column:
            return F.concat(name, F.lit(f": {keyword}"))

        if isinstance(schema, bool):
            return F.when(value.isNotNull() & F.lit(not schema), F.array(label("not allowed"))).otherwise(_none())
        unknown = schema.keys() - _BROKEN.keys() - _NESTED - _NOTES
        if unknown:
            raise SchemaError("unknown keywords: " + ", ".join(sorted(unknown)))
        if schema.get("format", "uuid") not in FORMATS:
            raise SchemaError(f"unknown format: {schema['format']}")
        single = [F.when(value.isNotNull() & _BROKEN[k](value, a), label(k)) for k, a in schema.items() if k in _BROKEN]

        def inner(member: str) -> Column:
            return F.lit(member) if path is None else F.concat(path, F.lit(f".{member}"))

        whole = _is(value, "object")
        for member in schema.get("required", []):
            single.append(F.when(whole & _member(value, member).isNull(), F.concat(inner(member), F.lit(": required"))))
        parts = [F.array_compact(F.array(*single))] if single else []
        known = schema.get("properties", {})
        for member, sub in known.items():
            parts.append(self.violations(sub, _member(value, member), inner(member), seen))
        more = schema.get("additionalProperties", True)
        if more is not True:
            listed = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
            others = F.filter(F.map_entries(_members(value)), lambda e: ~F.array_contains(listed, e["key"]))

            def outer(entry: Column) -> Column:
                return entry["key"] if path is None else F.concat(path, F.lit("."), entry["key"])

            parts.append(F.when(whole, F.flatten(F.transform(others, lambda e: self._other(more, e, outer(e), seen)))))
        if "items" in schema:
            sub = schema["items"]
            each = F.transform(
                _elements(value),
                lambda e, i: self.violations(sub, e, F.concat(F.lit("") if path is None else path, F.lit("["), i.cast("string"), F.lit("]")), seen),
            )
            parts.append(F.when(_is(value, "array"), F.flatten(each)))
        for sub in schema.get("allOf", []):
            parts.append(self.violations(sub, value, path, seen))
        chosen = []
        for keyword, right in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
            if keyword in schema:
                fits = [(F.size(self.violations(sub, value, path, seen)) == 0).cast("int") for sub in schema[keyword]]
                total = sum(fits[1:], fits[0])
                chosen.append(F.when(value.isNotNull() & ~right(total), label(keyword)))
        if "not" in schema:
            fits = F.size(self.violations(schema["not"], value, path, seen)) == 0
            chosen.append(F.when(value.isNotNull() & fits, label("not")))
        if chosen:
            parts.append(F.array_compact(F.array(*chosen)))
        if not parts:
            return _none()
        return F.concat(*(F.coalesce(part, _none()) for part in parts))

    def _other(self, more: Schema, entry: Column, path: Column, seen: tuple[str, ...]) -> Column:
        """Violations of a member that is not listed; a JSON null of a map is NULL, but there."""
        if more is False:
            return F.array(F.concat(path, F.lit(": not allowed")))
        return self.violations(more, F.coalesce(entry["value"], F.parse_json(F.lit("null"))), path, seen)

    def _has_defaults(self, schema: Schema, seen: tuple[str, ...]) -> bool:
        schema, seen = self.resolve(schema, seen)
        if isinstance(schema, bool):
            return False
        return any(
            "default" in (sub if isinstance(sub, dict) else {}) or self._has_defaults(sub, seen)
            for sub in schema.get("properties", {}).values()
        ) or ("items" in schema and self._has_defaults(schema["items"], seen))

    def filled(self, schema: Schema, value: Column, seen: tuple[str, ...] = ()) -> Column:
        """The value as JSON text, members in order of their names, with the defaults of members that are absent."""
        schema, seen = self.resolve(schema, seen)
        as_it_is = F.coalesce(F.to_json(value), F.lit("null"))
        if isinstance(schema, bool) or not self._has_defaults(schema, seen):
            return as_it_is
        result = F.when(F.lit(False), as_it_is)
        if "properties" in schema:
            result = result.when(_is(value, "object"), self._filled_object(schema["properties"], value, seen))
        if "items" in schema:
            texts = F.transform(_elements(value), lambda e: self.filled(schema["items"], e, seen))
            result = result.when(_is(value, "array"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
        return result.otherwise(as_it_is)

    def _filled_object(self, properties: dict[str, Schema], value: Column, seen: tuple[str, ...]) -> Column:
        def text(entry: Column) -> Column:
            chosen = F.when(F.lit(False), F.lit(""))
            for name, sub in properties.items():
                if self._has_defaults(sub, seen):
                    chosen = chosen.when(entry["key"] == name, self.filled(sub, entry["value"], seen))
            return chosen.otherwise(F.coalesce(F.to_json(entry["value"]), F.lit("null")))

        there = F.transform(
            F.map_entries(_members(value)), lambda e: F.struct(e["key"].alias("name"), text(e).alias("text"))
        )
        absent = []
        for name, sub in properties.items():
            sub, _ = self.resolve(sub, seen)
            if isinstance(sub, dict) and "default" in sub:
                entry = F.struct(F.lit(name).alias("name"), F.lit(json.dumps(sub["default"], separators=(",", ":"))).alias("text"))
                absent.append(F.when(_member(value, name).isNull(), entry))
        entries = F.array_sort(F.concat(there, F.array_compact(F.array(*absent))) if absent else there)
        written = F.transform(entries, lambda e: F.concat(_quoted(e["name"]), F.lit(":"), e["text"]))
        return F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def violations(schema: Schema, document: Column) -> Column:
    """What a VARIANT document breaks, sorted: labels ``path: keyword``."""
    return F.array_sort(F.array_distinct(Compiler(schema).violations(schema, document, None)))


def with_defaults(schema: Schema, document: Column) -> Column:
    """A VARIANT document completed by the schema's defaults, as JSON text; NULL stays NULL."""
    return F.when(document.isNotNull(), Compiler(schema).filled(schema, document))


def apply_schema(df: DataFrame, schema: Schema, json_text: str) -> DataFrame:
    """Add ``violations``, ``accepted`` and ``completed``, the accepted documents with their defaults.

    Text that is no JSON, or NULL, is one violation; rows not accepted are the
    quarantine and have no completed document.
    """
    document = F.try_parse_json(json_text)
    parsed = df.withColumn("_document", document)
    broken = F.when(F.col("_document").isNull(), F.array(F.lit("not valid JSON"))).otherwise(
        violations(schema, F.col("_document"))
    )
    checked = parsed.withColumn("violations", broken).withColumn("accepted", F.size("violations") == 0)
    completed = F.when(F.col("accepted"), with_defaults(schema, F.col("_document")))
    return checked.withColumn("completed", completed).drop("_document")
