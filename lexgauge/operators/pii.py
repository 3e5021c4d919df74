"""Personal data in text: candidates by pattern, proven by check digits and ranges, named by keyed pseudonyms.

A candidate is a longest run of the characters of its kind, so that a number
inside a longer one is none.  What its kind's arithmetic refutes (check digits
of cards and account numbers, areas that were never issued, octets over 255) is
left alone.  Built-in functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64  # bytes of a SHA-256 block
_PSEUDONYM = 16  # hexadecimal digits


def _characters(text: Column) -> Column:
    return F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))), lambda k: F.substring(text, k, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a text of digits has the check digit of a payment card."""
    from_behind = _characters(F.reverse(digits))

    def weighed(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(from_behind, weighed), F.lit(0), lambda sum_, x: sum_ + x)
    return F.coalesce(total % 10 == 0, F.lit(False))


def mod_97(code: Column) -> Column:
    """Whether an account number of capital letters and digits leaves 1: letters count as 10 to 35, the first four come last."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(rest: Column, character: Column) -> Column:
        value = F.ascii(character)
        return F.when(value >= 65, rest * 100 + value - 55).otherwise(rest * 10 + value - 48) % 97

    return F.coalesce(F.aggregate(_characters(moved), F.lit(0), step) == 1, F.lit(False))


def issued_ssn(value: Column) -> Column:
    """Whether area, group and serial number are of ranges that are given out."""
    area, group, serial = (F.substring_index(F.substring_index(value, "-", k), "-", -1).cast("int") for k in (1, 2, 3))
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def octets_in_range(value: Column) -> Column:
    """Whether all four numbers of an address are at most 255 and written without leading zeros."""
    return F.forall(F.split(value, "[.]"), lambda o: (F.length(o) <= 3) & (o.cast("int") <= 255) & ((o == "0") | (F.substring(o, 1, 1) != "0")))


@dataclass(frozen=True)
class Kind:
    """How one kind of personal data is found: its longest runs, their form and what proves them."""

    name: str
    run: str
    form: str
    strip: str
    holds: Callable[[Column], Column]


#: Kinds with their patterns (fixed values).  ``strip`` holds what is no part of the value.
KINDS = [
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}$", "", lambda v: F.lit(True)),
    Kind("card", "[0-9]+([ -][0-9]+)*", "^[0-9]{13,19}$", " -", luhn),
    Kind("iban", "[A-Za-z0-9]+", "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", "", mod_97),
    Kind("ssn", "[0-9]+(-[0-9]+)*", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "", issued_ssn),
    Kind("ip", "[0-9]+([.][0-9]+)*", "^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$", "", octets_in_range),
]


def pseudonym(value: Column, kind: str, key: str) -> Column:
    """The first digits of the HMAC-SHA-256 of kind and value: equal values stay equal, and the key is needed to try others."""
    secret = key.encode()
    secret = hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret
    secret = secret.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat(F.lit(f"{kind}:"), value), "UTF-8")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256), 1, _PSEUDONYM)


def _bare(raw: Column, kind: Kind) -> Column:
    """The run without the full stop or hyphen behind an address."""
    return F.rtrim(raw, F.lit(".-")) if kind.name == "email" else raw


def _value(raw: Column, kind: Kind) -> Column:
    return F.translate(_bare(raw, kind), kind.strip, "") if kind.strip else _bare(raw, kind)


def _values(text: Column, kind: Kind) -> Column:
    """The values of all proven candidates of a text."""
    values = F.transform(F.regexp_extract_all(text, F.lit(kind.run), F.lit(0)), lambda raw: _value(raw, kind))
    return F.filter(F.filter(values, lambda v: v.rlike(kind.form)), kind.holds)


def _told(kind: Kind, key: str) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(kind.name).alias("kind"), pseudonym(value, kind.name, key).alias("pseudonym"))


def find(docs: DataFrame, key: str) -> DataFrame:
    """Per document (doc_id, text), kind and value: doc_id, kind, pseudonym and how often it is there.

    Null and empty texts have none; rows that repeat a doc_id are counted together.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    found = [
        F.transform(_values(text, kind), _told(kind, key))
        for kind in KINDS
    ]
    rows = docs.select(docs["doc_id"], F.inline(F.concat(*found)))
    return rows.groupBy("doc_id", "kind", "pseudonym").agg(F.count("*").alias("n"))


def mask(docs: DataFrame, key: str, out: str = "masked") -> DataFrame:
    """``docs`` with the text in which every proven value is replaced by ``[kind:pseudonym]``.

    The kinds follow one another in the order of ``KINDS``; a null text stays null.
    """
    masked = docs.withColumn(out, F.col("text"))
    for kind in KINDS:
        masked = masked.withColumn(out, _replaced(F.col(out), kind, key))
    return masked


def _replaced(text: Column, kind: Kind, key: str) -> Column:
    """The text with the kind's proven runs replaced: gaps and runs are joined again in order."""
    runs = F.regexp_extract_all(text, F.lit(kind.run), F.lit(0))
    gaps = F.split(text, kind.run)

    def told(raw: Column) -> Column:
        bare, value = _bare(raw, kind), _value(raw, kind)
        mark = F.concat(F.lit(f"[{kind.name}:"), pseudonym(value, kind.name, key), F.lit("]"), F.substring(raw, F.length(bare) + 1, F.length(raw)))
        return F.when(value.rlike(kind.form) & kind.holds(value), mark).otherwise(raw)

    joined = F.zip_with(gaps, F.transform(runs, told), lambda gap, run: F.concat(gap, F.coalesce(run, F.lit(""))))
    return F.when(F.size(runs) > 0, F.array_join(joined, "")).otherwise(text)
