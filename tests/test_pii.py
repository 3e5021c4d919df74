import hashlib
import hmac
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgauge.operators import pii

KEY = "secret"


def slow_luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        twice = int(digit) * 2
        total += int(digit) if place % 2 == 0 else twice - 9 if twice > 9 else twice
    return total % 10 == 0


def slow_iban(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def slow_ip(value):
    return all(len(o) <= 3 and int(o) <= 255 and (o == "0" or o[0] != "0") for o in value.split("."))


def slow_ssn(value):
    area, group, serial = map(int, value.split("-"))
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


SLOW = {"email": lambda v: True, "card": slow_luhn, "iban": slow_iban, "ssn": slow_ssn, "ip": slow_ip}


def slow_runs(text, kind):
    for match in re.finditer(kind.run, text or ""):
        bare = match[0].rstrip(".-") if kind.name == "email" else match[0]
        value = "".join(c for c in bare if c not in kind.strip)
        if re.search(kind.form, value) and SLOW[kind.name](value):
            yield match.start(), match.start() + len(bare), value


def slow_name(kind, value):
    return hmac.new(KEY.encode(), f"{kind}:{value}".encode(), hashlib.sha256).hexdigest()[:16]


def some_texts(seed, count):
    chance = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, chance.integers(0, 10, n)))
    makers = [
        lambda: digits(chance.integers(12, 21)),
        lambda: " ".join(digits(4) for _ in range(4)),
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(x) for x in chance.integers(0, 400, 4)),
        lambda: f"GB{digits(2)}{'WEST'}{digits(14)}",
        lambda: f"a.{digits(1)}b@x-y.{'co' if chance.random() < 0.5 else 'c'}.",
        lambda: "word",
        lambda: f"{digits(2)}.{digits(1)}",
    ]
    return [" ".join(makers[k]() for k in chance.integers(0, len(makers), 30)) for _ in range(count)]


KNOWN = "4111 1111 1111 1111, 5500-0000-0000-0004; GB82WEST12345698765432 DE89370400440532013000 078-05-1120 10.0.0.1 a@b.org."
TEXTS = [KNOWN, KNOWN + " again 4111111111111111 and 4111 1111 1111 1112", None, "", "1.2.3.4.5 256.1.1.1 01.2.3.4 666-12-1234 000-12-1234 123-45-67890", "é@b.de x@y.z @a.b 漢@漢.de"]


def test_equal_to_plain_arithmetic(spark):
    rows = list(enumerate(TEXTS + some_texts(1, 150)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {(r["doc_id"], r["kind"], r["pseudonym"]): r["n"] for r in pii.find(docs, KEY).collect()}
    expected = {}
    for doc_id, text in rows:
        for kind in pii.KINDS:
            for _, _, value in slow_runs(text, kind):
                entry = (doc_id, kind.name, slow_name(kind.name, value))
                expected[entry] = expected.get(entry, 0) + 1
    assert found == expected
    assert {k for d, k, _ in found if d == 0} == {"card", "iban", "ssn", "ip", "email"}
    assert {k for d, k, _ in found if d == 4} == set()
    # Equal values have equal names, however they are written.
    assert found[(1, "card", slow_name("card", "4111111111111111"))] == 2


def test_masked_texts(spark):
    rows = list(enumerate(TEXTS + some_texts(2, 60)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for row in pii.mask(docs, KEY).collect():
        expected = row["text"]
        for kind in pii.KINDS:
            for begin, end, value in reversed(list(slow_runs(expected, kind))):
                expected = f"{expected[:begin]}[{kind.name}:{slow_name(kind.name, value)}]{expected[end:]}"
        assert row["masked"] == expected
    masked = pii.mask(docs, KEY).first()["masked"]
    assert "4111" not in masked and "WEST" not in masked and "10.0.0.1" not in masked and masked.endswith("].")


def test_few_random_numbers_are_taken_for_personal_data(spark):
    chance = np.random.default_rng(5)
    cards = ["".join(map(str, chance.integers(0, 10, 16))) for _ in range(4000)]
    ibans = [f"XX{''.join(map(str, chance.integers(0, 10, 20)))}" for _ in range(4000)]
    table = spark.createDataFrame(list(zip(cards, ibans)), "card string, iban string")
    share = table.agg(F.avg(pii.luhn(F.col("card")).cast("int")), F.avg(pii.mod_97(F.col("iban")).cast("int"))).first()
    assert share[0] == pytest.approx(0.1, abs=0.02) and share[1] == pytest.approx(1 / 97, abs=0.008)


def test_another_key_gives_other_names(spark):
    docs = spark.createDataFrame([(1, KNOWN)], "doc_id bigint, text string")
    one, two = ({r["pseudonym"] for r in pii.find(docs, k).collect()} for k in (KEY, "x" * 100))
    assert len(one) == len(two) == 7 and not one & two
    long_key = hashlib.sha256(b"x" * 100).digest()
    assert hmac.new(long_key, b"ip:10.0.0.1", hashlib.sha256).hexdigest()[:16] in two
