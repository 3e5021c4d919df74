import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgauge.llm import licenses
from lexgauge.llm.licenses import PERMISSIVE, STRONG, UNKNOWN, WEAK
from lexgauge.llm.queries import op13_licenses
from tests.llm import plain


def slow_base(text):
    """The contract's columns by looking at every place for every phrase."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [
        (k, label)
        for phrase, label in licenses.BASE.items()
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    starts = [k for k, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def scan(text):
    return licenses.scan_text(text.encode())


WORDS = "gnu general public license apache cc by mit nc version 2 3 or and the SPDX-License-Identifier: é x".split()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", "\n", "-", ", ", "\0", ""])), max_size=60))
def test_base_places_equal_a_plain_search(parts):
    text = "".join(word.upper() + gap if k % 3 else word + gap for k, (word, gap) in enumerate(parts))
    found = scan(text)
    assert found[:5] == slow_base(text)
    assert set(found[4].split(",")) - {""} <= set(found[5].split(","))
    assert 0 <= found[6] <= 1


NAMES = ["mit", "apache-2.0", "gpl-3.0-only", "gpl-2.0+", "lgpl-2.1", "cc-by-nc-4.0", "nobody-knows"]
TREES = st.recursive(
    st.sampled_from(NAMES), lambda sub: st.tuples(sub, st.sampled_from(["and", "or"]), sub), max_leaves=12
)


def written(tree, inside=0):
    if isinstance(tree, str):
        return [tree]
    left, operator, right = tree
    binds = {"or": 1, "and": 2}[operator]
    # The right side needs brackets where it binds no more tightly.
    tokens = [*written(left, binds), operator, *written(right, binds + 0.5)]
    return ["(", *tokens, ")"] if binds < inside else tokens


def value(tree):
    if isinstance(tree, str):
        return licenses.obligation(tree), [tree]
    (left, first), (right, second) = value(tree[0]), value(tree[2])
    known = [s for s in (left, right) if s != UNKNOWN]
    return max(left, right) if tree[1] == "and" else min(known, default=UNKNOWN), first + second


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_expressions_keep_their_tree(tree):
    assert licenses.parse(written(tree)) == value(tree)


def test_with_binds_tightest():
    assert licenses.parse("gpl-2.0 with classpath-exception-2.0".split()) == (WEAK, ["gpl-2.0"])
    assert licenses.parse("mit and gpl-2.0 with autoconf-exception-3.0 or apache-2.0".split()) == (
        PERMISSIVE,
        ["mit", "gpl-2.0", "apache-2.0"],
    )
    assert licenses.postfix("mit or gpl-2.0 with x and isc".split()) == "mit gpl-2.0 x with isc and or".split()


@pytest.mark.parametrize(
    "text", ["", "and", "mit or", "or mit", "mit isc", "( mit", "mit )", "( )", "mit ( isc )", "( mit or isc ) with x", "mit with ( a )  b"]
)
def test_what_is_no_expression(text):
    with pytest.raises(licenses.BadExpression):
        licenses.parse(text.split())


def test_long_expressions():
    many = 30_000
    assert licenses.parse(["mit", "or"] * many + ["isc"])[0] == PERMISSIVE
    assert licenses.parse(["("] * many + ["gpl-3.0"] + [")"] * many) == (STRONG, ["gpl-3.0"])


def test_tags_and_notices():
    tag = scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\ncode")
    assert tag[5:7] == ("apache-2.0,gpl-2.0-only,mit", 1.0)
    assert tag[7:9] == ("weak copyleft", ["( mit or apache-2.0 ) and gpl-2.0-only with classpath-exception-2.0"])
    assert scan("/* SPDX-License-Identifier: ISC */ x")[5] == "isc"
    assert scan('"license": "BSD-3-Clause",')[5:7] == ("bsd-3-clause", 1.0)
    assert scan("License: see the file LICENSE")[5:7] == ("", 0.0)
    assert scan("SPDX-License-Identifier: Own-1.0")[5:8] == ("unknown", 1.0, "unknown")
    assert scan("SPDX-License-Identifier: MIT OR")[5:7] == ("mit", 0.5)
    assert scan("SPDX-License-Identifier:")[6] == 0.5
    dual = scan("It is dual licensed under the MIT License or the Apache License, Version 2.0.")
    assert dual[4:6] == ("apache,mit", "apache,apache-2.0,mit")
    assert dual[6:9] == (0.9, "permissive", ["mit or apache-2.0"])
    assert scan("one apache license two")[6] == 0.6
    assert scan("Licensed under CC BY-NC 4.0.")[4:8] == ("cc-by", "cc-by,cc-by-nc-4.0", 0.9, "limited")
    assert scan("some cc0 word")[6] == 0.6
    # Overlapping phrases are all spans, the longest makes the expression.
    gpl = scan("the GNU General Public License, version 3")
    assert [s["label"] for s in gpl[9]] == ["gpl", "gpl-3.0"] and gpl[8] == ["gpl-3.0"]
    assert scan("cc by cc by cc by")[1:4] == (3, 0, 4)


@pytest.mark.parametrize("change", [lambda d: d, plain.clashing])
def test_odd_documents(spark, change):
    notice = "Released under the MIT License.\n"
    rows = plain.odd_documents() + [
        (20, notice, "en", "a", 1),
        (20, notice, "en", "a", 1),
        (21, "x " * 50_000 + notice * 2_000, "en", "a", 1),
    ]
    found = licenses.scan(change(plain.documents(spark, rows))).collect()
    ours = sorted(((r[0] is not None, r[0] or 0, *r[1:6]) for r in found), key=str)
    assert ours == sorted(((d is not None, d or 0, *slow_base(t)) for d, t, *_ in rows), key=str)
    assert licenses.scan(change(plain.documents(spark, []))).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op13_licenses(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        assert tuple(row)[1:6] == slow_base(texts[row["doc_id"]])
        assert (row["score"] > 0) == bool(row["labels"])
