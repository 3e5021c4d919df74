"""Licence scans: notice phrases, identifier tags and the licence expressions that they form.

An Aho-Corasick automaton finds all phrases of a text at once in its words,
lower-cased and joined by single spaces.  What follows an identifier tag, and
phrases that are joined by "and", "or" or "with", are licence expressions; a
shunting-yard parser puts them in order and evaluates what they oblige to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that every scan counts, with their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further phrases with their labels; labels are identifiers in lower case where there is one (fixed values).
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "apache license version 2 0": "apache-2.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by 4 0": "cc-by-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words of the tags that an expression follows (fixed values).
TAGS = {"spdx license identifier", "license expression", "license"}
#: What a licence obliges to, by the first part of its identifier that is listed (fixed values).
PERMISSIVE, WEAK, STRONG, LIMITED, UNKNOWN = range(5)
OBLIGATIONS = {
    "mit": PERMISSIVE, "apache": PERMISSIVE, "bsd": PERMISSIVE, "isc": PERMISSIVE, "zlib": PERMISSIVE,
    "unlicense": PERMISSIVE, "bsl": PERMISSIVE, "cc0": PERMISSIVE, "cc-by": PERMISSIVE, "public-domain": PERMISSIVE,
    "0bsd": PERMISSIVE, "python": PERMISSIVE, "psf": PERMISSIVE,
    "lgpl": WEAK, "mpl": WEAK, "epl": WEAK, "cddl": WEAK,
    "gpl": STRONG, "agpl": STRONG, "gfdl": STRONG, "cc-by-sa": STRONG, "eupl": STRONG,
    "cc-by-nc": LIMITED, "cc-by-nd": LIMITED, "all-rights-reserved": LIMITED, "licenseref": LIMITED,
}
NAMES = ["permissive", "weak copyleft", "copyleft", "limited", "unknown"]
#: Words that make a phrase beside them a statement of terms (fixed values).
CUES = {"licensed", "license", "licence", "under", "released", "terms", "distributed", "copyright"}
#: Words that may stand between phrases of one expression (fixed values).
FILLERS = {"the", "a", "version", "terms", "of", "license", "either", "both"}
#: Precedence of the operators (fixed values).
BINDS = {"or": 1, "and": 2, "with": 3}
#: Scores of the evidence: a parsed tag, a phrase beside a cue, a phrase alone, a tag that does not parse (fixed values).
TAGGED, CUED, BARE, BROKEN = 1.0, 0.9, 0.6, 0.5
#: Words on either side in which a cue counts.
REACH = 8

_SEPARATORS = bytes(k for k in range(128) if not (0x30 <= k <= 0x39 or 0x61 <= k <= 0x7A))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+:-]*")
_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?([^\n\r\"']*)")
_COMMENT_END = re.compile(rb"\*/|-->|#}")

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, obligation string, expressions array<string>, "
    "spans array<struct<start_word bigint, n_words int, label string>>"
)


class BadExpression(ValueError):
    """What stands there is no licence expression."""


def postfix(tokens: list[str]) -> list[str]:
    """Operands and operators of an infix expression in postfix order (shunting yard)."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for token in tokens:
        if token == "(":
            if not operand:
                raise BadExpression(token)
            waiting.append(token)
        elif token == ")":
            while not operand and waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if operand or not waiting:
                raise BadExpression(token)
            waiting.pop()
        elif token in BINDS:
            if operand:
                raise BadExpression(token)
            while waiting and BINDS.get(waiting[-1], 0) >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            if not operand:
                raise BadExpression(token)
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        raise BadExpression("end")
    return out + waiting[::-1]


def obligation(identifier: str) -> int:
    """What one licence obliges to, by the longest listed beginning of its identifier."""
    name = identifier.rstrip("+")
    while name:
        if name in OBLIGATIONS:
            return OBLIGATIONS[name]
        name = name.rpartition("-")[0]
    return UNKNOWN


def evaluate(order: list[str]) -> tuple[int, list[str]]:
    """The obligation of a postfix expression and its licences.

    Of "or" the reader takes the lighter side that is known, "and" needs both;
    an exception after "with" makes strong copyleft weak and is no licence itself.
    """
    # Levels, with the operand's number while a side is one operand.
    stack: list[tuple[int, int | None]] = []
    names: dict[int, str] = {}
    for number, token in enumerate(order):
        if token not in BINDS:
            names[number] = token
            stack.append((obligation(token), number))
            continue
        (right, exception), (left, licence) = stack.pop(), stack.pop()
        if token == "with":
            if exception is None or licence is None:
                raise BadExpression(token)
            del names[exception]
            stack.append((WEAK if left == STRONG else left, None))
        elif token == "or":
            stack.append((min((s for s in (left, right) if s != UNKNOWN), default=UNKNOWN), None))
        else:
            stack.append((max(left, right), None))
    ((level, _),) = stack
    return level, list(names.values())


def parse(tokens: list[str]) -> tuple[int, list[str]]:
    return evaluate(postfix(tokens))


def _known(tokens: list[str] | None) -> bool:
    """Whether the tokens parse and every licence is known."""
    try:
        return tokens is not None and UNKNOWN not in map(obligation, parse(tokens)[1])
    except BadExpression:
        return False


@dataclass
class Found:
    """What a scan has of one text."""

    spans: list[tuple[int, int, str]] = field(default_factory=list)
    base: list[tuple[int, str]] = field(default_factory=list)
    tags: list[tuple[int, int]] = field(default_factory=list)


@lru_cache(1)
def _automaton():
    """Phrases between spaces; a worker builds it once."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in BASE.keys() | NOTICES.keys() | TAGS:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def _find(words: list[bytes]) -> Found:
    """All places where phrases and tags stand, by their first word, in the order of their ends."""
    # One byte is one character here, so that places count bytes of the joined words.
    line = f" {b' '.join(words).decode('latin-1')} "
    found, place, counted = Found(), 0, 0
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in _automaton().iter(line))
    for begin, phrase in hits:
        place += line.count(" ", counted, begin)
        counted = begin
        if phrase in TAGS:
            found.tags.append((place, phrase.count(" ") + 1))
        if phrase in BASE:
            found.base.append((place, BASE[phrase]))
        if phrase in BASE or phrase in NOTICES:
            found.spans.append((place, phrase.count(" ") + 1, BASE.get(phrase) or NOTICES[phrase]))
    return found


def _tagged(lowered: bytes, tags: list[tuple[int, int]]) -> Iterator[tuple[int, list[str] | None]]:
    """The number of words of each tag and the tokens behind it; None where other things stand in its line."""
    ends = [m.end() for m in _WORD.finditer(lowered)] if tags else []
    for place, size in tags:
        behind = _AFTER_TAG.match(lowered, ends[place + size - 1])
        if behind:
            text = _COMMENT_END.split(behind[1])[0]
            tokens = _TOKEN.findall(text)
            whole = b"".join(tokens) == b"".join(text.split())
            yield size, [t.decode() for t in tokens] if tokens and whole else None


def _longest(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that lie in no longer one, from left to right."""
    kept: list[tuple[int, int, str]] = []
    for begin, size, label in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or begin + size > kept[-1][0] + kept[-1][1]:
            kept.append((begin, size, label))
    return kept


def _joined(words: list[bytes], spans: list[tuple[int, int, str]]) -> list[list[str]]:
    """Expressions of phrases: neighbours between which "and", "or" or "with" and fillers stand."""
    result: list[list[str]] = []
    end = None
    for begin, size, label in spans:
        between = [w.decode("latin-1") for w in words[end:begin]] if end is not None and 0 < begin - end <= 6 else []
        joints = [w for w in between if w in BINDS]
        if len(joints) == 1 and all(w in FILLERS or w in BINDS or w.isdigit() for w in between):
            result[-1] += [joints[0], label]
        else:
            result.append([label])
        end = begin + size
    return result


def scan_text(text: bytes) -> tuple:
    """The columns of ``SCHEMA`` behind doc_id, for the UTF-8 bytes of one text."""
    lowered = text.lower()  # of bytes: A-Z alone
    words = lowered.translate(_TO_SPACE).split()
    found = _find(words)
    labels = {label for _, label in found.base}
    expressions: list[str] = []
    levels: list[int] = []
    score = 0.0

    def add(tokens: list[str], evidence: float) -> None:
        nonlocal score
        try:
            level, names = parse(tokens)
        except BadExpression:
            level, names, evidence = UNKNOWN, [t for t in tokens if obligation(t) != UNKNOWN], BROKEN
        labels.update(name if obligation(name) != UNKNOWN else "unknown" for name in names)
        expressions.append(" ".join(tokens))
        levels.append(level)
        score = max(score, evidence)

    for size, tokens in _tagged(lowered, found.tags):
        if size == 1 and not _known(tokens):
            # "License: see below" is no tag.
            continue
        if tokens is None:
            score = max(score, BROKEN)
        else:
            add(tokens, TAGGED)
    spans = _longest(found.spans)
    cued = any(
        CUES.intersection(w.decode("latin-1") for w in words[max(0, b - REACH) : b] + words[b + n : b + n + REACH]) for b, n, _ in spans
    )
    for tokens in _joined(words, spans):
        add(tokens, CUED if cued else BARE)
    places = [place for place, _ in found.base]
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted({label for _, label in found.base})),
        ",".join(sorted(labels)),
        score,
        # Statements of one text bind together.
        NAMES[max(levels)] if levels else None,
        expressions,
        [{"start_word": b, "n_words": n, "label": label} for b, n, label in sorted(found.spans)],
    )


def _scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = [scan_text(text.as_py()) for text in batch.column("text")]
        columns = list(zip(*rows)) if rows else [[]] * 10
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.list_(pa.string())]
        spans = pa.list_(pa.struct([("start_word", pa.int64()), ("n_words", pa.int32()), ("label", pa.string())]))
        arrays = [pa.array(c, kind) for c, kind in zip(columns, [*kinds, spans])]
        names = "n_words n_base first_word last_word base_labels labels score obligation expressions spans".split()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), null texts as empty ones.

    Words are runs of digits, letters a-z (A-Z in lower case) and characters
    beyond ASCII.  ``n_base``, ``first_word``, ``last_word`` and ``base_labels``
    are of the phrases in ``BASE``: all their places, the smallest and largest
    start (null without any), and labels sorted and joined by commas.
    ``labels`` adds those of ``NOTICES`` and of identifier tags
    (``SPDX-License-Identifier: ...``; ``License: ...`` if all behind it is
    known), an identifier that is not known as ``unknown``.  ``score`` is the best evidence: 1 for a tag with
    an expression, 0.9 for a phrase beside words of terms, 0.6 for a phrase
    alone, 0.5 for an expression that does not parse, 0 for nothing.
    ``obligation`` is the heaviest of the text's expressions, which
    ``expressions`` lists; ``spans`` holds all phrases with their places.

    Each text is read whole and on its own; empty texts have no words and no
    labels, and rows that are repeated are answered alike.
    """
    text = F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")
    return docs.select(docs["doc_id"], text).mapInArrow(_scan, SCHEMA)
