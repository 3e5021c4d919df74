"""Plain versions of the operators, and small tables with every odd case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SPACE = "[\x20\x09-\x0d]+"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    """Seeded text of invented words, a line break after every ninth."""
    chance = np.random.default_rng(seed)
    names = [f"w{n:x}" for n in chance.integers(0, vocabulary, words)]
    return " ".join(n + ("\n" if i % 9 == 8 else "") for i, n in enumerate(names))


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and blank and long texts, repeated rows, ties."""
    same = prose(1, 120)
    rows = [
        (0, same, "en", "a"),
        (1, same, "en", "a"),
        (2, same.replace("w1", "w2", 1), "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t ", "de", None),
        (6, "one two three", None, None),
        (7, prose(2, 30_000), "de", "a"),
        (8, "\n".join(["All rights reserved."] * 3 + [prose(3, 60)]), "en", "c"),
        (9, "Ünïcødé ﬀ 漢字 😀 " * 20, "fr", "c"),
        (None, prose(4, 80), "en", "a"),
        (None, None, None, None),
        (10, prose(5, 90), "en", "a"),
        (10, prose(5, 90), "en", "a"),
        (-3, "x " * 100, "en", "b"),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, DOCS)


def clashing(docs):
    """The same table with columns named like what operators make, and in another order."""
    from pyspark.sql import functions as F

    names = "row words fp shard slot size p weight tokens topic key keys line score place start kept group root u v".split()
    return docs.select("source", *(F.lit(f"clash {n}").alias(n) for n in names), "text", "n_chars", "doc_id", "lang")


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    found = words(ascii_lower(text or ""))
    if not found:
        return 0
    pieces = [" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], radius: int = 4) -> list[int]:
    """Index of the first fingerprint reachable from each one."""
    parent = list(range(len(prints)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(prints))]


def drop_lines(texts: list[str | None], min_docs: int) -> list[tuple[int, int, str]]:
    """(lines, dropped, kept text) of each text."""
    split = [(t or "").split("\n") for t in texts]
    keyed = [[ascii_lower(line.strip(" \t\n\x0b\f\r")) for line in lines] for lines in split]
    held = Counter(key for keys in keyed for key in set(keys) if key)
    out = []
    for lines, keys in zip(split, keyed):
        kept = [line for line, key in zip(lines, keys) if held[key] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def edit_distance(pattern: list, text: list) -> int:
    """Fewest edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def repeat_words(text: str | None) -> int:
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    times = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)})


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
