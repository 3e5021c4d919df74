"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

Words of one length form a forest of shards.  A shard is a box of a k-d tree
over the words' letter counts, planned on a bounded sample.  A word is stored in
the one box that holds its counts and asks every box that a single edit can
reach: a replaced letter moves one count down and one up, an added letter moves
one count up.  Inside a shard a second tree prunes in the same way, and the
pairs whose counts are that close have their letter order compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.llm.common import ascii_lower
from lexgauge.session import materialize

#: Letters a word is made of (fixed values).
LETTERS = "A-Za-zÀ-ÿ"
#: Words on which the shards are planned, at most about so many.
SAMPLE = 1 << 16
#: Letters that the stored words of one shard, or of one part of it, may have.
SHARD_LETTERS = 1 << 19
#: Count vectors of a leaf, which are compared with a query at once.
LEAF = 128
#: Pairs of words that are looked at together.
PAIRS = 1 << 20
#: What a row of a shard is: a stored word, a query of the same length, a query that is one letter shorter.
STORED, SAME, SHORTER = 0, 1, 2
_FOUND = "word binary, n_near bigint, near_n bigint, near binary"


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, slip: int | None = None) -> DataFrame:
    """Words of ``docs`` (doc_id, text) as (word, n): maximal runs of letters, A-Z in lower case.

    Words have ``shortest`` letters or more and occur ``least`` times or more
    in all texts; a null text has none.  With ``slip``, every run whose crc32 of
    ``<doc_id>:<run>`` is divisible by it loses the letter at that number modulo
    its length, which plants misspellings (a null doc_id counts as empty).
    """
    found = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    runs = docs.select(docs["doc_id"], F.explode(found).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run")
    if slip:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
        runs = runs.withColumn("h", F.crc32(key))
        place = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
        word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


class Letters:
    """Counts of the letters that the stored words use; all others share the last place."""

    def __init__(self, codes: np.ndarray) -> None:
        used = np.unique(codes)
        self.size = len(used) + 1
        self.place = np.full(256, len(used), np.intp)
        self.place[used] = np.arange(len(used))

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """A row of counts for each row of letter codes."""
        rows, length = codes.shape
        counts = np.zeros((rows, self.size), np.int32)
        row = np.arange(rows)
        for k in range(length):
            np.add.at(counts, (row, self.place[codes[:, k]]), 1)
        return counts


class Tree:
    """A k-d tree over rows of counts: boxes, and the rows of each leaf.

    A node is split where a count of one letter halves its rows best.  Boxes
    are those of the cuts (``tight=False``, so that rows seen later have a leaf,
    too) or of the node's own rows.
    """

    def __init__(self, counts: np.ndarray, leaf: int, tight: bool = True) -> None:
        self.cuts: list[tuple[int, int, int, int] | None] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[np.ndarray | None] = []
        size = counts.shape[1]
        most = np.iinfo(np.int32).max
        todo = [(np.arange(len(counts)), np.zeros(size, np.int32), np.full(size, most, np.int32), -1, False)]
        while todo:
            rows, low, high, parent, right = todo.pop()
            node = len(self.cuts)
            if parent >= 0:
                letter, cut, left_child, right_child = self.cuts[parent]
                self.cuts[parent] = (letter, cut, left_child, node) if right else (letter, cut, node, right_child)
            here = counts[rows]
            self.low.append(here.min(axis=0) if tight else low)
            self.high.append(here.max(axis=0) if tight else high)
            split = self._split(here) if len(rows) > leaf else None
            if split is None:
                self.cuts.append(None)
                self.rows.append(rows)
                continue
            letter, cut = split
            self.cuts.append((letter, cut, -1, -1))
            self.rows.append(None)
            below = here[:, letter] <= cut
            high_left, low_right = high.copy(), low.copy()
            high_left[letter], low_right[letter] = cut, cut + 1
            todo.append((rows[below], low, high_left, node, False))
            todo.append((rows[~below], low_right, high, node, True))

    @staticmethod
    def _split(here: np.ndarray) -> tuple[int, int] | None:
        """The letter and count whose cut is most even; None where all rows are equal."""
        best, half = None, len(here) / 2
        for cut in np.unique(here)[:-1]:
            below = (here <= cut).sum(axis=0)
            off = np.abs(below - half)
            off[(below == 0) | (below == len(here))] = np.inf
            letter = int(off.argmin())
            if np.isfinite(off[letter]) and (best is None or off[letter] < best[0]):
                best = (off[letter], letter, int(cut))
        return best and best[1:]

    def place(self, counts: np.ndarray) -> np.ndarray:
        """The leaf that holds each row."""
        at = np.zeros(len(counts), np.int64)
        todo = [(0, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if self.cuts[node] is None:
                at[rows] = node
                continue
            letter, cut, left, right = self.cuts[node]
            below = counts[rows, letter] <= cut
            todo += [(left, rows[below]), (right, rows[~below])]
        return at

    def reached(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows that get into its box by at most ``up`` letters more and ``down`` fewer."""
        todo = [(0, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            here = counts[rows]
            lacks = np.maximum(self.low[node] - here, 0).sum(axis=1)
            over = np.maximum(here - self.high[node], 0).sum(axis=1)
            rows = rows[(lacks <= up) & (over <= down)]
            if not len(rows):
                continue
            if self.cuts[node] is None:
                yield node, rows
            else:
                todo += [(self.cuts[node][2], rows), (self.cuts[node][3], rows)]


def _steps(kind: int) -> tuple[int, int]:
    """Letters that a query of the kind gains and loses on its way to a stored word."""
    return (1, 1) if kind == SAME else (1, 0)


def _unary(counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Counts written in unary, so that a product of two rows is the number of letters they share."""
    letters = np.repeat(np.arange(counts.shape[1]), levels)
    level = np.concatenate([np.arange(1, k + 1) for k in levels]) if len(letters) else np.zeros(0, int)
    return (counts[:, letters] >= level).astype(np.float32)


def _halves(codes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the first and one for the last letters of each word; equal letters have equal numbers."""

    def fold(part: np.ndarray) -> np.ndarray:
        mixed = np.full(len(part), 14695981039346656037, np.uint64)
        for k in range(part.shape[1]):
            mixed = (mixed ^ part[:, k]) * np.uint64(1099511628211)
        return mixed

    return fold(codes[:, :first]), fold(codes[:, codes.shape[1] - last :])


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices differ by exactly one edit; ``long`` has as many letters or one more."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    before = np.cumprod(short == long[:, :-1], axis=1).sum(axis=1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + behind >= short.shape[1]


class Shard:
    """Stored words of one length with their tree."""

    def __init__(self, codes: np.ndarray, n: np.ndarray) -> None:
        self.letters = Letters(codes)
        counts = self.letters.counts(codes)
        self.points, inverse = np.unique(counts, axis=0, return_inverse=True)
        order = np.argsort(inverse.reshape(-1), kind="stable")
        self.codes, self.n = codes[order], n[order]
        self.begin = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(self.points) + 1))
        self.tree = Tree(self.points, LEAF)
        self.levels = self.points.max(axis=0)
        self.unary = {
            node: _unary(self.points[rows], self.levels).T for node, rows in enumerate(self.tree.rows) if rows is not None
        }

    def _close(self, points: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query points and stored points that are one edit's step apart."""
        up, down = _steps(kind)
        length = points.sum(axis=1)
        for node, asked in self.tree.reached(points, up, down):
            stored = self.tree.rows[node]
            for begin in range(0, len(asked), 4096):
                part = asked[begin : begin + 4096]
                shared = _unary(points[part], self.levels) @ self.unary[node]
                q, d = np.nonzero(shared >= (length[part] - down)[:, None])
                yield part[q], stored[d]

    def near(self, codes: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, stored row) of words that are exactly one edit apart."""
        points, inverse = np.unique(self.letters.counts(codes), axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.argsort(inverse, kind="stable")
        asked_begin = np.searchsorted(inverse[order], np.arange(len(points) + 1))
        first = codes.shape[1] // 2
        last = codes.shape[1] - first
        asked_halves, stored_halves = _halves(codes[order], first, last), _halves(self.codes, first, last)
        for q_point, d_point in self._close(points, kind):
            n_q, n_d = np.diff(asked_begin)[q_point], np.diff(self.begin)[d_point]
            weight = np.cumsum(n_q * n_d)
            begin = 0
            while begin < len(q_point):
                end = max(begin + 1, int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + PAIRS)))
                cut = slice(begin, end)
                yield from self._verify(
                    codes, order, asked_begin[q_point[cut]], n_q[cut], self.begin[d_point[cut]], n_d[cut], asked_halves, stored_halves
                )
                begin = end

    def _verify(self, codes, order, q_begin, n_q, d_begin, n_d, asked_halves, stored_halves):
        size = n_q * n_d
        pair = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        q, d = q_begin[pair] + inside // n_d[pair], d_begin[pair] + inside % n_d[pair]
        # One edit leaves the first or the last half as it is.
        maybe = (asked_halves[0][q] == stored_halves[0][d]) | (asked_halves[1][q] == stored_halves[1][d])
        q, d = order[q[maybe]], d[maybe]
        right = _one_edit(codes[q], self.codes[d])
        if right.any():
            yield q[right], d[right]


def _codes(words: pa.Array) -> np.ndarray:
    """Letter codes of words of one length, a row for each."""
    rows = words.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint8)


def _answers(asked: np.ndarray, asked_codes: np.ndarray, partner: np.ndarray, partner_codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """For each asked row its number of partners and the best of them: largest n, then first in code-point order."""
    text = np.array([row.tobytes() for row in partner_codes], object)
    rank = np.unique(text, return_inverse=True)[1].reshape(-1) if len(text) else np.zeros(0, int)
    order = np.lexsort((rank[partner], -n[partner], asked))
    asked, partner = asked[order], partner[order]
    begin = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1])))
    times = np.diff(np.append(begin, len(asked)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([asked_codes[k].tobytes() for k in asked[begin]], pa.binary()),
            pa.array(times, pa.int64()),
            pa.array(n[partner[begin]], pa.int64()),
            pa.array(text[partner[begin]].tolist(), pa.binary()),
        ],
        ["word", "n_near", "near_n", "near"],
    )


def _subset(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(rows, return_inverse=True)


def _ask(shard: Shard, words: pa.Array, n: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Answers of a shard to queries; a longer stored word learns of its shorter neighbour, too."""
    codes = _codes(words)
    pairs = list(shard.near(codes, kind))
    if not pairs:
        return
    q, d = (np.concatenate(side) for side in zip(*pairs))
    for asked, asked_codes, partner, partner_codes, sizes in (
        (q, codes, d, shard.codes, shard.n),
        (d, shard.codes, q, codes, n),
    )[: 1 if kind == SAME else 2]:
        kept, place = _subset(partner)
        yield _answers(asked, asked_codes, place.reshape(-1), partner_codes[kept], sizes[kept])


def _search(most: int = 1 << 14) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by shard, part and kind: hold a part's stored words, stream the queries past them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        held: list[pa.RecordBatch] = []
        held_key, rows = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal key, shard, held, rows
            if not held:
                return
            words = pa.concat_arrays([b.column("word") for b in held])
            n = np.concatenate([b.column("n").to_numpy() for b in held])
            (at, kind), held, rows = held_key, [], 0
            if kind == STORED:
                key, shard = at, Shard(_codes(words), n)
            elif key == at:
                yield from _ask(shard, words, n, kind)

        for batch in stream:
            names = [batch.column(c).to_numpy() for c in ("shard", "part", "kind")]
            begins = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0)))) if batch.num_rows else []
            for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
                here = ((int(names[0][begin]), int(names[1][begin])), int(names[2][begin]))
                if here != held_key or here[1] != STORED and rows >= most:
                    yield from close()
                    held_key = here
                held.append(batch.slice(begin, end - begin))
                rows += end - begin
        yield from close()

    return run


#: Planned shards of a length: its letters and its tree.
Plan = dict[int, tuple[Letters, Tree]]


def _route(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each word as a row of the shard that stores it and of the shards that it asks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lengths = pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                own = batch.take(pa.array(rows))
                codes = _codes(own.column("word"))
                for kind, into in ((STORED, length), (SAME, length), (SHORTER, length + 1)):
                    if into not in plan:
                        found = [(0, np.arange(len(rows)))]
                    else:
                        letters, tree = plan[into]
                        counts = letters.counts(codes)
                        if kind == STORED:
                            leaf = tree.place(counts)
                            found = [(k, np.flatnonzero(leaf == k)) for k in np.unique(leaf).tolist()]
                        else:
                            found = tree.reached(counts, *_steps(kind))
                    for leaf, chosen in found:
                        part = own.take(pa.array(chosen))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(chosen), into << 32 | leaf, np.int64)),
                                pa.array(np.full(len(chosen), kind, np.int32)),
                                part.column("word"),
                                part.column("n"),
                            ],
                            ["shard", "kind", "word", "n"],
                        )

    return run


def _plan(words: DataFrame, shard_letters: int) -> Plan:
    """Trees of the lengths whose words fill more than one shard, from a bounded sample of the words."""
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.octet_length("word").alias("length")).count().collect()}
    share = min(1.0, SAMPLE / max(sum(sizes.values()), 1))
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").collect()
    by_length: dict[int, list[bytes]] = {}
    for row in sorted(bytes(r["word"]) for r in chosen):
        by_length.setdefault(len(row), []).append(row)
    plan: Plan = {}
    for length, sample in by_length.items():
        wanted = -(-sizes[length] * length // shard_letters)
        if wanted > 1:
            codes = _codes(pa.array(sample, pa.binary()))
            letters = Letters(codes)
            plan[length] = (letters, Tree(letters.counts(codes), max(1, len(sample) // wanted), tight=False))
    return plan


def neighbours(words: DataFrame, shard_letters: int | None = None) -> DataFrame:
    """Per word of ``words`` (word, n) with neighbours: word, n_near, near_n and near.

    Two words are near if one letter added, dropped or replaced turns one into
    the other.  ``near`` is the neighbour with the largest n, the first in
    code-point order among equals.  Words must be distinct and made of letters
    up to U+00FF; an empty table gives none.  Shards with more letters than
    planned are cut into parts, and each part is asked by all the shard's
    queries, so that no pair is lost and no task holds more than a part.
    """
    limit = shard_letters or SHARD_LETTERS
    coded = materialize(words.select(F.encode("word", "ISO-8859-1").alias("word"), "n"))
    plan = _plan(coded, limit)
    routed = materialize(coded.mapInArrow(_route(plan), "shard bigint, kind int, word binary, n bigint"))
    large = materialize(
        routed.where(F.col("kind") == STORED).groupBy("shard").agg(F.sum(F.octet_length("word")).alias("letters"))
        .where(F.col("letters") > 2 * limit).select("shard", F.ceil(F.col("letters") / limit).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    stored = F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))
    asked = F.sequence(F.lit(0), parts - 1)
    placed = routed.join(large, "shard", "left").select(
        "shard", F.explode(F.when(F.col("kind") == STORED, stored).otherwise(asked)).alias("part"), "kind", "word", "n"
    )
    # A stated number of partitions, as bytes do not tell the work of a search.
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        placed.repartition(spread, "shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_search(), _FOUND)
    )
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select(
        _text("word").alias("word"), "n_near", (-F.col("best.order")).alias("near_n"), _text("best.near").alias("near")
    )


def _text(column: str) -> Column:
    return F.decode(F.col(column), "ISO-8859-1")


def roots(forms: DataFrame) -> DataFrame:
    """For (word, form), the last word that is reached from each word over forms: (word, root).

    Every round doubles the steps that a row has gone, and is written; the
    rounds end when no row moves.  Forms must not run in a circle.
    """
    current = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        moved = materialize(
            current.join(further, current["root"] == F.col("_via"), "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")
            )
        )
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        current = moved.select("word", "root")


def variants(words: DataFrame, factor: int = 10, shard_letters: int | None = None) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its neighbour of largest n, if that is ``factor`` times
    its own n or more; its root is the last word on the way over forms, itself
    without a form.  As n grows with every step there are no circles.
    """
    words = materialize(words.select("word", "n"))
    near = neighbours(words, shard_letters).withColumnRenamed("word", "_word")
    has_form = F.col("near_n") >= factor * F.col("n")
    found = materialize(
        words.join(near, F.col("word") == F.col("_word"), "left").select(
            "word",
            F.when(has_form, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("near_n")).alias("form_n"),
        )
    )
    ends = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
