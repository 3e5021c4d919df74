"""Benchmark decontamination by edit distance on words.

A document is contaminated by a benchmark item when some stretch of its words
is within ``rate`` times the item's length in edits (insert, delete, replace a
word; lower case, punctuation ignored) of the item.

Search: the CGK embedding walks over a word sequence and, at each step,
writes the word under the cursor and moves on or stays by a random bit of step
and word.  Equal steps of two walks mean equal words, and sequences few edits
apart fall back into step, so edit distance becomes Hamming distance.  A walk
starts at every word of every document; bit-sampling LSH compares a few random
steps of it with the same steps of the items of each length, again and again
over several walks.  Every hit is verified with the exact edit distance.

Walks drift apart with the number of edits, so items are searched in pieces of
bounded length: when a stretch is within ``k`` edits of an item, some piece of
``m`` of its ``n`` words is within ``k * m / n`` edits of a part of the stretch.
The longer the item, the more pieces can find it; the effort for a word of a
document depends on the lengths of pieces only.

Before a walk starts, a lossless count decides whether it can lead anywhere:
a window within ``k`` edits of ``m`` words holds at least ``m - k`` words of
the benchmark's vocabulary.  The count removes no match.

Items under ``min_words`` words are left out, as they occur everywhere; null
texts have no words and are never contaminated; repeated items and repeated
rows are each reported; empty tables on either side give no pairs.  Documents
are never cut: windows run over whole texts.  Other columns are not read by
``contaminated``, and pass through ``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: Words of a piece of work inside a batch; a longer document comes alone.  Two pieces are held at a time, as lists of words.
PIECE = 1 << 17
#: Words of benchmark text that travel to the tasks at once; more make more passes.
PASS_WORDS = 1 << 21
#: Windows that walk together.
CHUNK = 1 << 15
TABLE_BITS = 14
#: Fewest words of a piece of an item that has more; a piece has less than twice as many.
PIECE_WORDS = 14


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edits(pattern: list[int], text: list[int]) -> int:
    """Fewest edits between the pattern and any stretch of the text."""
    return _closest(pattern, text)[0]


def _closest(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Fewest edits and the end of the first stretch that needs no more, with bit vectors as long as the pattern."""
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    size = len(pattern)
    full, last = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = score, 0
    for place, word in enumerate(text):
        equal = masks.get(word, 0)
        across = equal | minus
        equal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(equal | plus) & full
        down = plus & equal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(across | up) & full
        minus = up & across
        if score < best:
            best, end = score, place + 1
    return best, end


def _first_word(pattern: list[int], text: list[int], end: int) -> int:
    """The first word of the shortest stretch that ends at ``end``, the end that ``_closest`` gave.

    No stretch that ends before it is as close, so the reversed search finds this one.
    """
    return end - _closest(pattern[::-1], text[:end][::-1])[1]


def _cuts(words: int) -> list[int]:
    """Where the pieces of an item of so many words begin and end."""
    pieces = max(1, words // PIECE_WORDS)
    return [words * i // pieces for i in range(pieces + 1)]


def _odd(chance: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    return chance.integers(0, 1 << 31, shape, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


@dataclass
class Lengths:
    """Pieces of like length, how long their walks are, and what is sampled of them."""

    shortest: int
    steps: int
    places: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    #: The most edits of a window of each length.
    slack: dict[int, int] = field(default_factory=dict)
    chosen: np.ndarray | None = None
    #: Sorted keys of each sample of each walk, and the pieces they belong to.
    keys: np.ndarray | None = None
    order: np.ndarray | None = None
    table: np.ndarray | None = None


@dataclass
class Search:
    """The items of one pass, their embeddings and the random choices that all tasks share."""

    items: list[tuple[int, list[str]]]
    rate: float = 0.2
    walks: int = 10
    samples: int = 8
    positions: int = 4
    seed: int = 13
    vocabulary: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        chance = np.random.default_rng(self.seed)
        for _, words in self.items:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.coded = [np.array([self.vocabulary[w] for w in words], np.uint32) for _, words in self.items]
        self.slack = max((int(self.rate * len(c)) for c in self.coded), default=0)
        self.classes = self._classes()
        every = sorted(piece for c in self.classes for piece in zip(c.places, c.offsets))
        #: Every piece (item place, offset) and its number in that order.
        self.numbers = {piece: number for number, piece in enumerate(every)}
        steps = max((c.steps for c in self.classes), default=0)
        self.factors = _odd(chance, (self.walks, steps))
        self.shifts = chance.integers(0, 1 << 32, (self.walks, steps), np.uint64).astype(np.uint32)
        self.mix = _odd(chance, (self.positions,))
        for c in self.classes:
            c.chosen = chance.integers(0, c.steps, (self.walks, self.samples, self.positions))
            # The pieces one after the other, each with what its walks may read past its end.
            gap = np.zeros(c.steps + 1, np.uint32)
            parts = [self.coded[place][offset : offset + size] for place, offset, size in zip(c.places, c.offsets, c.sizes)]
            starts = np.cumsum([0] + [len(part) + len(gap) for part in parts])[:-1]
            joined = np.concatenate([x for part in parts for x in (part, gap)])
            keys = np.stack([self._keys(self._walk(joined, starts, walk, c.steps), c, walk) for walk in range(self.walks)])
            c.order = np.argsort(keys, axis=2, kind="stable")
            c.keys = np.take_along_axis(keys, c.order, axis=2)
            c.table = np.zeros((self.walks, self.samples, 1 << TABLE_BITS), bool)
            for walk in range(self.walks):
                for sample in range(self.samples):
                    c.table[walk, sample, c.keys[walk, sample] >> np.uint64(64 - TABLE_BITS)] = True

    def _classes(self) -> list[Lengths]:
        """Pieces of like length: windows of a class share their walks, which stay inside its shortest piece."""
        pieces = []
        for place, coded in enumerate(self.coded):
            cuts = _cuts(len(coded))
            pieces += [(end - begin, place, begin) for begin, end in zip(cuts, cuts[1:])]
        classes: list[Lengths] = []
        for size, place, begin in sorted(pieces):
            if not classes or size > classes[-1].shortest * 1.35:
                classes.append(Lengths(size, int(1.6 * size)))
            c = classes[-1]
            c.places.append(place)
            c.offsets.append(begin)
            c.sizes.append(size)
            n = len(self.coded[place])
            # Rounded up, so that pieces with an edit more than their share are found, too.
            c.slack[size] = max(c.slack.get(size, 0), -(-int(self.rate * n) * size // n))
        return classes

    def _walk(self, tokens: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """The word at each step of the walks from ``starts``."""
        padded = np.concatenate([tokens, np.zeros(steps + 1, tokens.dtype)])
        words = np.empty((steps, len(starts)), np.uint32)
        at = starts.astype(np.intp)
        moves = np.empty(len(starts), np.uint32)
        # In place: a walk is many steps over arrays that stay in the cache.
        for j in range(steps):
            np.take(padded, at, out=words[j], mode="clip")
            np.bitwise_xor(words[j], self.shifts[walk, j], out=moves)
            np.multiply(moves, self.factors[walk, j], out=moves)
            np.right_shift(moves, np.uint32(31), out=moves)
            np.add(at, moves, out=at, casting="unsafe")
        return words

    def _keys(self, words: np.ndarray, c: Lengths, walk: int) -> np.ndarray:
        """Keys (samples, walks): the sampled steps, mixed into one number."""
        out = np.empty((self.samples, words.shape[1]), np.uint64)
        high = np.empty(words.shape[1], np.uint64)
        for sample in range(self.samples):
            key = out[sample]
            for place, (step, factor) in enumerate(zip(c.chosen[walk, sample], self.mix)):
                if place:
                    np.bitwise_xor(key, words[step], out=key)
                else:
                    key[:] = words[step]
                np.multiply(key, factor | np.uint64(1) << np.uint64(40), out=key)
                np.right_shift(key, np.uint64(29), out=high)
                np.bitwise_xor(key, high, out=key)
            np.multiply(key, np.uint64(0x9E3779B97F4A7C15), out=key)
        return out

    def candidates(self, tokens: np.ndarray) -> np.ndarray:
        """Triples (start, item place, offset of the piece) that some sample of some walk brings together."""
        known = np.concatenate(([0], np.cumsum(tokens > 0)))
        found = []
        for c in self.classes:
            able = np.zeros(len(tokens), bool)
            for m, slack in c.slack.items():
                # Past the end of the words nothing more is known.
                end = np.minimum(np.arange(m, m + len(tokens)), len(tokens))
                able |= known[end] - known[:-1] >= m - slack
            starts = np.flatnonzero(able)
            numbers = np.array([self.numbers[piece] for piece in zip(c.places, c.offsets)], np.int64)
            for begin in range(0, len(starts), CHUNK):
                part = starts[begin : begin + CHUNK]
                for walk in range(self.walks):
                    keys = self._keys(self._walk(tokens, part, walk, c.steps), c, walk)
                    slots = keys >> np.uint64(64 - TABLE_BITS)
                    for sample in range(self.samples):
                        maybe = np.flatnonzero(c.table[walk, sample][slots[sample]])
                        if not len(maybe):
                            continue
                        low = np.searchsorted(c.keys[walk, sample], keys[sample, maybe], "left")
                        times = np.searchsorted(c.keys[walk, sample], keys[sample, maybe], "right") - low
                        row = np.repeat(np.arange(len(maybe)), times)
                        piece = c.order[walk, sample][np.arange(len(row)) - np.repeat(np.cumsum(times) - times - low, times)]
                        found.append(part[maybe[row]] * len(self.numbers) + numbers[piece])
        if not found:
            return np.zeros((0, 3), np.int64)
        # One number each sorts faster than three.
        starts, numbers = np.divmod(np.unique(np.concatenate(found)), len(self.numbers))
        return np.column_stack([starts, np.array(list(self.numbers), np.int64)[numbers]])

    def matches(self, texts: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(text number, item_id, fewest edits, first word of the closest stretch) for each contaminated text and item."""
        lookup = self.vocabulary.get
        gap = np.zeros(self.slack + 1, np.uint32)
        coded = [np.array([lookup(w, 0) for w in words], np.uint32) for words in texts]
        tokens = np.concatenate([part for one in coded for part in (one, gap)]) if coded else gap
        edges = np.cumsum([0] + [len(one) + len(gap) for one in coded])
        hits = self.candidates(tokens)
        if not len(hits):
            return []
        sizes = np.array([len(item) for item in self.coded])
        slack = np.array([int(self.rate * size) for size in sizes])
        owner = np.searchsorted(edges, hits[:, 0], "right") - 1
        place = hits[:, 1]
        # The stretch begins within k words of the piece's start less its offset; a walk may also start a little beside the piece.
        begin = hits[:, 0] - hits[:, 2]
        low = np.maximum(edges[owner], begin - 2 * slack[place])
        high = np.minimum(edges[owner + 1] - len(gap), begin + sizes[place] + 2 * slack[place])
        order = np.lexsort((low, owner, place))
        place, owner, low, high = place[order], owner[order].tolist(), low[order].tolist(), high[order].tolist()
        begins = edges.tolist()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        at = 0
        for number in np.unique(place).tolist():
            item = self.coded[number]
            n, k, pattern = len(item), int(slack[number]), item.tolist()
            inside = np.zeros(len(self.vocabulary) + 1, bool)
            inside[item] = True
            last = int(np.searchsorted(place, number, "right"))
            while at < last:
                # Stretches that overlap are one.
                text, first, end = owner[at], low[at], high[at]
                at += 1
                while at < last and owner[at] == text and low[at] <= end:
                    end = max(end, high[at])
                    at += 1
                if end - first < n - k:
                    continue
                part = tokens[first:end]
                known = inside[part]
                # Most stretches hold too few words of the item even as a whole.
                if np.count_nonzero(known) < n - k:
                    continue
                held = np.concatenate(([0], np.cumsum(known)))
                if (held[n:] - held[:-n]).max(initial=held[-1] if len(part) < n else 0) < n - k:
                    continue
                words = part.tolist()
                away, stop = _closest(pattern, words)
                if away > k or away >= best.get((text, number), (n, 0))[0]:
                    continue
                best[text, number] = away, first - begins[text] + _first_word(pattern, words, stop)
        return [(text, self.items[number][0], away, start) for (text, number), (away, start) in sorted(best.items())]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """Runs of split texts with a bounded number of words, each with the number of its first text.

    Texts are taken out of the batch one by one, so that no second copy of it is held.
    """
    held, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        words = words_of(text.as_py())
        if held and size + len(words) > PIECE:
            yield begin, held
            held, begin, size = [], i, 0
        held.append(words)
        size += len(words)
    if held:
        yield begin, held


def searches(benchmark: DataFrame, min_words: int = 8, rate: float = 0.2, **choices) -> list[Search]:
    """The benchmark as searches of bounded size, one per pass over the documents."""
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = 1 + size // (4 * PASS_WORDS)
    out = []
    for number in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        rows = part.select("item_id", "text").orderBy("item_id", "text").collect()
        items = [(r["item_id"], words_of(r["text"])) for r in rows]
        items = [(item, words) for item, words in items if len(words) >= min_words]
        if items:
            out.append(Search(items, rate, **choices))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **choices) -> DataFrame:
    """(doc_id, item_id, edits, start): one row per document row and item found in it."""
    out = None
    for search in searches(benchmark, **choices):

        def run(stream: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                names = batch.column("doc_id")
                for begin, texts in _pieces(batch.column("text")):
                    found = search.matches(texts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            names.take(pa.array([begin + f[0] for f in found], pa.int64())),
                            *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)),
                        ],
                        ["doc_id", "item_id", "edits", "start"],
                    )

        pairs = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, edits bigint, start bigint")
        out = pairs if out is None else out.union(pairs)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, edits bigint, start bigint")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, **choices) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    for search in searches(benchmark, **choices):

        def run(stream: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                clean = np.ones(batch.num_rows, bool)
                for begin, texts in _pieces(batch.column("text")):
                    clean[[begin + f[0] for f in search.matches(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
