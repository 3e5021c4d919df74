"""Line dedup over the whole corpus, kept up to date by insertions and deletions.

Two structures hold the state.  A reference-count table has, for each line
key, the number of documents that hold it; it is exact and answers every
decision.  A cuckoo filter per shard of keys holds the frequent ones; it is
small, answers in memory, and has deletions, which a Bloom filter lacks.  The
filters say which lines may be frequent; only those lines are then looked up
in the table.  Deleting documents lowers their keys' counts and takes keys
that are no longer frequent out of the filters, so an insertion followed by
the deletion of the same documents gives back the state before it.

A key is the line without white space at its ends and with A-Z in lower case;
its 128-bit md5 stands for it.  Keys shorter than ``min_chars`` code points
never count.  A null or empty text is one empty line.  Every row is a document
of its own, also when rows repeat; rows that share a doc_id (or lack one) lose
the same keys, which is right as a frequent key goes everywhere.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.llm.common import SPACES, ascii_lower, whole_groups
from lexgauge.session import materialize

#: Filters up to this size, all shards together, travel to the tasks; above it every line is looked up.
FILTER_BYTES = 32 << 20
SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Cuckoo filter of 64-bit hashes: 16-bit fingerprints, four slots a bucket, two buckets a hash.

    When an insertion finds no room the table doubles and all entries move,
    which needs the upper hash bits; they are part of the stored entry's
    bucket number, so a new table is built from the keys by the caller.
    """

    def __init__(self, buckets: int) -> None:
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter that holds all ``hashes``, with as many buckets as they need."""
        buckets = 1
        while buckets * SLOTS * 0.85 < len(hashes):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(int(h)) for h in hashes):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.slots = np.frombuffer(data, "<u2").reshape(-1, SLOTS).astype(np.uint16)
        return made

    def dump(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = hashes & mask
        return mark, first, self._other(first, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        mixed = mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)
        return place ^ (mixed & np.uint64(len(self.slots) - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(hashes)
        return ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(axis=1)

    def insert(self, value: int) -> bool:
        mark, first, second = (x[0] for x in self._places(np.array([value], np.uint64)))
        for place in (first, second):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = second
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.slots[place, slot] = self.slots[place, slot], mark
            place = self._other(np.array([place]), np.array([mark]))[0]
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def delete(self, value: int) -> bool:
        """Take one entry of the hash out; False when there is none."""
        mark, first, second = (x[0] for x in self._places(np.array([value], np.uint64)))
        for place in (first, second):
            held = np.flatnonzero(self.slots[place] == mark)
            if len(held):
                self.slots[place, held[0]] = 0
                return True
        return False


@dataclass(frozen=True)
class LineIndex:
    """State: ``counts`` (shard, key, n_docs) and ``filters`` (shard, n_keys, data)."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column, min_chars: int) -> Column:
    clean = ascii_lower(F.btrim(line, F.lit(SPACES)))
    return F.when(F.length(clean) >= min_chars, F.unhex(F.md5(clean)))


def _hash(key: Column) -> Column:
    """The last 64 bits of a key; its first byte chooses the shard, so the two are independent."""
    return F.conv(F.hex(F.substring(key, 9, 8)), 16, -10).cast("bigint")


def _shard(key: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint") % shards).cast("int")


def _counts(docs: DataFrame, min_chars: int, shards: int) -> DataFrame:
    """Documents per key; a document counts a key once.

    The sum starts inside the tasks, so a line that every document holds
    reaches the shuffle once per task.
    """
    keys = F.array_distinct(F.transform(_lines(docs["text"]), lambda line: _key(line, min_chars)))
    exploded = docs.select(F.explode(keys).alias("key")).where("key IS NOT NULL")
    counted = exploded.groupBy("key").agg(F.count("*").alias("n_docs"))
    return counted.select(_shard(F.col("key"), shards).alias("shard"), "key", "n_docs")


def _built(counts: DataFrame, min_docs: int) -> DataFrame:
    """A fresh filter for every shard, from its frequent keys."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, ["shard"]):
            shards, hashes = table.column("shard").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
            for shard in np.unique(shards):
                own = hashes[shards == shard]
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([shard], pa.int32()), "n_keys": [len(own)], "data": [CuckooFilter.of(own).dump()]}
                )

    frequent = counts.where(F.col("n_docs") >= min_docs).select("shard", _hash(F.col("key")).alias("hash"))
    return (
        frequent.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, n_keys bigint, data binary")
    )


def build(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int = 64) -> LineIndex:
    """Index all rows of ``docs``; raise ``shards`` with the corpus so that one filter fits a task."""
    counts = materialize(_counts(docs, min_chars, shards))
    return LineIndex(counts, materialize(_built(counts, min_docs)), min_docs, min_chars, shards)


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    """The index after ``docs`` come (sign 1) or go (sign -1)."""
    change = _counts(docs, index.min_chars, index.shards).select("shard", "key", (F.col("n_docs") * sign).alias("change"))
    merged = materialize(
        index.counts.join(change, ["shard", "key"], "full").select(
            "shard",
            "key",
            F.coalesce("n_docs", F.lit(0)).alias("before"),
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n_docs"),
        )
    )
    counts = merged.where("n_docs > 0").select("shard", "key", "n_docs")
    enters = (F.col("n_docs") >= index.min_docs) & (F.col("before") < index.min_docs)
    leaves = (F.col("n_docs") < index.min_docs) & (F.col("before") >= index.min_docs)
    moves = merged.where(enters | leaves).select(
        "shard", _hash(F.col("key")).alias("hash"), F.when(enters, 1).otherwise(-1).alias("move"), F.lit(None).cast("binary").alias("data")
    )
    held = index.filters.select("shard", F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("move"), "data")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, ["shard"]):
            shards = table.column("shard").to_numpy()
            for shard in np.unique(shards):
                own = table.filter(pa.array(shards == shard)).to_pydict()
                data = next((d for d in own["data"] if d is not None), CuckooFilter(1).dump())
                cuckoo, room = CuckooFilter.load(data), True
                for value, move in zip(own["hash"], own["move"]):
                    value &= (1 << 64) - 1
                    if move == 1 and room:
                        room = cuckoo.insert(value)
                    elif move == -1 and room:
                        cuckoo.delete(value)
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([shard], pa.int32()), "full": [not room], "data": [cuckoo.dump()]}
                )

    updated = materialize(
        moves.union(held)
        .repartition("shard")
        .sortWithinPartitions("shard", "move")
        .mapInArrow(run, "shard int, full boolean, data binary")
    )
    # A shard whose filter ran full is built anew from its exact counts, with more buckets.
    full = updated.where("full").select("shard")
    rebuilt = _built(counts.join(full, "shard", "left_semi"), index.min_docs)
    sizes = counts.where(F.col("n_docs") >= index.min_docs).groupBy("shard").agg(F.count("*").alias("n_keys"))
    kept = updated.where("NOT full").join(sizes, "shard", "left").select("shard", F.coalesce("n_keys", F.lit(0)).alias("n_keys"), "data")
    return LineIndex(counts, materialize(kept.union(rebuilt)), index.min_docs, index.min_chars, index.shards)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the rows of ``docs`` added."""
    return _changed(index, docs, 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without the rows of ``docs``, which must be rows that it holds."""
    return _changed(index, docs, -1)


def _candidates(index: LineIndex, lines: DataFrame) -> DataFrame:
    """Lines whose key may be frequent, by the filters if they are small enough to travel."""
    size = index.filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        return lines
    loaded = {r["shard"]: r["data"] for r in index.filters.select("shard", "data").collect()}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {shard: CuckooFilter.load(bytes(data)) for shard, data in loaded.items()}
        for batch in stream:
            shards = batch.column("shard").to_numpy()
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(shards, kind="stable")
            edges = np.flatnonzero(np.diff(shards[order])) + 1
            passes = np.zeros(len(shards), bool)
            for rows in np.split(order, edges):
                if len(rows) and (cuckoo := filters.get(int(shards[rows[0]]))) is not None:
                    passes[rows] = cuckoo.contains(hashes[rows])
            yield batch.filter(pa.array(passes))

    return lines.mapInArrow(run, lines.schema)


def frequent_lines(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, keys): the frequent keys that each doc_id holds; documents without any have no row."""
    keys = F.array_distinct(F.transform(_lines(docs["text"]), lambda line: _key(line, index.min_chars)))
    lines = docs.select(docs["doc_id"], F.explode(keys).alias("key")).where("key IS NOT NULL")
    lines = lines.select("doc_id", "key", _shard(F.col("key"), index.shards).alias("shard"), _hash(F.col("key")).alias("hash"))
    exact = index.counts.where(F.col("n_docs") >= index.min_docs).select("key")
    found = _candidates(index, lines).select("doc_id", "key").join(exact, "key", "left_semi")
    # A document has as many entries as it has different frequent lines.
    return found.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_frequent(index: LineIndex, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    drops = frequent_lines(index, docs).withColumnRenamed("doc_id", "drop_id")
    joined = docs.select("doc_id", "text").join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    cut = joined.select("doc_id", _lines(F.col("text")).alias("lines"), "keys")
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: ~F.coalesce(F.array_contains("keys", _key(line, index.min_chars)), F.lit(False)))
    )
    return cut.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept")).select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
