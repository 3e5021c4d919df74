"""SimHash fingerprints and near-duplicate groups found with vantage-point trees.

Fingerprints within ``radius`` bits of each other are linked.  A forest of
vantage-point trees deals them out: a node holds a vantage point and a radius,
a fingerprint goes inside or outside by its distance to the point, and it is
also sent across a boundary wherever the triangle inequality cannot rule out
a partner there.  Every shard is then searched exactly.

On all 64 bits distances pile up around 32 with a deviation of 4, so nearly
every fingerprint lies within 4 of every boundary and a single tree would copy
it 1.7 times per level.  Each tree of the forest therefore measures distance on
a bit band of its own.  Two fingerprints that differ in at most ``radius`` bits
differ in at most ``reach`` bits of one of the bands (pigeonhole), and ``reach``
is the margin that the triangle bounds of that tree use.  With five bands the
reach is 0, boundaries are crossed by nobody and each fingerprint has five
copies; with fewer bands the same code crosses boundaries.

Nulls: a null text has no words and fingerprint zero, as every text without
words.  A null ``doc_id`` names no group, unless all its members lack one.
Repeated rows share a fingerprint and so a group.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.llm.common import whole_groups
from lexgauge.llm.components import connected_components
from lexgauge.session import materialize

#: Seed of the shingle hash.
SEED = 42
#: Fingerprints the trees are planned on; all fingerprints pass through them.
SAMPLE = 1 << 15
#: A leaf is not divided below this many sampled fingerprints.
LEAF = 4
#: Shards with more rows are searched in pairs of parts.
SHARD_ROWS = 1 << 15


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Majority bits of the hashes of all word shingles; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, mark, fp): a hash of the text, and the 64 bits as a signed long, over whole texts with A-Z lower-cased."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            prints = np.fromiter(
                (
                    # bytes.lower() and bytes.split() know ASCII only, as asked for.
                    fingerprint((text.as_py() or "").encode().lower().split(), shingle)
                    for text in batch.column("text")
                ),
                np.uint64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array(prints.view(np.int64))],
                ["doc_id", "mark", "fp"],
            )

    return docs.select("doc_id", "text", _mark(docs).alias("mark")).mapInArrow(run, "doc_id bigint, mark bigint, fp bigint")


def _mark(docs: DataFrame) -> Column:
    """Tells unlike texts under one doc_id, or without one, apart."""
    return F.xxhash64(docs["text"].isNull(), docs["text"])


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree on the bits of ``mask``; it only routes fingerprints to leaves."""

    def __init__(self, mask: int, reach: int, sample: np.ndarray, seed: int) -> None:
        self.mask, self.reach = np.uint64(mask), reach
        points, limits, children = [], [], []
        chance = np.random.default_rng(seed)
        masked = sample & self.mask
        waiting = [(masked, None)]
        while waiting:
            members, parent = waiting.pop()
            node = len(points)
            if parent is not None:
                children[parent[0]][parent[1]] = node
            points.append(0)
            limits.append(-1)
            children.append([-1, -1])
            if len(members) < 2 * LEAF:
                continue
            point = members[chance.integers(len(members))]
            away = distance(members, point)
            limit = int(np.median(away))
            if (away <= limit).all():
                limit = int(away.max()) - 1
            if limit < 0:
                continue
            points[node], limits[node] = int(point), limit
            waiting.append((members[away <= limit], (node, 0)))
            waiting.append((members[away > limit], (node, 1)))
        self.points = np.array(points, np.uint64)
        self.limits = np.array(limits, np.int64)
        self.children = np.array(children, np.int64)

    def leaves(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves: the home leaf of each row and those its ball of ``reach`` touches."""
        masked = prints & self.mask
        rows, nodes = np.arange(len(prints)), np.zeros(len(prints), np.int64)
        out_rows, out_nodes = [], []
        while len(rows):
            limit = self.limits[nodes]
            ended = limit < 0
            out_rows.append(rows[ended])
            out_nodes.append(nodes[ended])
            rows, nodes, limit = rows[~ended], nodes[~ended], limit[~ended]
            away = distance(masked[rows], self.points[nodes]).astype(np.int64)
            # A partner is at most ``reach`` nearer to the vantage point, or farther from it.
            inside, outside = away - self.reach <= limit, away + self.reach > limit
            rows, nodes = (
                np.concatenate([rows[inside], rows[outside]]),
                np.concatenate([self.children[nodes[inside], 0], self.children[nodes[outside], 1]]),
            )
        return np.concatenate(out_rows), np.concatenate(out_nodes)


def bands(count: int, radius: int, joined: int = 1) -> list[tuple[int, int]]:
    """Masks with their reach: all sets of ``joined`` bands out of ``count``.

    Of ``count`` bands that share at most ``radius`` differing bits, the
    ``joined`` best together have at most as many as when the differences are
    spread evenly.
    """
    edges = [round(64 * i / count) for i in range(count + 1)]
    single = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    whole, more = divmod(radius, count)
    reach = joined * whole + max(0, joined - (count - more))
    return [(sum(chosen), reach) for chosen in combinations(single, joined)]


def _roots(prints: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a few shards, the smallest one it is linked to, over any number of links.

    Rows of a shard are sorted by their distance to its first fingerprint;
    only those whose distances differ by at most ``radius`` can be partners
    (triangle inequality), and those are compared bit by bit.
    """
    first = np.concatenate(([True], shard[1:] != shard[:-1]))
    vantage = prints[np.flatnonzero(first)][np.cumsum(first) - 1]
    away = distance(prints, vantage).astype(np.int64)
    number = np.cumsum(first).astype(np.int64) * 256
    order = np.argsort(number + away, kind="stable")
    ring, sorted_prints = (number + away)[order], prints[order]
    end = np.searchsorted(ring, ring + radius, "right")
    # Equal rings of other shards are out of reach: the shard number is part of the ring.
    names = np.unique(prints)
    parent = np.arange(len(names))
    at = np.searchsorted(names, sorted_prints)
    left = np.arange(len(sorted_prints))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, step = 0, 0
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        near = left[distance(sorted_prints[left], sorted_prints[left + step]) <= radius]
        if len(near):
            a, b = parent[at[near]], parent[at[near + step]]
            apart = a != b
            found.append((a[apart], b[apart]))
            held += int(apart.sum())
        # Join often enough that links inside a known group are not kept.
        if held > 100_000 or (found and not len(left)):
            _join(parent, found)
            found, held = [], 0
    if found:
        _join(parent, found)
    return names[parent[np.searchsorted(names, prints)]]


def _join(parent: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Merge groups along links; each group is named by its smallest member."""
    a, b = (np.concatenate(side) for side in zip(*found))
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _route(trees: list[Tree]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            prints = batch.column("fp").to_numpy().view(np.uint64)
            for number, tree in enumerate(trees):
                rows, leaf = tree.leaves(prints)
                shard = np.int64(number) << 40 | leaf
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(prints[rows].view(np.int64))], ["shard", "fp"])

    return run


def _search(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, ["shard", "part"], 1 << 17):
            prints = table.column("fp").to_numpy().view(np.uint64)
            shard = table.column("shard").to_numpy()
            part = table.column("part").to_numpy()
            new = np.concatenate(([True], (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])))
            root = _roots(prints, np.cumsum(new), radius)
            linked = root != prints
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[linked].view(np.int64)), pa.array(root[linked].view(np.int64))], ["u", "v"]
            )

    return run


def links(prints: DataFrame, radius: int = 4, count: int = 5, joined: int = 1) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that join exactly the pairs within ``radius``.

    A shard yields a star per group of linked fingerprints, never all its
    pairs.  The trees are planned on about ``SAMPLE`` fingerprints, those whose
    hash is small; that bounds what the driver sees and the tasks receive.
    ``count`` and ``joined`` choose the bands: (5, 1) makes 5 copies of each
    fingerprint, (6, 2) 15 copies and (7, 3) 35 copies with shards that stay
    small for 10^8 and 10^10 fingerprints.
    """
    share = min(1.0, SAMPLE / max(prints.count(), 1))
    chosen = prints.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    sample = np.array(sorted(r["fp"] for r in chosen), np.int64).view(np.uint64)
    if not len(sample):
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    trees = [Tree(mask, reach, sample, seed) for seed, (mask, reach) in enumerate(bands(count, radius, joined))]
    routed = materialize(prints.select("fp").mapInArrow(_route(trees), "shard bigint, fp bigint"))
    # Shards over the limit are cut into parts, and every pair of parts is searched.
    large = materialize(
        routed.groupBy("shard").count().where(F.col("count") > SHARD_ROWS)
        .select("shard", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("parts"))
    )
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    placed = (
        routed.join(large, "shard", "left")
        .select("shard", "fp", "parts", own.alias("own"), other.alias("other"))
        .select(
            "shard",
            (F.least("own", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("own", "other")).alias("part"),
            "fp",
        )
    )
    return (
        placed.repartition("shard", "part")
        .sortWithinPartitions("shard", "part")
        .mapInArrow(_search(radius), "u bigint, v bigint")
    )


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, count: int = 5, joined: int = 1) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that is reachable over links.
    Equal fingerprints are one node, so copies cost nothing beyond the first.
    """
    prints = materialize(fingerprints(docs, shingle))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Node order follows the unsigned fingerprint inside a shard and the signed one here; any order names a root.
    roots = materialize(connected_components(links(nodes, radius, count, joined)))
    named = (
        roots.select(F.col("root").alias("fp"), "root").distinct().union(roots.select(F.col("node").alias("fp"), "root"))
    )
    best = nodes.join(named, "fp").groupBy("root").agg(F.min("least").alias("group"))
    grouped = materialize(named.join(best, "root").select("fp", "group"))
    classes = materialize(
        nodes.join(grouped, "fp", "left").select("fp", F.coalesce("group", "least").alias("component_id"))
    )
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates, with its columns as they are.

    The smallest doc_id stays, of several texts under it the one whose hash is
    smallest; rows without doc_id come last.  Unlike texts under one doc_id are
    rows of their own, and of rows equal in doc_id and text one stays.

    The rows to drop are far fewer than those to keep, so texts meet the list
    of dropped ids only; texts of ids that are repeated, or missing, are looked
    at once more, by their hash.
    """
    prints = materialize(fingerprints(docs, shingle))
    nodes = materialize(prints.select("fp").distinct())
    tied = materialize(connected_components(links(nodes, radius)))
    rooted = materialize(
        nodes.join(tied, nodes["fp"] == tied["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    )
    rows = materialize(prints.join(rooted, "fp").select("doc_id", "mark", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    first = materialize(rows.groupBy("root").agg(F.min(order).alias("first")))
    judged = materialize(rows.join(first, "root").select("doc_id", "mark", order.eqNullSafe(F.col("first")).alias("stays")))
    counted = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("stays").alias("stay"))
    # Ids of which no row stays, and repeated ones of which some do.
    listed = materialize(counted.where("stay = 0 OR n > 1").select("doc_id", (F.col("stay") > 0).alias("some")))
    kept = docs.where("doc_id IS NOT NULL").join(listed.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(
        judged.where("stays").join(listed.where("some").select("doc_id").withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
        .where("doc_id IS NULL OR _id IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    )
    if not repeated.limit(1).count():
        return kept
    chosen = repeated.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    marked = docs.select(docs["doc_id"].alias("id"), _mark(docs).alias("mark"), F.struct(*docs.columns).alias("row"))
    again = marked.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi")
    return kept.union(again.groupBy("id", "mark").agg(F.any_value("row").alias("row")).select("row.*"))
