"""Hard negatives: for an anchor and each of its positives, the best rows of other labels in a score window.

The windows of an anchor's positives overlap: each reaches down from a share of
its positive's score.  Their upper limits cut the scores into disjoint slots, so
a row belongs to one slot of an anchor, however many windows hold it.  Tasks keep
the best rows of every slot; a window's answer is the merge of its own slot and
all lower ones, from the top, cut at the window's lower limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.session import materialize

#: Anchors of one pass over the rows; that bounds what the driver sends to the tasks.
BLOCK = 4096
#: Scores that a task holds at once.
SCORES = 1 << 22
_LONG = np.iinfo(np.int64)
_POSITIVE = "anchor int, score bigint, vec_id bigint"
_NEGATIVE = "anchor int, slot int, score bigint, vec_id bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) with a label and a vector of finite components."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(vectors["vec_id"], vectors["label"].cast("bigint").alias("label"), vectors["embedding"])
    return rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """floor(256 x) of each component, a row for each vector; missing components count as 0."""
    lists = batch.column("embedding")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = column < width
    out = np.zeros((len(sizes), width))
    out[row[inside], column[inside]] = flat[inside]
    return out


class Anchors:
    """A block of anchors: their ids, labels and vectors."""

    def __init__(self, rows: list) -> None:
        self.vec_id = np.array([r["vec_id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        width = max((len(r["embedding"]) for r in rows), default=0)
        self.vectors = np.zeros((len(rows), width))
        for k, row in enumerate(rows):
            self.vectors[k, : len(row["embedding"])] = np.floor(256.0 * np.array(row["embedding"], np.float64))
        self.norm = np.abs(self.vectors).max(initial=0.0)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Exact integer inner products (rows x anchors); those beyond 64 bits count as the largest or least number."""
        bound = self.norm * np.abs(vectors).max(initial=0.0) * max(vectors.shape[1], 1)
        if bound < 2.0**53:
            return (vectors @ self.vectors.T).astype(np.int64)
        exact = np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape)
        anchors = np.array([[int(x) for x in row] for row in self.vectors], object).reshape(self.vectors.shape)
        return np.clip(exact @ anchors.T, _LONG.min, _LONG.max).astype(np.int64)


def _tiles(stream: Iterator[pa.RecordBatch], anchors: Anchors):
    """Ids, whether they are given, labels and scores of some rows at a time."""
    step = max(1, SCORES // max(len(anchors.vec_id), 1))
    for whole in stream:
        for begin in range(0, whole.num_rows, step):
            batch = whole.slice(begin, step)
            ids = batch.column("vec_id")
            given = np.array(ids.is_valid())
            vec_id = np.where(given, ids.fill_null(0).to_numpy(), _LONG.max)
            yield vec_id, given, batch.column("label").to_numpy(), anchors.scores(_vectors(batch, anchors.vectors.shape[1]))


class Best:
    """The best ``most`` rows of every group: highest score, then smallest vec_id; rows without one come last."""

    def __init__(self, groups: int, most: int) -> None:
        self.most = most
        self.limit = np.full(groups, _LONG.min, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)]
        self.given = np.zeros(0, bool)

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, given: np.ndarray) -> None:
        rows = [np.concatenate(pair) for pair in zip(self.rows, (group, score, vec_id))]
        given = np.concatenate((self.given, given))
        order = np.lexsort((rows[2], ~given, -rows[1].astype(float), rows[0]))
        # Doubles put near scores together; a second look orders them exactly.
        if np.abs(rows[1]).max(initial=0) >= 2**53:
            order = np.array(sorted(range(len(given)), key=lambda k: (rows[0][k], -int(rows[1][k]), not given[k], rows[2][k])), int)
        group = rows[0][order]
        begin = np.searchsorted(group, group, "left")
        place = np.arange(len(group)) - begin
        kept = order[place < self.most]
        full = order[place == self.most - 1]
        self.rows, self.given = [x[kept] for x in rows], given[kept]
        self.limit[rows[0][full]] = rows[1][full]

    def ids(self) -> pa.Array:
        return pa.array(self.rows[2], mask=~self.given)


def _positives(anchors: Anchors, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.vec_id), most)
        for vec_id, given, label, scores in _tiles(stream, anchors):
            fits = (label[:, None] == anchors.label) & ~(given[:, None] & (vec_id[:, None] == anchors.vec_id))
            row, anchor = np.nonzero(fits & (scores >= best.limit))
            if len(row):
                best.add(anchor, scores[row, anchor], vec_id[row], given[row])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.rows[0], pa.int32()), pa.array(best.rows[1]), best.ids()], ["anchor", "score", "vec_id"]
        )

    return run


class Slots:
    """The upper limits of each anchor's windows, in descending order, and the lowest lower limit."""

    def __init__(self, anchors: int, windows: list) -> None:
        uppers: list[list[int]] = [[] for _ in range(anchors)]
        self.lowest = np.full(anchors, _LONG.max, np.int64)
        for window in windows:
            uppers[window["anchor"]].append(window["upper"])
            self.lowest[window["anchor"]] = min(self.lowest[window["anchor"]], window["lower"])
        self.count = max(map(len, uppers), default=0)
        # Slot k of an anchor holds scores up to its limit k and above limit k + 1.
        self.limits = np.full((anchors, self.count + 1), _LONG.min, np.int64)
        for k, limits in enumerate(uppers):
            self.limits[k, : len(limits)] = sorted(limits, reverse=True)

    def of(self, anchor: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The slot of each score, the number of limits from the top that it does not exceed, less one."""
        return (score[:, None] <= self.limits[anchor]).sum(axis=1) - 1


def _negatives(anchors: Anchors, slots: Slots, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = slots.count
        best = Best(len(anchors.vec_id) * width, most)
        for vec_id, given, label, scores in _tiles(stream, anchors):
            inside = (scores <= slots.limits[:, 0]) & (scores >= slots.lowest) & (label[:, None] != anchors.label)
            row, anchor = np.nonzero(inside)
            score = scores[row, anchor]
            group = anchor * width + slots.of(anchor, score)
            good = score >= best.limit[group]
            if good.any():
                best.add(group[good], score[good], vec_id[row[good]], given[row[good]])
        group = best.rows[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(group // max(width, 1), pa.int32()),
                pa.array(group % max(width, 1), pa.int32()),
                pa.array(best.rows[1]),
                best.ids(),
            ],
            ["anchor", "slot", "score", "vec_id"],
        )

    return run


def _first(rows: DataFrame, groups: list[str], most: int, rank: str) -> DataFrame:
    """The best ``most`` rows of every group of what the tasks kept."""
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def _bounds(low: int, scale: int, high: int) -> tuple[Column, Column]:
    """The least and the largest score s with low * p <= scale * s <= high * p, for the positive's score p."""
    wide = F.col("score").cast("decimal(38,0)")
    lower = F.ceil(wide * low / F.lit(scale).cast("decimal(10,0)"))
    upper = F.floor(wide * high / F.lit(scale).cast("decimal(10,0)"))

    def held(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit(_LONG.max)), F.lit(_LONG.min + 1)).cast("bigint")

    return held(lower), held(upper)


def _block(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, bounds: tuple[Column, Column]) -> DataFrame:
    """Answers for one block of anchors, by their place in the block."""
    near = materialize(
        _first(rows.mapInArrow(_positives(anchors, positives), _POSITIVE), ["anchor"], positives, "place")
        .select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score"), bounds[0].alias("lower"), bounds[1].alias("upper"))
    )
    # A row for each anchor and positive: bounded by the block.
    slots = Slots(len(anchors.vec_id), near.select("anchor", "lower", "upper").collect())
    kept = _first(rows.mapInArrow(_negatives(anchors, slots, negatives), _NEGATIVE), ["anchor", "slot"], negatives, "place")
    # Slots times rows per slot, whatever the input: an anchor's list is short.
    entry = F.struct((-F.col("score")).alias("order"), F.col("vec_id").isNull().alias("unnamed"), "vec_id", "score", "slot")
    lists = materialize(kept.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("kept")))
    ordered = Window.partitionBy("anchor").orderBy(F.desc("upper"), "place")
    windows = near.withColumn("slot", F.row_number().over(ordered) - 1)
    merged = windows.join(lists, "anchor").select(
        "*", F.slice(F.filter("kept", lambda e: e["slot"] >= F.col("slot")), 1, negatives).alias("first")
    )
    inside = F.filter("first", lambda e: e["score"] >= F.col("lower"))
    return merged.select("anchor", "positive_id", F.col("score").alias("positive_score"), F.posexplode(inside).alias("at", "e")).select(
        "anchor", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score",
        F.col("e.score").alias("negative_score"),
    )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    scale: int = 100,
    high: int = 90,
    block: int | None = None,
) -> DataFrame:
    """Hard negatives as anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding.  A row's score is its integer
    inner product with the anchor, components taken as floor(256 x); a shorter
    vector has zeros for what it lacks.  An anchor's positives are its first
    ``positives`` other rows (of another vec_id) of its label; for each, the
    first ``negatives`` rows of other labels with
    low * positive <= scale * negative <= high * positive are returned.  Higher
    scores come first, then smaller ids, rows without vec_id last.

    Rows without a label, a vector or with a component that is null or not
    finite take no part; rows without a vec_id are never anchors.  A row that is
    repeated counts as often as it is there.  An anchor without positives or
    without rows in a window has no row; an empty table gives none.

    The rows are read twice for each ``block`` anchors; anchors of a block, and
    five limits for each, are all that reaches the driver at once.
    """
    rows = usable(vectors)
    bounds = _bounds(low, scale, high)
    size = block or BLOCK
    chosen = materialize(rows.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).distinct())
    blocks = max(1, -(-chosen.count() // size))
    # A hash deals the anchors into blocks, so that no block's ids have to be looked up.
    dealt = chosen.withColumn("_block", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)))
    parts = []
    for number in range(blocks):
        own = dealt.where(F.col("_block") == number).sort("vec_id", "label", F.xxhash64("embedding")).collect()
        if not own:
            continue
        anchors = Anchors(own)
        spark = vectors.sparkSession
        names = spark.createDataFrame(
            [(k, r["vec_id"]) for k, r in enumerate(own)], "anchor int, anchor_id bigint"
        )
        found = _block(rows, anchors, positives, negatives, bounds)
        answers = found.join(F.broadcast(names), "anchor").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
        parts.append(materialize(answers) if blocks > 1 else answers)
    if not parts:
        kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return vectors.sparkSession.createDataFrame([], kind)
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result
