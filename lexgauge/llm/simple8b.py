"""Token ids as Simple-8b words, written to and read from files.

A 64-bit word holds a selector in its lowest 4 bits and up to 60 bits of data:

    selector   ids in the word   bits of each
    0          1                 64, in the next word (escape)
    1 to 13    60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 ids of 60 // n bits
    14         1                 60
    15         240               0 (a run of zeros)

Ids are packed in blocks of ``BLOCK``.  A block never shares a word with the
next one and its first word is listed, so all blocks are packed side by side
in numpy, one word of every block per step, and are unpacked in one pass.

A file row holds whole documents: their ids, the number of ids of each, the
words, and the number of ids in the shard before the row.  Shards follow the
order of doc_id, so the position of any document is the sum of the shards
before plus what its row says.  Files are written by Spark's own committed
Parquet writer, so a repeated task leaves no trace.

A null text is empty (its only id is the end id); a null doc_id sorts first;
rows that repeat are written each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgauge.llm.pieces import Encoder
from lexgauge.session import materialize

#: Ids of a block.
BLOCK = 1024
#: Ids after which a file row is closed; a document is never cut.
ROW_IDS = 1 << 17
ESCAPE, ZEROS, ZERO_RUN = 0, 15, 240
#: Selectors 1 to 14, most ids first.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
PER_WORD = np.array([1, *COUNTS, ZERO_RUN], np.int64)
WIDTH = np.array([64, *(60 // n for n in COUNTS), 0], np.int64)

SCHEMA = (
    "shard int, row int, before bigint, doc_ids array<bigint>, n_tokens array<int>, "
    "n_ids bigint, words binary, block_words binary"
)


def _choices(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every position the selector of the word that would start there.

    ``ends`` is the position after the block of each id; a word may be padded
    with zeros at the end of its block.  For each selector, the positions whose
    ids are narrow enough are followed step by step, and most drop out early.
    """
    choice = np.zeros(len(ids), np.int8)
    open_ = np.ones(len(ids), bool)
    zero = np.flatnonzero(ids == 0)
    if len(zero) >= ZERO_RUN:
        run = zero[: len(zero) - ZERO_RUN + 1]
        # As many zeros in a row as the list of zeros has places between.
        run = run[(zero[ZERO_RUN - 1 :] - run == ZERO_RUN - 1) & (run + ZERO_RUN <= ends[run])]
        choice[run], open_[run] = ZEROS, False
    for selector, count in enumerate(COUNTS, 1):
        narrow = ids >> np.uint64(WIDTH[selector]) == 0
        at = np.flatnonzero(narrow & open_)
        stop = ends[at]
        narrow = np.concatenate([narrow, np.ones(count, bool)])
        for step in range(1, count):
            if not len(at):
                break
            fits = narrow[at + step] | (at + step >= stop)
            at, stop = at[fits], stop[fits]
        choice[at], open_[at] = selector, False
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids (unsigned 64-bit) and, per block, the number of words before it."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(0, len(ids), BLOCK)
    stops = np.minimum(starts + BLOCK, len(ids))
    choice = _choices(ids, np.repeat(stops, stops - starts))
    # One word of every block per step.
    block, place = np.arange(len(starts)), starts.copy()
    blocks, places = [], []
    while len(block):
        blocks.append(block)
        places.append(place)
        place = place + PER_WORD[choice[place]]
        more = place < stops[block]
        block, place = block[more], place[more]
    blocks, places = np.concatenate(blocks), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    blocks, places = blocks[order], places[order]
    selector = choice[places]
    size = 1 + (selector == ESCAPE)
    out = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros(out[-1], np.uint64)
    words[out[:-1]] = selector.astype(np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in range(1, 15):
        mine = selector == s
        if not mine.any():
            continue
        slots = places[mine][:, None] + np.arange(PER_WORD[s])
        values = padded[slots]
        # Past the end of the block the word is padded with zeros.
        values[slots >= stops[blocks[mine]][:, None]] = 0
        shifts = (4 + WIDTH[s] * np.arange(PER_WORD[s])).astype(np.uint64)
        words[out[:-1][mine]] |= np.bitwise_or.reduce(values << shifts, axis=1)
    escaped = selector == ESCAPE
    words[out[:-1][escaped] + 1] = ids[places[escaped]]
    first = np.searchsorted(blocks, np.arange(len(starts)))
    return words, out[first]


def decode(words: np.ndarray, n_ids: int, block_words: np.ndarray) -> np.ndarray:
    """The ``n_ids`` ids of ``encode``; every block is unpacked at the same time."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    words = np.ascontiguousarray(words, np.uint64)
    raw = np.zeros(len(words), bool)
    selector = (words & np.uint64(15)).astype(np.int64)
    if (selector == ESCAPE).any():
        # The word after an escape is data; it may look like an escape, so runs are walked from their start.
        for at in np.flatnonzero(selector == ESCAPE).tolist():
            if not raw[at]:
                raw[at + 1] = True
    heads = np.flatnonzero(~raw)
    selector = selector[heads]
    block = np.searchsorted(block_words, heads, "right") - 1
    counts = PER_WORD[selector]
    # Where each word's ids start: inside the block they add up, and blocks have a fixed size.
    run = np.cumsum(counts) - counts
    first = np.searchsorted(block, np.arange(len(block_words)))
    start = run - run[first][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n_ids)
    ids = np.zeros(n_ids, np.uint64)
    for s in range(1, 15):
        mine = selector == s
        if not mine.any():
            continue
        slots = start[mine][:, None] + np.arange(PER_WORD[s])
        shifts = (4 + WIDTH[s] * np.arange(PER_WORD[s])).astype(np.uint64)
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        values = (words[heads[mine]][:, None] >> shifts) & mask
        inside = slots < stop[mine][:, None]
        ids[slots[inside]] = values[inside]
    escaped = selector == ESCAPE
    ids[start[escaped]] = words[heads[escaped] + 1]
    return ids


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives a task."""
    return Encoder(path)


def _pieces(texts: Iterator[str | None], characters: int = 1 << 17) -> Iterator[list[str]]:
    """Groups of texts with a bounded total length; a longer text comes alone."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > characters:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _pack(tokenizer: str, end_id: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        ids, before, row = 0, 0, 0

        def closed() -> pa.RecordBatch:
            words, block_words = encode(np.concatenate(held))
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "row": pa.array([row], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "n_tokens": pa.array([[len(x) for x in held]], pa.list_(pa.int32())),
                    "n_ids": pa.array([ids], pa.int64()),
                    "words": [words.astype("<u8").tobytes()],
                    "block_words": [block_words.astype("<u4").tobytes()],
                }
            )

        for batch in stream:
            names = iter(batch.column("doc_id").to_pylist())
            for texts in _pieces(text.as_py() for text in batch.column("text")):
                for coded in encoder.encode(texts):
                    doc_ids.append(next(names))
                    held.append(np.append(coded, np.uint32(end_id)))
                    ids += len(coded) + 1
                    if ids >= ROW_IDS:
                        yield closed()
                        before, row, ids = before + ids, row + 1, 0
                        doc_ids, held = [], []
        if held:
            yield closed()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode all rows and write them under ``path`` in ascending order of doc_id.

    Rows are range-partitioned by doc_id (and the text's hash, so that a
    repeated doc_id may spread); every shard is a range and is sorted.
    """
    rows = docs.select("doc_id", "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    ordered.mapInArrow(_pack(tokenizer, end_id), SCHEMA).write.mode("overwrite").parquet(path)


def _unpack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for at in range(batch.num_rows):
            # Row by row, as a row holds many documents.
            (row,) = batch.slice(at, 1).to_pylist()
            ids = decode(
                np.frombuffer(row["words"], "<u8"), row["n_ids"], np.frombuffer(row["block_words"], "<u4").astype(np.int64)
            ).astype("<u4")
            sizes = np.array(row["n_tokens"], np.int64)
            ends = np.cumsum(sizes)
            data = ids.tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["start"] + ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array(
                        [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), ends.tolist())], pa.int64()
                    ),
                    "ids": pa.array(
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64)))
                    ),
                }
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document, from the files.

    The sizes of the shards, one row per file, are summed to place each shard.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Written, as the planner would otherwise not know how few rows these are and move the words.
    offsets = materialize(sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))
    placed = stored.join(offsets, "shard").select(
        "doc_ids", "n_tokens", "n_ids", "words", "block_words", (F.col("offset") + F.col("before")).alias("start")
    )
    return placed.mapInArrow(
        _unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"
    )
