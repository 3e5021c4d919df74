"""Helpers that several operators of the subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.sources.tables import read_table

#: White space of the contracts: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: One fold of five is held out of every fit.
FOLDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that no new column clashes with an old one."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def trimmed(text: Column) -> Column:
    """The text (null: empty) without white space at both ends."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def split_words(text: Column) -> Column:
    """Words between white space; none for null, empty or blank texts."""
    clean = trimmed(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 13 hex digits of their md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**13))


def batches(table: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` over Arrow batches inside the tasks."""
    return table.mapInArrow(work, schema)


def whole_groups(
    stream: Iterator[pa.RecordBatch], keys: list[str], least: int = 1
) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables that never split a key.

    A table has at least ``least`` rows, but for the last one, and holds the
    groups that were needed to reach them.
    """
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in stream:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = {k: table.column(k)[-1] for k in keys}
        same = None
        for k in keys:
            equal = pc.equal(table.column(k), last[k]) if last[k].is_valid else pc.is_null(table.column(k))
            equal = pc.fill_null(equal, False)
            same = equal if same is None else pc.and_(same, equal)
        # The key's rows are the last ones, as the stream is sorted.
        cut = table.num_rows - (pc.sum(same).as_py() or 0)
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held)
