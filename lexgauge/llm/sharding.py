"""Shards with the corpus mixture: proportional stratified interleaving.

The rows of each source are put in a seeded random order, a row's fractional
rank is its place in that order over the size of its source, and the rows of
all sources sorted by it form one sequence in which every stretch holds the
sources in their proportions.  The sequence is cut into shards whose row counts
differ by at most one (law ``rows``).

Built-in functions only; text is read once, for its size and checksum, and is
not shuffled.  Both sorts are range sorts over keys that end in a hash, so a
source with a third of all rows spreads over many tasks.  Null sources form a
source of their own, null texts are empty, null or repeated doc_ids are placed
by the text's checksum; rows equal in all of these are interchangeable.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.ordering import with_row_number
from lexgauge.llm.common import unit_hash
from lexgauge.session import materialize


def interleave(docs: DataFrame, shards: int = 8, seed: int = 7, source: Column | None = None) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and position of every row.

    ``size`` is the text's UTF-8 bytes plus one; ``slot`` counts from 0 inside
    a shard; ``grown_shard`` is null, as this law does not promise where rows go
    when a shard is added.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"],
        F.coalesce((docs["source"] if source is None else source).cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("chance", unit_hash(F.lit(seed), F.col("doc_id"), F.col("text_crc32")))
    ties = ["chance", "doc_id", "text_crc32"]
    ranked = materialize(with_row_number(rows, ["source", *ties], "place"))
    # One row per source: where its run of places starts, and how long it is.
    sources = materialize(
        ranked.groupBy("source").agg(F.min("place").alias("start"), F.count("*").alias("members"))
    )
    total = sources.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    spread = ranked.join(sources, "source").withColumn(
        "fraction", (F.col("place") - F.col("start") + 0.5) / F.col("members")
    )
    ordered = with_row_number(spread.drop("place", "start", "members"), ["fraction", *ties, "source"], "place")
    return (
        ordered.select("doc_id", "source", "size", "text_crc32", (F.col("place") - 1).alias("position"))
        .withColumn("shard", F.expr(f"CAST(position * {shards} DIV {max(total, 1)} AS int)"))
        # A shard starts at the smallest position p with p * shards >= shard * total.
        .withColumn("start", F.expr(f"(CAST(shard AS bigint) * {total} + {shards - 1}) DIV {shards}"))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("position") - F.col("start")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "position",
        )
    )
