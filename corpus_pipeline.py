"""From raw documents to token files: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgauge.llm import simple8b
from lexgauge.llm.decontaminate import keep_clean
from lexgauge.llm.mixing import sample
from lexgauge.llm.quality import keep_good
from lexgauge.llm.queries import END_ID, WORDS, folder
from lexgauge.llm.simhash import keep_representatives
from lexgauge.session import materialize
from lexgauge.sources.tables import read_table


#: Bytes of an Arrow batch. What goes to a Python worker and what comes back is held on both sides, beside the JVM's heap.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches by their bytes; Spark's own bound is 10,000 rows or 64 MB, whatever the texts.

    A setting of the session, as Spark reads it when the rows are asked for. No result depends on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    bound_batches(spark)
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bound_batches(spark)
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, as read back: doc_id, start, n_tokens, ids_crc32 and ids."""
    bound_batches(spark)
    path = folder(spark, "tokens")
    simple8b.write_tokens(docs, path, WORDS, END_ID)
    return simple8b.read_tokens(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL cannot express the near-duplicate and token stages; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
