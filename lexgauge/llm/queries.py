"""The operators as named queries over whole tables, and their SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgauge.llm import chat, licenses, simple8b, sql
from lexgauge.llm.common import documents
from lexgauge.llm.decontaminate import contaminated
from lexgauge.llm.langid import identify
from lexgauge.llm.lines import build, drop_frequent
from lexgauge.llm.mixing import mix
from lexgauge.llm.negatives import mine
from lexgauge.llm.quality import quality
from lexgauge.llm.sharding import interleave
from lexgauge.llm.simhash import near_groups
from lexgauge.llm.spelling import variants, vocabulary
from lexgauge.llm.toxicity import toxicity
from lexgauge.session import checkpoint_root
from lexgauge.sources.tables import read_table

#: Tokenizer files of the queries; the operators take any path.
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place for files that an operator writes."""
    return f"{checkpoint_root(spark)}/{name}/{uuid.uuid4().hex}"


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    simple8b.write_tokens(documents(spark, sf_dir), path, WORDS, END_ID)
    return simple8b.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    path = folder(spark, "chats")
    chat.format_chats(read_table(spark, sf_dir, "conversations").union(extra), BYTES).write.parquet(path)
    return chat.digest_chats(spark.read.schema(chat.SCHEMA).parquet(path), BYTES)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select(
        "row.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "sampled"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op6_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return drop_frequent(build(docs), docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "class_distance",
        "word_distance",
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    return mine(read_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(documents(spark, sf_dir), slip=31))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_chat": op2_chat,
    "op3_mix": op3_mix,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_contaminated": op6_contaminated,
    "op7_lines": op7_lines,
    "op8_quality": op8_quality,
    "op9_shards": op9_shards,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_spelling": op12_spelling,
    "op13_licenses": op13_licenses,
}

ORACLES = {
    "op7_lines": sql.LINES,
    "op8_quality": sql.QUALITY,
    "op3_mix": sql.MIX,
    "op11_negatives": sql.NEGATIVES,
    "op12_spelling": sql.SPELLING,
}
