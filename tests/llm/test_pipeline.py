import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexgauge.llm import decontaminate
from lexgauge.llm.queries import ORACLES, QUERIES
from tests.llm import plain


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, sf_dir)
    ids = [r["doc_id"] for r in good.orderBy("doc_id").collect()]
    scored = {r["doc_id"] for r in QUERIES["op8_quality"](spark, sf_dir).collect() if r["kept"]}
    assert good.columns == docs.columns and set(ids) == scored

    one = stage["near_dedup"](spark, good, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [plain.fingerprint(texts[i]) for i in ids]
    kept = [i for place, i in enumerate(ids) if plain.groups(prints)[place] == place] if len(ids) < 50 else None
    tops = plain.groups(prints)
    kept = [i for place, i in enumerate(ids) if tops[place] == place]
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == kept

    clean = stage["decontamination"](spark, one, sf_dir)
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = [
        i for i in kept
        if all(decontaminate.edits(p, decontaminate.words_of(texts[i])) > int(0.2 * len(p)) for p in items)
    ]
    assert sorted(r["doc_id"] for r in clean.collect()) == expected

    mixed = stage["mixing"](spark, clean, sf_dir)
    chosen = sorted(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(chosen) < set(expected) and chosen

    out = stage["token_output"](spark, mixed, sf_dir)
    assert [r["doc_id"] for r in out.orderBy("start").collect()] == chosen
    whole = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == sorted(
        map(tuple, out.select("doc_id", "start", "ids_crc32").collect())
    )


def test_stages_take_odd_documents(spark, sf_dir):
    docs = plain.clashing(plain.documents(spark))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0
        if name != "token_output":
            assert out.columns == docs.columns
        assert stage(spark, docs.where("1 = 0"), sf_dir).count() == 0


@pytest.mark.parametrize("name", ["near_dedup", "decontamination", "token_output"])
def test_batches_are_cut_by_their_bytes(spark, sf_dir, name):
    def sizes(stream):
        for batch in stream:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        dict(pipeline.STAGES)[name](spark, plain.documents(spark).where("1 = 0"), sf_dir)
        texts = spark.range(0, 20, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
        found = texts.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    finally:
        spark.conf.unset(key)
    assert sum(r["rows"] for r in found) == 20
    assert max(r["bytes"] for r in found) <= pipeline.BATCH_BYTES + (2 << 20)


def test_queries_match_their_twins(spark, sf_dir):
    from tests.compare import difference, duck

    connection = duck(sf_dir)
    for name, sql in ORACLES.items():
        assert difference(QUERIES[name](spark, sf_dir), connection, sql) is None, name
