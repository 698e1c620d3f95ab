"""What workers hold at once, and between tasks, does not grow with the texts of their tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, sentencepiece_codec
from tidemark.llm.queries import tokenizer


def test_the_pipeline_bounds_bytes_of_batches(spark):
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" some words"), 8000)).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64())})

    try:
        got = corpus_pipeline.tokens(spark, docs, "").limit(3).collect()
        largest, n = docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes"), F.count("*")).first()
        assert largest < 8_000_000 and n > 5
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        common.bounded_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"  # a limit of the session stays
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    model = sentencepiece_codec.Codec(tokenizer("piece_bpe_32k.model")).model
    text = " some words" * 8000
    assert [(r.doc_id, r.n_tokens, r.ids) for r in got] == [(i, len(x), x) for i, x in ((i, model.encode(f"{i}{text}")) for i in range(3))]


def test_workers_keep_no_chunks_after_a_task(spark):
    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"codecs": pa.array([len(sentencepiece_codec._codecs)], pa.int64()), "chunks": pa.array([sum(len(c.index) for c in sentencepiece_codec._codecs.values())], pa.int64())})

    docs = spark.range(0, 800, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    assert sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model")).where("size(ids) > 0").count() == 800
    codecs, chunks = spark.range(0, 8, 1, 8).mapInArrow(held, "codecs long, chunks long").agg(F.sum("codecs"), F.sum("chunks")).first()
    assert codecs > 0 and chunks == 0
