"""Translation runs: a table of provider calls by content, what each target needs, and chunks that are committed one by one.

A provider call is paid for, so its answer is kept: `call_once` writes every answer to a table keyed by a digest of provider, model
and prompt, and asks only for digests that the table lacks, each once however many rows share it. Rows read their answers back
from the table, so a result that is computed again, or a run that is started again, calls nobody.

`translate` decides for each video and target language: what is there stays, an official track is taken, a strategy may forbid calls,
a video without a source has nothing to translate, and the rest is called for. `translate_chunks` does the latter in parts: answers
are committed wave by wave, a run that was cut takes up what is missing, and an item has a result only when all its chunks have one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.texts import translation_prompt
from tidemark.operators.monitoring import provider_error
from tidemark.operators.providers import call, call_bisecting
from tidemark.operators.state import merge_chunks
from tidemark.sources.places import exists

_CALLS = "call_key string, answer string, call_error string"


def call_key(prompt: Column, provider: str, model: str) -> Column:
    """The digest that a call is known by; null for a null prompt."""
    return F.sha2(F.concat(F.lit(f"{provider.lower()}\n{model}\n"), prompt), 256)


def known_calls(spark: SparkSession, cache: str) -> DataFrame:
    """call_key, answer of all calls that a cache holds an answer of; runs side by side may have asked for the same one."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "call_key string, answer string")
    return spark.read.schema(_CALLS).parquet(cache).where("answer is not null").groupBy("call_key").agg(F.min("answer").alias("answer"))


def call_once(rows: DataFrame, provider: str, prompt: str, cache: str, model: str = "default", concurrency: int | None = None, tries: int = 3) -> DataFrame:
    """`rows` with answer and call_error; calls are made for prompts that `cache`, a folder, has no answer of, and added to it.

    Rows with one prompt share one call. A failed call leaves its error in this result and is made again by the next run. Rows are
    written beside the cache once, because both the calls and the result read them.
    """
    spark, run = rows.sparkSession, f"{cache}/run={uuid.uuid4().hex}"
    keyed = rows.withColumn("call_key", call_key(F.col(prompt), provider, model))
    held = f"{cache.rstrip('/')}-rows/{uuid.uuid4().hex}"
    keyed.write.parquet(held)
    keyed = spark.read.schema(keyed.schema).parquet(held)
    asked = keyed.where("call_key is not null").select("call_key", F.col(prompt).alias("_prompt")).dropDuplicates(["call_key"]).join(known_calls(spark, cache).select("call_key"), "call_key", "left_anti")
    call(asked, provider, "_prompt", concurrency, tries).select("call_key", "answer", "call_error").write.parquet(run)
    failed = spark.read.schema(_CALLS).parquet(run).where("answer is null").select("call_key", "call_error")
    answered = keyed.join(known_calls(spark, cache), "call_key", "left").join(failed, "call_key", "left")
    return answered.select(*rows.columns, "answer", F.when(F.col("answer").isNull(), F.col("call_error")).alias("call_error"))


def call_class(error: Column) -> Column:
    """The class of what a provider raised: the word that its message begins with, if that names a class of provider errors."""
    return F.when(error.isNotNull(), provider_error(F.lower(F.regexp_extract(error, r"^\w+: (\w+)", 1))))


def translate(
    targets: DataFrame, existing: DataFrame, official: DataFrame, sources: DataFrame, provider: str, cache: str, strategy: str = "official_auto", force: bool = False, model: str = "default", concurrency: int | None = None
) -> DataFrame:
    """video_id, target, how, content, error_type for each of `targets` (video_id, target).

    `existing` (video_id, target, content): translations that lie there, kept unless `force`. `official` (video_id, target, content):
    fetched tracks. `sources` (video_id, lang, content): what to translate from. how: existing, official, none (`strategy` official_only
    makes no calls), no_source, called, failed. One row per video and target is expected in each table; a failed call concerns its target only.
    """
    keys = ["video_id", "target"]
    rows = targets.select(*keys).join(existing.select(*keys, F.col("content").alias("_there")), keys, "left") if not force else targets.select(*keys).withColumn("_there", F.lit(None).cast("string"))
    rows = rows.join(official.select(*keys, F.col("content").alias("_official")), keys, "left").join(sources.select("video_id", F.col("lang").alias("_lang"), F.col("content").alias("_source")), "video_id", "left")
    need = F.when(F.col("_there").isNotNull(), "existing").when(F.col("_official").isNotNull(), "official")
    need = need.when(F.lit(strategy == "official_only"), "none").when(F.col("_source").isNull(), "no_source").otherwise("call")
    rows = rows.withColumn("_need", need).withColumn("_prompt", F.when(F.col("_need") == "call", translation_prompt(F.col("_lang"), F.col("target"), F.col("_source"))))
    done = call_once(rows.drop("_source", "_lang"), provider, "_prompt", cache, model, concurrency)
    how = F.when(F.col("_need") != "call", F.col("_need")).when(F.col("answer").isNotNull(), "called").otherwise("failed")
    return done.select(*keys, how.alias("how"), F.coalesce("_there", "_official", "answer").alias("content"), F.when(how == "failed", call_class(F.col("call_error"))).alias("error_type"))


def chunk_state(spark: SparkSession, state: str, keys: Sequence[str], schema: str) -> DataFrame:
    """`keys` (of `schema`), chunk_index, digest, translated, call_error: all chunks that runs have committed to the folder `state`."""
    full = f"{schema}, chunk_index int, digest string, translated string, call_error string"
    return spark.read.schema(full).parquet(state) if exists(spark, state) else spark.createDataFrame([], full)


def translate_chunks(chunks: DataFrame, keys: Sequence[str], provider: str, state: str, waves: int = 4, upto: int | None = None, bisect: bool = True) -> DataFrame:
    """`keys`, content: chunks (`keys`, chunk_index, content) translated and joined in order, for items all of whose chunks are.

    Chunks are dealt into `waves` by a hash; each wave's answers are committed to `state`, a folder, before the next one starts, and what is
    committed for the same content is never called for again, by this run or a later one. `upto` stops behind that many waves. With
    `bisect`, a chunk whose call fails is cut in two and tried again.
    """
    spark, keys = chunks.sparkSession, list(keys)
    schema = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in keys)
    marked = chunks.select(*keys, F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.sha2("content", 256).alias("digest"))
    each = [*keys, "chunk_index", "digest"]
    for wave in range(waves if upto is None else min(upto, waves)):
        mine = marked.where(F.pmod(F.xxhash64(*keys, "chunk_index"), F.lit(waves)) == wave)
        pending = mine.join(chunk_state(spark, state, keys, schema).where("translated is not null").select(*each), each, "left_anti")
        if bisect:
            answers = call_bisecting(pending, each, "content", provider, f"{state}-rounds/{uuid.uuid4().hex}").select(*each, "answer", F.when(F.col("answer").isNull(), "no answer").alias("call_error"))
        else:
            answers = call(pending, provider, "content").select(*each, "answer", "call_error")
        answers.withColumnRenamed("answer", "translated").write.parquet(f"{state}/wave={uuid.uuid4().hex}")
    return merge_chunks(_with_state(marked, state, keys, schema), keys)


def _with_state(marked: DataFrame, state: str, keys: list[str], schema: str) -> DataFrame:
    each = [*keys, "chunk_index", "digest"]
    last = chunk_state(marked.sparkSession, state, keys, schema).groupBy(*each).agg(F.min("translated").alias("translated"), F.max("call_error").alias("call_error"))
    return marked.join(last, each, "left")


def chunk_milestones(chunks: DataFrame, keys: Sequence[str], state: str, step: int = 25) -> DataFrame:
    """`keys`, total, completed, failed, percent, milestone (percent in whole `step`s) of each item's chunks by what `state` holds."""
    keys = list(keys)
    schema = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in keys)
    marked = chunks.select(*keys, F.col("chunk_index").cast("int").alias("chunk_index"), F.sha2("content", 256).alias("digest"))
    done, percent = F.count("translated"), F.lit(100) * F.count("translated") / F.count("*")
    by = _with_state(marked, state, keys, schema).groupBy(*keys)
    return by.agg(F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("translated").isNull() & F.col("call_error").isNotNull()).alias("failed"), percent.alias("percent"), (F.floor(percent / step) * step).cast("int").alias("milestone"))
