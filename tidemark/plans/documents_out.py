"""Queries that build output documents: chapters, metadata, failure records, provider answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.texts import clock
from tidemark.operators import outputs, providers
from tidemark.plans.registry import query
from tidemark.sources import carriers as C
from tidemark.sources.carriers import with_
from tidemark.sources.places import place

_NL = "chr(10)"
_CLOCK = "CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END"
_CHAPTERS = "c AS (SELECT l_orderkey AS video_id, l_linenumber AS pos, 'Part | ' || l_partkey AS title, (l_linenumber - 1) * 900 + l_suppkey % 60 AS s FROM lineitem)"


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_linenumber") - 1) * 900 + F.col("l_suppkey") % 60
    return C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Part | "), F.col("l_partkey").cast("string")).alias("title"), start.alias("start_s"))


@query(f"WITH {_CHAPTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos, title, s) AS k FROM c) SELECT video_id, '# Chapters' || {_NL} || {_NL} || string_agg(k || '. [' || {_CLOCK} || '] ' || title, {_NL} ORDER BY k) AS markdown FROM o GROUP BY video_id")
def chapters_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.chapters_list(_chapters(spark, sf_dir), "video_id")


@query(f"WITH {_CHAPTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos, title, s) AS k FROM c) SELECT video_id, '| # | Time | Title |' || {_NL} || '|---|---|---|' || {_NL} || string_agg('| ' || k || ' | ' || {_CLOCK} || ' | ' || replace(title, '|', chr(92) || '|') || ' |', {_NL} ORDER BY k) AS markdown FROM o GROUP BY video_id")
def chapters_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.chapters_table(_chapters(spark, sf_dir), "video_id")


@query(with_("videos") + """SELECT video_id, '{"video_id":' || video_id || ',"stage":"' || stage || '","detection":{"has_original":' || has_original || ',"language":"' || original_lang || '"},"error_type":' || coalesce('"' || error_type || '"', 'null') || '}' AS document FROM videos""")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per item; missing values are written as null."""
    detection = F.struct("has_original", F.col("original_lang").alias("language")).alias("detection")
    return C.videos(spark, sf_dir).select("video_id", outputs.json_document("video_id", "stage", detection, "error_type").alias("document"))


@query(with_("videos") + """SELECT video_id, '{"video_id":"' || video_id || '","stage":"' || stage || '"' || coalesce(',"error_type":"' || error_type || '"', '') || '}' AS line FROM videos WHERE stage = 'failed'""")
def failure_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per failure; optional keys without a value are left out."""
    failed = C.videos(spark, sf_dir).where("stage = 'failed'")
    return failed.select("video_id", F.to_json(F.struct(F.col("video_id").cast("string").alias("video_id"), "stage", F.nullif("error_type", F.lit("")).alias("error_type"))).alias("line"))


@query("SELECT event_id, concat_ws(chr(9), '.example.com', 'TRUE', '/', 'TRUE', '0', 'SID', 'v' || user_id) AS line FROM events")
def cookie_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookie pairs as lines of a seven-column file."""
    return C.table(spark, sf_dir, "events").select("event_id", outputs.cookie_line(F.lit(".example.com"), F.lit("SID"), F.concat(F.lit("v"), F.col("user_id").cast("string"))).alias("line"))


@query(with_("cues") + "SELECT video_id, pos, replace(text, 'e', 'E') AS answer FROM cues")
def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cue through a provider; failed calls keep the text."""
    called = providers.call(C.cues(spark, sf_dir).select("video_id", "pos", "text"), "mark", "text")
    return called.select("video_id", "pos", providers.translate_or_keep(F.col("answer"), F.col("text")).alias("answer"))


@query("WITH s AS (SELECT doc_id, string_agg(replace(substr(text, i * 10000 + 1, 10000), 'e', 'E'), chr(10) || '---' || chr(10) ORDER BY i) AS joined FROM documents, range(0, 10000) r(i) WHERE i * 10000 < length(text) GROUP BY doc_id) SELECT doc_id, CASE WHEN length(text) > 15000 THEN joined ELSE replace(text, 'e', 'E') END AS summary FROM documents JOIN s USING (doc_id)")
def map_reduce_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by prompts, long texts by parts; the stand-in answers with the text that a prompt holds."""
    return providers.map_reduce(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "mark_text", F.col("lang"))


@query("SELECT event_id, CASE WHEN floor(value * 10)::BIGINT >= 3600 THEN printf('%02d:%02d:%02d', floor(value * 10)::BIGINT // 3600, floor(value * 10)::BIGINT // 60 % 60, floor(value * 10)::BIGINT % 60) ELSE printf('%02d:%02d', floor(value * 10)::BIGINT // 60, floor(value * 10)::BIGINT % 60) END AS at FROM events")
def chapter_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events").select("event_id", clock(F.col("value") * 10).alias("at"))


@query("SELECT conv_id, printf('chunk_%04d.srt', turn) AS file, text AS content FROM conversations WHERE coalesce((conv_id + turn) % 4 <> 0, true)")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files that are still to be written, where a part of them lies there from an earlier run."""
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    there = turns.where((F.col("conv_id") + F.col("chunk_index")) % 4 == 0).select("conv_id", F.format_string("chunk_%04d.srt", F.col("chunk_index").cast("long")).alias("file"))
    return outputs.chunk_files(turns, there, "conv_id")


@query("SELECT conv_id || '/' || printf('chunk_%04d.srt', turn) AS file, text AS content FROM conversations")
def chunk_file_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as files of their own, a part of which lay there before, read back."""
    path = place(spark, "files")
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    name = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.format_string("chunk_%04d.srt", F.col("chunk_index").cast("long")))
    outputs.write_named(turns.where("(conv_id + chunk_index) % 4 = 0"), path, name)
    outputs.write_named(turns.withColumn("content", F.when(F.expr("(conv_id + chunk_index) % 4 = 0"), "written again").otherwise(F.col("content"))), path, name)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.srt").load(path)
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), F.col("content").cast("string").alias("content"))
