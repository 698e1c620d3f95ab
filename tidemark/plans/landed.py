"""Queries that land derived rows as files of their own formats and read them back with the library's readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import batches, cues, outputs, providers, state
from tidemark.plans.batches import _MANIFEST, _manifest
from tidemark.plans.registry import query
from tidemark.plans.scalars import _LOG
from tidemark.sources import carriers as C
from tidemark.sources import readers, tail
from tidemark.sources.carriers import with_
from tidemark.sources.places import place
from tidemark.streaming import state as streams


def _scans(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Landed scans: every document as a video, channels by source, playlists by language."""
    base, docs = place(spark, "scans"), C.table(spark, sf_dir, "documents")
    name = F.lpad(F.col("doc_id").cast("string"), 11, "0").alias("video_id")
    item = docs.select(name, F.left("text", F.lit(20)).alias("title"), F.concat(F.lit("UC"), "source").alias("channel_id"), F.concat(F.lit("PL"), "lang").alias("playlist_id"), F.when(F.col("doc_id") % 10 == 0, "playlist").otherwise("video").alias("_type"))
    for kind in ("video", "channel", "playlist"):
        item.write.json(f"{base}/{kind}")
    return {kind: f"{base}/{kind}" for kind in ("video", "channel", "playlist")}


@query("SELECT lpad(doc_id::VARCHAR, 11, '0') AS video_id, 'https://www.youtube.com/watch?v=' || lpad(doc_id::VARCHAR, 11, '0') AS url, nullif(left(text, 20), '') AS title, 'UC' || source AS channel_id FROM documents WHERE doc_id % 10 <> 0")
def scan_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a landed channel scan; playlists in it are left out, addresses filled in."""
    return readers.read_items(spark, _scans(spark, sf_dir)["channel"]).select("video_id", "url", "title", "channel_id")


@query("""WITH u AS (SELECT min(doc_id) AS v, min(source) AS s, min(lang) AS l FROM documents), d AS (SELECT lpad(doc_id::VARCHAR, 11, '0') AS video_id, doc_id, source, lang FROM documents)
SELECT 'video' AS url_type, video_id FROM d, u WHERE doc_id = v UNION ALL SELECT 'channel', video_id FROM d, u WHERE source = s AND doc_id % 10 <> 0 UNION ALL SELECT 'playlist', video_id FROM d, u WHERE lang = l AND doc_id % 10 <> 0""")
def scan_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that three addresses ask for: a video, a channel, one list of several."""
    least = C.table(spark, sf_dir, "documents").agg(F.min("doc_id").alias("v"), F.min("source").alias("s"), F.min("lang").alias("l"))  # one row
    head = "https://www.youtube.com/"
    urls = F.array(F.concat(F.lit(head + "watch?v="), F.lpad(F.col("v").cast("string"), 11, "0")), F.concat(F.lit(head + "channel/UC"), "s"), F.concat(F.lit(head + "playlist?list=PL"), "l"))
    return readers.read_by_url(spark, least.select(F.explode(urls).alias("url")), _scans(spark, sf_dir)).select("url_type", "video_id")


@query(with_("urls") + "SELECT trim(url) AS url FROM urls WHERE trim(url) <> ''")
def scan_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a file with blank lines between them."""
    path = place(spark, "urls")
    C.urls(spark, sf_dir).select(F.concat(F.lit("\n "), "url", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_url_list(spark, path)


@query(f"WITH {_MANIFEST} SELECT batch_id, video_id::VARCHAR AS video_id, stage, nullif(kind, '-') AS error_type, started_at, updated_at FROM m")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of manifests that lie as files, one per batch."""
    path = place(spark, "manifests")
    batches.write_manifests(_manifest(spark, sf_dir), path)
    return readers.read_manifest(spark, path).select("batch_id", "video_id", "stage", "error_type", "started_at", "updated_at")


@query("SELECT printf('app_%04d.log', doc_id) AS name, strlen(text)::BIGINT AS length FROM documents WHERE doc_id % 20 = 0")
def log_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of log files in a folder that also holds others."""
    path, docs = place(spark, "logs"), C.table(spark, sf_dir, "documents")
    outputs.write_named(docs.where("doc_id % 20 = 0"), path, F.format_string("app_%04d.log", F.col("doc_id")), "text")
    outputs.write_named(docs.where("doc_id % 20 = 1"), path, F.format_string("%d.txt", F.col("doc_id")), "text")
    return readers.file_listing(spark, path, "*.log").select("name", "length")


@query(with_("videos") + "SELECT video_id::VARCHAR AS video_id, 'u' || video_id AS url, stage, coalesce(error_type, 'x') AS error_type, CASE WHEN video_id % 3 <> 0 THEN 'r' || video_id % 3 END AS run_id FROM videos WHERE stage = 'failed'")
def failure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure records, added in two goes and read back."""
    path = place(spark, "failures")
    failed = C.videos(spark, sf_dir).where("stage = 'failed'")
    run = F.when(F.col("video_id") % 3 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("video_id") % 3).cast("string")))
    rows = failed.select(F.col("video_id").cast("string").alias("video_id"), F.concat(F.lit("u"), F.col("video_id").cast("string")).alias("url"), "stage", F.coalesce("error_type", F.lit("x")).alias("error_type"), run.alias("run_id"))
    for part in (0, 1):
        outputs.append_failures(rows.where(F.pmod(F.hash("video_id"), F.lit(2)) == part), path)
    return readers.read_failures(spark, path).select("video_id", "url", "stage", "error_type", "run_id")


@query("SELECT doc_id::VARCHAR AS video_id FROM labels WHERE quality = 1")
def archive_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that is filled, cleared, and filled again in two goes that overlap."""
    path, labels = place(spark, "archive"), C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), "quality")
    outputs.append_archive(labels, path)
    outputs.clear_archive(spark, path)
    outputs.append_archive(labels.where("quality = 1"), path)
    outputs.append_archive(labels.where("quality = 1 and video_id % 2 = 0"), path)
    return state.read_archive(spark.read.text(path))


@query(with_("cues") + 'SELECT video_id, pos::INT AS index, replace(start, \',\', \'.\') AS start, replace("end", \',\', \'.\') AS "end", text FROM cues')
def chunk_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of web files as chunks take them: times as they stand, numbered anew."""
    return C.vtt_files(spark, sf_dir).select("video_id", F.explode(cues.parse_for_chunks(F.col("vtt"))).alias("c")).select("video_id", "c.index", "c.start", "c.end", "c.text")


class _Two:
    """Refuses more than two cues at once."""

    def generate(self, prompt: str) -> str:
        if prompt.count("\n\n") > 1:
            raise ValueError("too many cues")
        return prompt.replace("e", "E")


@query("WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, string_agg(replace(t, 'e', 'E'), chr(10) || chr(10) ORDER BY turn) AS answer FROM t WHERE t <> '' GROUP BY conv_id")
def chunk_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a provider refuses as a whole, cut in two until it answers."""
    providers.register("two", _Two)
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t")).where("t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "t")))
    chunks = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))
    return providers.call_bisecting(chunks, ["conv_id"], "text", "two", place(spark, "rounds"), least=1)


@query(with_("log_lines") + f"SELECT regexp_extract(value, {_LOG}, 4) AS task, regexp_extract(value, {_LOG}, 2) AS level, count(*) AS n FROM log_lines WHERE regexp_matches(value, {_LOG}) GROUP BY 1, 2")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by task and level of the lines of log files, as a stream that sees what is appended."""
    path = place(spark, "logs")
    lines = C.log_lines(spark, sf_dir).groupBy((F.col("event_id") % 8).alias("k")).agg(F.concat(F.array_join(F.array_sort(F.collect_list("value")), "\n"), F.lit("\n")).alias("content"))
    outputs.write_named(lines, path, F.format_string("app_%d.log", F.col("k")))
    return streams.drain(streams.tail_log(tail.tail(spark, path).select("value")), f"{path}-out", f"{path}-checkpoint")
