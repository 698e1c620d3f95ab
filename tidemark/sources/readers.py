"""Readers of logs, archives, manifests, failure records and URL lists: files by path, or columns already read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import channel_id, playlist_id, url_type, video_id

#: A log line (fixed format): time, level, run, task, video, message.
LOG_LINE = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\] \[([A-Z]+)\] \[run:([^\]]*)\] \[task:([^\]]*)\] \[video:([^\]]*)\] (.*)$"
FAILURE = "video_id string, url string, stage string, error_type string, timestamp string, run_id string, reason string, channel_id string, channel_name string"
ITEM = "video_id string, url string, title string, channel_id string, channel_name string, upload_date string, duration int, description string, _type string, playlist_id string"
MANIFEST = "batch_id string, source string, videos map<string,struct<url:string,title:string,stage:string,error:string,error_type:string,retries:int,completed_chunks:array<int>,output_files:map<string,string>,started_at:string,updated_at:string>>"


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines (value, and other columns) with their fields; lines of another form are left out."""
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    parsed = lines.where(F.col("value").rlike(LOG_LINE))
    return parsed.select(*[c for c in lines.columns if c != "value"], F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("level"), part(3).alias("run_id"), part(4).alias("task"), part(5).alias("video_id"), part(6).alias("message"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure records, one JSON object a line; broken lines are left out."""
    return spark.read.schema(FAILURE).option("mode", "DROPMALFORMED").json(path).where("video_id is not null")


def read_items(spark: SparkSession, path: str, channel: bool = True, most: int | None = None) -> DataFrame:
    """Items of a landed scan, one JSON object a line. Of a channel: no playlists, no rows without id, empty fields as nulls.

    playlist_id is the list that a row names, else the name of its file without the ending: scans of several lists may lie in one folder.

    With `most`, that many items of each channel at most, the latest uploads first, then by id.
    """
    rows = spark.read.schema(ITEM).option("mode", "DROPMALFORMED").json(path).where("video_id is not null and video_id != ''")
    rows = rows.withColumn("playlist_id", F.coalesce(F.nullif("playlist_id", F.lit("")), F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[a-z]+)*$", 1)))
    if not channel:
        return rows
    filled = {c: F.nullif(F.col(c), F.lit("")) for c in ("channel_id", "channel_name", "title", "url")}
    rows = rows.where("_type is null or _type != 'playlist'").withColumns(filled)
    rows = rows.withColumn("url", F.coalesce("url", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id")))
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc_nulls_last("upload_date"), "video_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def read_by_url(spark: SparkSession, urls: DataFrame, landed: dict[str, str]) -> DataFrame | None:
    """url_type, and the items of the landed scans (a path per kind: video, playlist, channel) that `urls` (url) ask for; None without scans.

    A video is asked for by its id, a channel's items by the channel's, a playlist's by the list's.
    """
    kinds = urls.select(url_type(F.col("url")).alias("url_type"), F.coalesce(video_id(F.col("url")), playlist_id(F.col("url")), channel_id(F.col("url"))).alias("_asked")).distinct()
    found = None
    for kind, path in landed.items():
        key = {"video": "video_id", "channel": "channel_id", "playlist": "playlist_id"}[kind]
        asked = kinds.where(F.col("url_type") == kind).select(F.col("_asked").alias(key))
        part = read_items(spark, path, channel=kind != "video").join(asked, key, "left_semi").select(F.lit(kind).alias("url_type"), "*")
        found = part if found is None else found.unionByName(part)
    return found


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: non-blank lines, stripped. A bag: no order, repeated lines stay."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of the batches' manifests (JSON files); a broken file has no rows."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).where("batch_id is not null")
    return rows.select("batch_id", "source", F.explode("videos").alias("video_id", "v")).select("batch_id", "source", "video_id", "v.*")


def file_listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """name, length, modified of files by pattern, names falling."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("name"))


def outdated(files: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Log files of a listing (name, modified) that are older than `days`; files of other names stay."""
    log = (F.col("name").startswith("app_") & F.col("name").endswith(".log")) | F.col("name").startswith("app.log")
    return files.where(log & (F.col("modified") < now - F.make_dt_interval(days=F.lit(days))))
