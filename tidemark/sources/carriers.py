"""Transcript tables derived from the general test tables, on both engines alike.

The driver's tables hold no timed text, so cues, URLs, tracks, stage events and messages are made from their columns by plain
expressions. Each function has its DuckDB counterpart in `SQL` under the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import srt_time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, pos, text, start_ms, end_ms, start, end: parts of each conversation's turns, timed by their lengths."""
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), ", ")))
    parts = parts.select("video_id", "turn", F.col("pos").alias("part"), F.trim("col").alias("text")).where("text != ''")
    w = Window.partitionBy("video_id").orderBy("turn", "part")
    length, gap = F.length("text") * 50, F.when(F.row_number().over(w) % 5 == 0, 2000).otherwise(300)
    timed = parts.select("video_id", F.row_number().over(w).alias("pos"), "text", (length + gap).cast("long").alias("_step"), length.cast("long").alias("_len"))
    before = F.coalesce(F.sum("_step").over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = timed.select("video_id", "pos", "text", before.alias("start_ms"), (before + F.col("_len")).alias("end_ms"))
    return timed.select("*", srt_time(F.col("start_ms")).alias("start"), srt_time(F.col("end_ms")).alias("end"))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, content: the cues of each conversation as a file."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text")))
    lines = F.transform(ordered, lambda c: F.concat(c["pos"].cast("string"), F.lit("\n"), c["start"], F.lit(" --> "), c["end"], F.lit("\n"), c["text"], F.lit("\n")))
    return cues(spark, sf_dir).groupBy("video_id").agg(F.array_join(lines, "\n").alias("content"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url: sources of every kind, by the page's number."""
    p, k = F.col("page_id").cast("string"), F.col("page_id") % 7
    made = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(p, 11, "0"))).when(k == 1, F.concat(F.lit("https://youtu.be/"), F.lpad(p, 11, "a"), F.lit("?t=3")))
    made = made.when(k == 2, F.concat(F.lit("https://www.youtube.com/playlist?list=PL"), p)).when(k == 3, F.concat(F.lit("https://YouTube.com/@name"), p)).when(k == 4, F.concat(F.lit("https://www.youtube.com/channel/UC"), p, F.lit("?x=1")))
    return table(spark, sf_dir, "pages").select("page_id", made.when(k == 5, F.col("url")).otherwise(F.concat(F.lit(" https://www.youtube.com/feed/"), p)).alias("url"))


def lang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, code, other: language codes in several spellings."""
    k = F.col("doc_id") % 6
    code = F.when(k == 0, F.col("lang")).when(k == 1, F.concat("lang", F.lit("-"), F.upper("lang"))).when(k == 2, F.upper("lang")).when(k == 3, "zh-CN").when(k == 4, "zh_tw").otherwise("zh-Hans")
    other = F.when(F.col("doc_id") % 5 == 0, "zh-TW").when(F.col("doc_id") % 5 == 1, "en_US").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), other.alias("other"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, lang, is_auto, pos, fetched, ext: tracks of videos, from line items."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("it", "en-GB", "zh-TW", "de", "nl", "ja-JP", "sv")]), (F.col("l_partkey") % 7 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("ttml", "vtt", "json3", "srt")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), lang.alias("lang"), (F.col("l_returnflag") == "N").alias("is_auto"), n.alias("pos"), (F.col("l_partkey") % 3 != 0).alias("fetched"), ext.alias("ext"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, has_original, original_lang, stage, error_type: items, from orders."""
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*[F.lit(x) for x in ("done", "failed", "pending", "skipped", "translating")]), (k % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("AUTH", "NETWORK", "auth", "CONTENT")]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("video_id"), (k % 3 == 0).alias("has_original"), F.element_at(F.array(F.lit("en"), F.lit("de-AT"), F.lit("fr")), (k % 3 + 1).cast("int")).alias("original_lang"), stage.alias("stage"), F.when((stage == "failed") & (k % 7 != 0), kind).alias("error_type"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, stderr, timed_out: what failed fetches print."""
    texts = ("ERROR: HTTP Error 404: Not Found", "WARNING: x\nERROR: Connection reset by peer", "HTTP Error 429: Too Many Requests", "Sign in to confirm you are not a robot", "ERROR: 403 Forbidden", "cookie file has a bad format", "WARNING: only this", "ERROR: Video is private", "authentication check without a successful run", "exit 1")
    pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick.alias("stderr"), (F.col("event_id") % 23 == 0).alias("timed_out"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, value: lines of a log; some do not parse."""
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    line = F.concat(F.lit("["), ts, F.lit("] ["), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit("] [run:r"), (F.col("event_id") % 9).cast("string"), F.lit("] [task:"), F.col("event_type"), F.lit("] [video:"), F.col("user_id").cast("string"), F.lit("] value "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("-- mark --")).otherwise(line).alias("value"))



def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, message: texts behind something that must not be logged."""
    k = F.col("doc_id").cast("string")
    heads = [F.concat(*[k if part == "#" else F.lit(part) for part in head]) for head in SECRETS]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.element_at(F.array(*heads), (F.col("doc_id") % len(SECRETS) + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("message"))


def vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, vtt: the cues of each conversation as a web file with notes and settings."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text")))
    lines = F.transform(ordered, lambda c: F.concat(F.replace(c["start"], F.lit(","), F.lit(".")), F.lit(" --> "), F.replace(c["end"], F.lit(","), F.lit(".")), F.lit(" align:start position:0%\n"), c["text"]))
    return cues(spark, sf_dir).groupBy("video_id").agg(F.concat(F.lit("WEBVTT\n\nNOTE made\n\n"), F.array_join(lines, "\n\n")).alias("vtt"))


#: What must not be logged, in front of each message; # stands for the document's number.
SECRETS = (
    ("key sk-abcdefghijklmnopqrst", "#", "xyz "), ("Authorization: token-value-", "#", " "), ("use bearer   abc.def-ghi_", "#", " "), ("GET /x?token=abcdefghi", "#", "&a=1 "), ("password = hunter", "#", " "), ("proxy http://user:pw", "#", "@host "),
    ("key abcd0123456789abcd0123456789abcd", "#", " "), ("Cookie: SID=abc12\n", "#", " "), ("Cookie: SID=abcdefgh", "#", "; b=c "), ("cookie=abcdefghijkl", "#", " "), ("cookie=ab ", "#", " "), ("Basic YWJjZGVmZ2hpamtsbW5vcA==", "#", " "), ("Basic short ", "#", " "), ("use Bearer ab ", "#", " "),
    ("/x?key=abcdefghi&SECRET=jklmnopqr&apikey=short", "#", " "), ("/x?api_key=abcdefghi", "#", "&access_token=zyxwvutsrq&auth=abc "), ("/x?pwd=abcdefghijk", "#", "&password=short "),
)


TIME_SQL = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"

#: The same tables as DuckDB common table expressions.
SQL = {
    "cues": """cue_parts AS (
  SELECT conv_id AS video_id, turn, unnest(string_split(replace(text, chr(10), ' '), ', ')) AS raw, generate_subscripts(string_split(replace(text, chr(10), ' '), ', '), 1) AS part FROM conversations
), cue_rows AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY turn, part) AS pos, trim(raw, ' ') AS text FROM cue_parts WHERE trim(raw, ' ') <> ''
), cue_steps AS (
  SELECT *, coalesce(sum(length(text) * 50 + CASE WHEN pos % 5 = 0 THEN 2000 ELSE 300 END) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM cue_rows
), cue_times AS (
  SELECT video_id, pos, text, start_ms, start_ms + length(text) * 50 AS end_ms FROM cue_steps
), cues AS (
  SELECT *, """ + TIME_SQL.format("start_ms") + " AS start, " + TIME_SQL.format("end_ms") + ' AS "end" FROM cue_times\n)',
    "srt_files": """srt_files AS (
  SELECT video_id, string_agg(pos || chr(10) || start || ' --> ' || "end" || chr(10) || text || chr(10), chr(10) ORDER BY pos) AS content FROM cues GROUP BY video_id
)""",
    "urls": """urls AS (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || lpad(page_id::VARCHAR, 11, '0') WHEN 1 THEN 'https://youtu.be/' || lpad(page_id::VARCHAR, 11, 'a') || '?t=3'
    WHEN 2 THEN 'https://www.youtube.com/playlist?list=PL' || page_id WHEN 3 THEN 'https://YouTube.com/@name' || page_id WHEN 4 THEN 'https://www.youtube.com/channel/UC' || page_id || '?x=1'
    WHEN 5 THEN url ELSE ' https://www.youtube.com/feed/' || page_id END AS url FROM pages
)""",
    "lang_codes": """lang_codes AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || upper(lang) WHEN 2 THEN upper(lang) WHEN 3 THEN 'zh-CN' WHEN 4 THEN 'zh_tw' ELSE 'zh-Hans' END AS code,
    CASE doc_id % 5 WHEN 0 THEN 'zh-TW' WHEN 1 THEN 'en_US' ELSE lang END AS other FROM documents
)""",
    "tracks": """tracks AS (
  SELECT l_orderkey AS video_id, ['it', 'en-GB', 'zh-TW', 'de', 'nl', 'ja-JP', 'sv'][l_partkey % 7 + 1] AS lang, l_returnflag = 'N' AS is_auto, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS pos, l_partkey % 3 <> 0 AS fetched,
    ['ttml', 'vtt', 'json3', 'srt'][l_suppkey % 4 + 1] AS ext FROM lineitem
)""",
    "videos": """videos AS (
  SELECT o_orderkey AS video_id, o_orderkey % 3 = 0 AS has_original, ['en', 'de-AT', 'fr'][o_orderkey % 3 + 1] AS original_lang, ['done', 'failed', 'pending', 'skipped', 'translating'][o_orderkey % 5 + 1] AS stage,
    CASE WHEN o_orderkey % 5 = 1 AND o_orderkey % 7 <> 0 THEN ['AUTH', 'NETWORK', 'auth', 'CONTENT'][o_orderkey % 4 + 1] END AS error_type FROM orders
)""",
    "messages": """messages AS (
  SELECT event_id, ['ERROR: HTTP Error 404: Not Found', 'WARNING: x' || chr(10) || 'ERROR: Connection reset by peer', 'HTTP Error 429: Too Many Requests', 'Sign in to confirm you are not a robot', 'ERROR: 403 Forbidden',
    'cookie file has a bad format', 'WARNING: only this', 'ERROR: Video is private', 'authentication check without a successful run', 'exit 1'][event_id % 10 + 1] AS stderr, event_id % 23 = 0 AS timed_out FROM events
)""",
    "log_lines": """log_lines AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '-- mark --' ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] [' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '] [run:r' || (event_id % 9) || '] [task:' || event_type
    || '] [video:' || user_id || '] value ' || event_id END AS value FROM events
)""",
    "secrets": "secrets AS (SELECT doc_id, CASE doc_id % " + str(len(SECRETS)) + " " + " ".join(f"WHEN {i} THEN " + " || ".join("doc_id" if part == "#" else "replace('" + part.replace("\n", "~") + "', '~', chr(10))" for part in head) for i, head in enumerate(SECRETS)) + " END || coalesce(text, '') AS message FROM documents)",
}


def with_(*names: str) -> str:
    """A WITH clause of these tables, in this order."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + "\n"
