"""Queries over proxies, queues, logs, records, configurations and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import languages
from tidemark.operators import monitoring as M
from tidemark.operators import align, providers
from tidemark.plans.registry import query
from tidemark.sources import carriers as C
from tidemark.sources import catalog
from tidemark.sources.carriers import with_


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "events")


def _pick(values: tuple, index: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index} + 1 as int)"))


def _listed(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


#: Proxies, the good ones first.
_GOOD = ("http://h:80", "socks5h://u:p@h:1080", "https://h", "SOCKS5://h:1", "http://h:65535/", "socks4://10.0.0.1:9")
_PROXIES = (*_GOOD, "ftp://h:1", "http://:80", "socks4://h:70000", "no proxy", "http://h:0", "http://h:65536", "http://h:x", "://h:1", "http//h:1", "")


@query(f"SELECT event_id, {_listed(_PROXIES)}[event_id % {len(_PROXIES)} + 1] AS proxy, event_id % {len(_PROXIES)} < {len(_GOOD)} AS valid FROM events")
def proxy_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    proxy = _pick(_PROXIES, f"event_id % {len(_PROXIES)}")
    return _events(spark, sf_dir).select("event_id", proxy.alias("proxy")).withColumn("valid", M.valid_proxy(F.col("proxy")))


_POOL = """p AS (SELECT user_id % 5 AS pool, user_id, count(*) AS requests, count_if(event_type = 'error') AS failures, arg_max(event_type, event_id) = 'error' AS unhealthy, max(ts) FILTER (WHERE event_type = 'error') AS failed_at FROM events GROUP BY 1, 2)
, t AS (SELECT *, CASE WHEN NOT unhealthy THEN 1 WHEN failed_at + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-20' THEN 2 ELSE 4 END AS tier FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY tier, CASE WHEN tier = 4 THEN failures::DOUBLE / requests ELSE 0 END, user_id) AS k FROM t)"""


def _proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, failures and state of each proxy of a pool."""
    error = F.col("event_type") == "error"
    by = _events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("pool"), F.col("user_id").alias("pos")).agg(F.count("*").alias("requests"), F.count_if(error).alias("failures"), (F.max_by("event_type", "event_id") == "error").alias("unhealthy"), F.max(F.when(error, F.col("ts"))).alias("failed_at"))
    return by.withColumn("proxy", F.col("pos").cast("string"))


@query(f"WITH {_POOL} SELECT pool, user_id::VARCHAR AS proxy, tier FROM r WHERE k = 1")
def proxy_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy that each pool uses next."""
    return M.next_proxy(_proxies(spark, sf_dir), ["pool"], F.expr("timestamp_ntz '2024-01-20 00:00:00'"))


@query(f"""WITH {_POOL}, x AS (SELECT *, (user_id < 60 OR user_id < 2000 AND user_id % 5 < 3) AS tried FROM p), y AS (SELECT *, CASE WHEN NOT unhealthy AND NOT tried THEN 1 WHEN unhealthy AND NOT tried AND failed_at + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-20' THEN 2 WHEN NOT unhealthy THEN 3 ELSE 4 END AS tier FROM x)
SELECT pool, user_id::VARCHAR AS proxy, tier FROM y QUALIFY row_number() OVER (PARTITION BY pool ORDER BY tier, CASE tier WHEN 3 THEN failures::DOUBLE WHEN 4 THEN failures::DOUBLE / requests ELSE 0 END, user_id) = 1""")
def proxy_next_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy that each pool uses next where some have been tried before."""
    tried = _events(spark, sf_dir).where("user_id < 60 or user_id < 2000 and user_id % 5 < 3").select(F.col("user_id").cast("string").alias("proxy"))
    return M.next_proxy(_proxies(spark, sf_dir), ["pool"], F.expr("timestamp_ntz '2024-01-20 00:00:00'"), tried)


@query(f"WITH {_POOL} SELECT pool, count_if(NOT unhealthy) AS healthy, count_if(unhealthy) AS unhealthy, count_if(tier = 2) AS retryable FROM r GROUP BY pool")
def proxy_health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    by = _events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("pool"), "user_id").agg((F.max_by("event_type", "event_id") == "error").alias("bad"), F.max(F.when(error, F.col("ts"))).alias("failed_at"))
    over = F.col("bad") & (F.col("failed_at") + F.expr("interval 10 minutes") <= F.expr("timestamp_ntz '2024-01-20 00:00:00'"))
    return by.groupBy("pool").agg(F.count_if(~F.col("bad")).alias("healthy"), F.count_if("bad").alias("unhealthy"), F.count_if(over).alias("retryable"))


_STATES = ("processed", "processed", "failed", "pending", "running")


@query(f"WITH i AS (SELECT event_type AS queue, {_listed(_STATES)}[event_id % 5 + 1] AS s FROM events) SELECT queue, count_if(s = 'processed') AS processed, count_if(s = 'failed') AS failed, count(*) AS total, count_if(s = 'pending') AS pending, greatest(0, count(*) - count_if(s = 'processed') - count_if(s = 'failed') - count_if(s = 'pending')) AS processing FROM i GROUP BY queue")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.queue_stats(_events(spark, sf_dir).select(F.col("event_type").alias("queue"), _pick(_STATES, "event_id % 5").alias("state")), "queue")


_LEVELS = ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL")


@query(f"WITH l AS (SELECT event_id, {_listed(_LEVELS)}[event_id % 6 + 1] AS level FROM events) SELECT event_id, level, level IN ('WARNING', 'ERROR', 'CRITICAL') AS loud, level IN ('WARN', 'WARNING') AS warning, level IN ('ERROR', 'CRITICAL') AS error FROM l")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("level")
    rows = _events(spark, sf_dir).select("event_id", _pick(_LEVELS, "event_id % 6").alias("level"))
    return rows.select("event_id", "level", M.at_least(level, "WARNING").alias("loud"), M.of_class(level, "WARNING").alias("warning"), M.of_class(level, "ERROR").alias("error"))


@query("SELECT event_id, '[' || rpad(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END, 5, ' ') || '] ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '[run:r' || (event_id % 7) || '] ' END || '[task:' || event_type || '] [video:' || user_id || '] ' || props AS line FROM events")
def log_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")))
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return _events(spark, sf_dir).select("event_id", M.log_line(level, run, F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("line"))


@query("WITH s AS (SELECT user_id, CASE WHEN count_if(event_type = 'error') = 0 THEN 'healthy' WHEN count_if(event_type = 'error') * 3 < count(*) THEN 'slow' WHEN count_if(event_type = 'error') < count(*) THEN 'unhealthy' ELSE 'unconfigured' END AS status FROM events GROUP BY user_id) SELECT count_if(status = 'healthy') AS healthy, count_if(status = 'slow') AS slow, count_if(status = 'unhealthy') AS unhealthy, count_if(status = 'unconfigured') AS unconfigured, bool_or(status = 'unhealthy') AS any_unhealthy FROM s")
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("event_type") == "error")
    status = F.when(bad == 0, "healthy").when(bad * 3 < F.count("*"), "slow").when(bad < F.count("*"), "unhealthy").otherwise("unconfigured")
    by = _events(spark, sf_dir).groupBy("user_id").agg(status.alias("status"))
    return M.health(by)


_RECORDS = (
    ('{"video_id":"v","url":"u","stage":"s","error_type":"auth","timestamp":"t"}', ""), ('{"video_id":"v","stage":"s","error_type":"auth"}', "url,timestamp"), ("not json", "json"), ('{"video_id":"v","url":"u","stage":"","error_type":"auth","timestamp":"t"}', "stage"),
    ("{}", "video_id,url,stage,error_type,timestamp"), ('["video_id"]', "json"), ('{"video_id":"v","url":null,"stage":"s","error_type":"auth","timestamp":"t","more":1}', "url"), ('{"video_id":"v","url":"u","stage":"s","error_type":"auth","timestamp":"t"', "json"), ("", "json"),
)


@query("SELECT event_id, " + _listed(tuple(p for _, p in _RECORDS)) + f"[event_id % {len(_RECORDS)} + 1] AS problems FROM events")
def record_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure records that lack required fields, or are none."""
    return _events(spark, sf_dir).select("event_id", F.array_join(M.record_problems(_pick(tuple(r for r, _ in _RECORDS), f"event_id % {len(_RECORDS)}")), ",").alias("problems"))


@query("WITH a AS (SELECT ['network', 'auth', 'bogus', 'parse'][event_id % 4 + 1] AS t FROM events), b AS (SELECT ['auth', 'content', 'network'][event_id % 3 + 1] AS t FROM events WHERE event_type = 'error'), x AS (SELECT t, count(*) AS n FROM a GROUP BY t), y AS (SELECT t, count(*) AS n FROM b GROUP BY t) SELECT coalesce(x.t, y.t) AS error_type, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(x.t, y.t) <> 'bogus' AS known FROM x FULL JOIN y ON x.t = y.t")
def error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return M.compare_sources(e.select(_pick(("network", "auth", "bogus", "parse"), "event_id % 4").alias("error_type")), e.where("event_type = 'error'").select(_pick(("auth", "content", "network"), "event_id % 3").alias("error_type")))


@query("SELECT event_id, CASE WHEN event_type IN ('network', 'auth', 'rate_limit', 'content') THEN event_type ELSE 'unknown' END AS mapped, CASE event_id % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'unknown' ELSE 'content' END AS other FROM events")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", M.provider_error(F.col("event_type")).alias("mapped"), M.provider_error(_pick(("auth", "bogus", "content"), "event_id % 3")).alias("other"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'upper' WHEN 1 THEN 'mark' ELSE 'nobody' END AS provider, CASE WHEN event_id % 3 = 2 THEN 4096 ELSE 8000 END AS max_tokens, CASE WHEN event_id % 3 = 2 THEN 5 ELSE 10 END AS max_calls FROM events")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row's provider can do; unknown providers get the default."""
    known = spark.createDataFrame(providers.CAPABILITIES, "provider string, vision boolean, streaming boolean, max_tokens int, max_calls int")
    rows = _events(spark, sf_dir).select("event_id", _pick(("upper", "mark", "nobody"), "event_id % 3").alias("provider"))
    default = providers.DEFAULT_CAPABILITY
    return rows.join(F.broadcast(known), "provider", "left").select("event_id", "provider", F.coalesce("max_tokens", F.lit(default[2])).alias("max_tokens"), F.coalesce("max_calls", F.lit(default[3])).alias("max_calls"))  # a row per provider


@query("WITH w AS (SELECT DISTINCT 'k' || (doc_id % 50) AS key FROM documents WHERE doc_id % 50 < 30), f AS (SELECT DISTINCT 'k' || (doc_id % 50) AS key FROM documents WHERE doc_id % 50 BETWEEN 10 AND 40) SELECT e.event_id, 'k' || (e.event_id % 50) AS key, CASE WHEN w.key IS NOT NULL THEN 'wanted ' || w.key WHEN f.key IS NOT NULL THEN 'fallback ' || f.key ELSE 'k' || (e.event_id % 50) END AS text, CASE WHEN e.event_id % 4 = 1 THEN 'one item' ELSE 'items' END AS plural FROM events e LEFT JOIN w ON w.key = 'k' || (e.event_id % 50) LEFT JOIN f ON f.key = 'k' || (e.event_id % 50)")
def message_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = C.table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k")).distinct().select("k", F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"))
    wanted = keys.where("k < 30").select("key", F.concat(F.lit("wanted "), "key").alias("text"))
    fallback = keys.where("k between 10 and 40").select("key", F.concat(F.lit("fallback "), "key").alias("text"))
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")).alias("key"))
    return M.translated(rows, wanted, fallback).withColumn("plural", M.plural(F.lit("one item"), F.lit("items"), F.col("event_id") % 4))


@query(with_("tracks") + ", a AS (SELECT video_id, string_agg(CASE WHEN NOT is_auto THEN lang END, ', ' ORDER BY pos) AS manual, string_agg(CASE WHEN is_auto THEN lang END, ', ' ORDER BY pos) AS auto FROM tracks GROUP BY video_id) SELECT video_id, concat_ws(' | ', 'manual: ' || manual, 'auto: ' || auto) AS info FROM a")
def track_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = lambda auto: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_auto") == auto, F.struct("pos", "lang")))), lambda x: x["lang"])
    arrays = C.tracks(spark, sf_dir).groupBy("video_id").agg(ordered(False).alias("manual"), ordered(True).alias("auto"))
    return arrays.select("video_id", M.track_info(F.col("manual"), F.col("auto")).alias("info"))


_N = lambda c: f"CASE WHEN lower({c}) IN ('zh-cn', 'zh_cn') THEN 'zh-CN' WHEN lower({c}) IN ('zh-tw', 'zh_tw') THEN 'zh-TW' ELSE lower(regexp_extract({c}, '^[^-_]*', 0)) END"


@query(with_("lang_codes") + f"SELECT doc_id, CASE WHEN {_N('code')} = {_N('other')} THEN {_N('code')} ELSE {_N('code')} || ',' || {_N('other')} END AS languages, true AS has_subtitles, 'Untitled' AS first_title, (doc_id % 100)::DOUBLE AS duration_s FROM lang_codes")
def catalog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs written as JSON and read back: languages in order, chapters with defaults."""
    entry = lambda c: F.struct(F.col(c).alias("lang"), F.array(F.struct(F.lit("vtt").alias("ext"), F.lit("u").alias("url"))).alias("tracks"))
    chapter = F.struct(F.lit(1.0).alias("start_time"), (F.col("doc_id") % 100 + 1).cast("double").alias("end_time"))
    json = F.to_json(F.struct(F.array(entry("code"), entry("other"), entry("code")).alias("manual"), F.array(chapter).alias("chapters"), F.lit(1).alias("ignored")))
    read = C.lang_codes(spark, sf_dir).select("doc_id", json.alias("json")).select("doc_id", catalog.catalog(F.col("json")).alias("c"))
    langs, first = catalog.track_languages(F.col("c.manual")), F.get(catalog.chapters(F.col("c.chapters")), F.lit(0))
    return read.select("doc_id", F.array_join(langs, ",").alias("languages"), (F.size(langs) > 0).alias("has_subtitles"), first["title"].alias("first_title"), first["duration_s"].alias("duration_s"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',zh-TW' WHEN 1 THEN 'en' ELSE 'zh-CN' END AS targets FROM documents")
def config_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's new name before its old one before the default."""
    k, lang = F.col("doc_id") % 3, F.upper("lang")
    json = F.when(k == 0, F.concat(F.lit('{"subtitle_target_languages":["'), lang, F.lit('-x","zh_tw"],"target_languages":["ja"]}'))).when(k == 1, '{"target_languages":["en-US"]}').otherwise("{}")
    return C.table(spark, sf_dir, "documents").select("doc_id", F.array_join(catalog.configured_targets(json), ",").alias("targets"))


@query(with_("lang_codes") + "SELECT doc_id, CASE WHEN string_split(lower(code), '-')[1] = 'zh' THEN CASE WHEN lower(code) IN ('zh-tw', 'zh_tw', 'zh-hant') THEN 'zh-TW' ELSE 'zh-CN' END ELSE string_split(lower(code), '-')[1] END AS provider_code, CASE lower(code) WHEN 'zh-hans' THEN 'zh-CN' ELSE code END AS chinese FROM lang_codes")
def lang_provider_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    return C.lang_codes(spark, sf_dir).select("doc_id", languages.provider_code(c).alias("provider_code"), languages.normalize_chinese(c, F.lit(None).cast("string")).alias("chinese"))


_COUNT = "(length(content) - length(translate(content, '{0}', '')))"
_SIMPLE, _FULL = _COUNT.format(languages.SIMPLIFIED), _COUNT.format(languages.TRADITIONAL)


@query(f"""WITH d AS (SELECT doc_id, ['zh', 'zh-Hant', 'ZH', 'en'][doc_id % 4 + 1] AS code, CASE doc_id % 5 WHEN 0 THEN left('{languages.SIMPLIFIED}', (doc_id % 40)::INT) || left(text, 50) WHEN 1 THEN left('{languages.TRADITIONAL}', (doc_id % 40)::INT) || text WHEN 2 THEN left('{languages.SIMPLIFIED}', 20) || left('{languages.TRADITIONAL}', 20) WHEN 3 THEN text END AS c FROM documents
), n AS (SELECT doc_id, code, coalesce(c, '') AS content FROM d
), v AS (SELECT *, {_SIMPLE} AS s, {_FULL} AS t FROM n)
SELECT doc_id, code, CASE lower(code) WHEN 'zh-hant' THEN 'zh-TW' WHEN 'zh' THEN CASE WHEN s + t < 10 THEN 'zh-CN' WHEN s::DOUBLE / (s + t) > 0.7 THEN 'zh-CN' WHEN s::DOUBLE / (s + t) < 0.3 THEN 'zh-TW' ELSE 'zh-CN' END ELSE code END AS chinese FROM v""")
def chinese_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare code for Chinese by the script of what is written."""
    k, n = F.col("doc_id") % 5, (F.col("doc_id") % 40).cast("int")
    simple, full = F.lit(languages.SIMPLIFIED), F.lit(languages.TRADITIONAL)
    content = F.when(k == 0, F.concat(F.left(simple, n), F.left("text", F.lit(50)))).when(k == 1, F.concat(F.left(full, n), "text")).when(k == 2, F.concat(F.left(simple, F.lit(20)), F.left(full, F.lit(20)))).when(k == 3, F.col("text"))
    code = F.element_at(F.array(F.lit("zh"), F.lit("zh-Hant"), F.lit("ZH"), F.lit("en")), (F.col("doc_id") % 4 + 1).cast("int"))
    return C.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), languages.normalize_chinese(code, content).alias("chinese"))


@query(with_("videos") + ", t AS (SELECT video_id, unnest(['en', 'zh-CN', 'de']) AS lang FROM videos), f AS (SELECT unnest(['srt', 'txt']) AS ext) SELECT video_id, 'translated.' || lang || '.' || ext AS file FROM t, f UNION ALL SELECT video_id, 'original.' || original_lang || '.srt' FROM videos WHERE has_original UNION ALL SELECT video_id, 'metadata.json' FROM videos")
def artifact_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file that an item's output has."""
    v = C.videos(spark, sf_dir)
    each = v.select("video_id", F.explode(F.array(*[F.lit(x) for x in ("en", "zh-CN", "de")])).alias("lang")).select("video_id", "lang", F.explode(F.array(F.lit("srt"), F.lit("txt"))).alias("ext"))
    files = each.select("video_id", F.concat(F.lit("translated."), "lang", F.lit("."), "ext").alias("file"))
    return files.unionByName(v.where("has_original").select("video_id", F.concat(F.lit("original."), "original_lang", F.lit(".srt")).alias("file"))).unionByName(v.select("video_id", F.lit("metadata.json").alias("file")))


@query(with_("videos", "tracks") + ", w AS (SELECT video_id, unnest(['en-GB', 'de', 'nl']) AS lang FROM videos) SELECT DISTINCT w.video_id, w.lang FROM w JOIN tracks t ON t.video_id = w.video_id AND t.lang = w.lang WHERE t.fetched AND NOT EXISTS (SELECT 1 FROM videos v WHERE v.video_id = w.video_id AND v.has_original AND w.lang = 'de')")
def official_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official tracks for targets that a result lacks."""
    v = C.videos(spark, sf_dir)
    wanted = v.select("video_id", F.explode(F.array(*[F.lit(x) for x in ("en-GB", "de", "nl")])).alias("lang"))
    return align.supplement(wanted, v.where("has_original").select("video_id", F.lit("de").alias("lang")), C.tracks(spark, sf_dir))


@query("SELECT event_type AS provider, count(*) AS calls, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(user_id % 50)::BIGINT AS completion_tokens, sum(event_id % 100 + user_id % 50)::BIGINT AS total_tokens FROM events GROUP BY event_type")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.struct((F.col("event_id") % 100).alias("prompt"), (F.col("user_id") % 50).alias("completion"))
    return M.token_usage(_events(spark, sf_dir).select(F.col("event_type").alias("provider"), usage.alias("usage")), "provider")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count_if(trim(line) <> '') AS filled, max(length(line)) AS longest, min(octet_length(encode(d.text)))::INT AS bytes FROM l JOIN documents d USING (doc_id) GROUP BY doc_id")
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, filled lines, the longest line and bytes of each text."""
    lines = F.split("text", "\n")
    return C.table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("filled"), F.array_max(F.transform(lines, lambda x: F.length(x).cast("long"))).alias("longest"), F.octet_length("text").alias("bytes"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(ts, '%Y%m%d') AS upload_date, 'batch_' || strftime(ts, '%Y%m%d_%H%M%S') AS archive FROM events")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.date_format("ts", "yyyyMMdd_HHmmss")
    return _events(spark, sf_dir).select("event_id", run.alias("run_id"), F.date_format("ts", "yyyyMMdd").alias("upload_date"), F.concat(F.lit("batch_"), run).alias("archive"))
