"""Queries over URLs, languages, times, names, messages and other scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import errors, languages, texts, urls
from tidemark.operators import monitoring
from tidemark.plans.registry import query
from tidemark.sources import carriers as C
from tidemark.sources.carriers import with_

_KIND = "CASE WHEN contains(lower(url), 'watch?v=') OR contains(lower(url), 'youtu.be/') THEN 'video' WHEN contains(lower(url), 'playlist?list=') THEN 'playlist' WHEN regexp_matches(lower(url), '/c/|/user/|/channel/|/@') THEN 'channel' ELSE 'unknown' END"
_VIDEO, _LIST, _CHANNEL = r"(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]{11})", r"youtube\.com/playlist\?list=([a-zA-Z0-9_-]+)", r"youtube\.com/(?:c/|user/|channel/|@)([^/?]+)"


@query(with_("urls") + f"SELECT page_id, {_KIND} AS url_type, {_KIND} <> 'unknown' AS valid FROM urls")
def url_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = urls.url_type(F.col("url"))
    return C.urls(spark, sf_dir).select("page_id", kind.alias("url_type"), (kind != "unknown").alias("valid"))


@query(with_("urls") + f"SELECT page_id, nullif(regexp_extract(url, '{_VIDEO}', 1), '') AS video_id, nullif(regexp_extract(url, '{_LIST}', 1), '') AS playlist_id, nullif(regexp_extract(url, '{_CHANNEL}', 1), '') AS channel_id FROM urls")
def url_extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return C.urls(spark, sf_dir).select("page_id", urls.video_id(u).alias("video_id"), urls.playlist_id(u).alias("playlist_id"), urls.channel_id(u).alias("channel_id"))


_CODE = f"CASE WHEN trim(url) = '' THEN 'blank' WHEN NOT regexp_matches(url, '(?i)youtube\\.com|youtu\\.be') THEN 'invalid_domain' WHEN NOT (regexp_matches(url, '{_VIDEO}') OR regexp_matches(url, '{_LIST}') OR regexp_matches(url, '{_CHANNEL}')) THEN 'invalid_format' ELSE 'ok' END"


@query(with_("urls") + f"SELECT page_id, {_CODE} AS code FROM urls")
def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.urls(spark, sf_dir).select("page_id", urls.validation_code(F.col("url")).alias("code"))


@query(with_("urls") + f"SELECT {_KIND} AS url_type, count(*) AS n, min(page_id) AS first_page FROM urls GROUP BY 1")
def url_dispatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.urls(spark, sf_dir).groupBy(urls.url_type(F.col("url")).alias("url_type")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(with_("urls") + f", l AS (SELECT page_id // 10 AS list_id, page_id % 10 + 1 AS line, {_CODE} AS code FROM urls) SELECT list_id, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (WHERE code NOT IN ('ok', 'blank')), '') AS bad_lines FROM l GROUP BY list_id")
def url_list_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = C.urls(spark, sf_dir).groupBy(F.expr("page_id div 10").alias("list_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]), "\n").alias("lines"))
    return lists.select("list_id", F.array_join(urls.bad_lines(F.col("lines")).cast("array<string>"), ",").alias("bad_lines"))


@query(with_("urls") + f"SELECT page_id, CASE WHEN {_KIND} = 'channel' THEN 'c' || page_id || '.txt' WHEN {_KIND} = 'playlist' AND regexp_matches(url, '{_LIST}') THEN 'playlist_' || regexp_extract(url, '{_LIST}', 1) || '.txt' END AS archive FROM urls")
def archive_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.urls(spark, sf_dir).select("page_id", urls.archive_key(F.col("url"), F.concat(F.lit("c"), F.col("page_id").cast("string"))).alias("archive"))


_PRIMARY = "lower(regexp_extract({0}, '^[^-_]*', 0))"
_NORMAL = "CASE WHEN lower(code) IN ('zh-cn', 'zh_cn') THEN 'zh-CN' WHEN lower(code) IN ('zh-tw', 'zh_tw') THEN 'zh-TW' ELSE " + _PRIMARY.format("code") + " END"
_MATCH = "({0} = {1} OR (NOT ((replace(lower({0}), '_', '-') = 'zh-cn' AND replace(lower({1}), '_', '-') = 'zh-tw') OR (replace(lower({0}), '_', '-') = 'zh-tw' AND replace(lower({1}), '_', '-') = 'zh-cn')) AND " + _PRIMARY.format("{0}") + " = " + _PRIMARY.format("{1}") + "))"
_MAIN = "string_split(code, '-')[1]"
_NAME = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in languages.NAMES.items()) + " " + " ".join(f"WHEN starts_with('{k}', {_MAIN}) THEN '{v}'" for k, v in languages.NAMES.items()) + " ELSE code END"


@query(with_("lang_codes") + f"SELECT doc_id, {_NORMAL} AS normal, {_PRIMARY.format('code')} AS primary_code, starts_with(lower(code), 'zh') OR lower(code) IN ('cmn', 'yue') AS chinese FROM lang_codes")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    return C.lang_codes(spark, sf_dir).select("doc_id", languages.normalize(c).alias("normal"), languages.primary(c).alias("primary_code"), languages.is_chinese(c).alias("chinese"))


@query(with_("lang_codes") + f"SELECT doc_id, {_NAME} AS name FROM lang_codes")
def lang_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lang_codes(spark, sf_dir).select("doc_id", languages.display_name(F.col("code")).alias("name"))


@query(with_("lang_codes") + f", a AS (SELECT DISTINCT code FROM lang_codes), b AS (SELECT DISTINCT other FROM lang_codes) SELECT code, other FROM a JOIN b ON {_MATCH.format('code', 'other')}")
def lang_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal primary parts as the join's key, the rest of the rule as its residue."""
    codes = C.lang_codes(spark, sf_dir)
    a, b = codes.select("code").distinct(), codes.select("other").distinct()
    return a.join(b, (languages.primary(F.col("code")) == languages.primary(F.col("other"))) & languages.matches(F.col("code"), F.col("other")))


@query(with_("lang_codes") + f", t AS (SELECT doc_id, code, unnest(['it', other, 'zh-CN', 'zh-TW', 'de', 'en-GB', 'fr', 'es']) AS x, generate_subscripts([1,2,3,4,5,6,7,8], 1) AS pos FROM lang_codes) SELECT l.doc_id, (SELECT arg_min(x, pos) FROM t WHERE t.doc_id = l.doc_id AND {_MATCH.format('t.x', 't.code')}) AS found FROM lang_codes l")
def lang_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = F.array(F.lit("it"), F.col("other"), *[F.lit(x) for x in ("zh-CN", "zh-TW", "de", "en-GB", "fr", "es")])
    return C.lang_codes(spark, sf_dir).select("doc_id", languages.first_match(F.col("code"), available).alias("found"))


@query(with_("lang_codes") + r"SELECT doc_id, nullif(regexp_extract('translated.' || code || CASE WHEN doc_id % 2 = 0 THEN '.srt' ELSE '.MD' END, '(?i)\.([a-z]{2}(?:-[A-Z]{2})?)\.(?:srt|md)$', 1), '') AS lang FROM lang_codes")
def lang_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("translated."), F.col("code"), F.when(F.col("doc_id") % 2 == 0, ".srt").otherwise(".MD"))
    return C.lang_codes(spark, sf_dir).select("doc_id", languages.from_filename(name).alias("lang"))


_SAFE = "left(trim(translate({0}, '<>:\"/\\|?*', '_________'), ' .'), 200)"


@query(f"SELECT doc_id, {_SAFE.format('text')} AS name FROM documents")
def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", texts.safe_filename(F.col("text")).alias("name"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_SAFE.format('source')} || ' [' || lang || ']/' END || doc_id || '  ' || {_SAFE.format('text')} AS path FROM documents")
def output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return C.table(spark, sf_dir, "documents").select("doc_id", texts.output_dir(channel, F.col("lang"), F.col("doc_id").cast("string"), F.col("text")).alias("path"))


@query(with_("cues") + "SELECT video_id, pos, start, \"end\", start_ms AS back_ms FROM cues")
def ms_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text, and back."""
    return C.cues(spark, sf_dir).select("video_id", "pos", "start", "end", texts.time_ms(F.col("start")).alias("back_ms"))


@query("SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS time FROM (SELECT event_id, floor((CASE event_id % 5 WHEN 0 THEN 2.3 WHEN 1 THEN 3599.9996 WHEN 2 THEN 0.0 ELSE value * 100 END)::DOUBLE::DECIMAL(18, 6) * 1000)::BIGINT AS ms FROM events)")
def seconds_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds with a fraction as text, the borders of milliseconds and hours included."""
    k = F.col("event_id") % 5
    seconds = F.when(k == 0, 2.3).when(k == 1, 3599.9996).when(k == 2, 0.0).otherwise(F.col("value") * 100)
    return C.table(spark, sf_dir, "events").select("event_id", texts.srt_time_of_seconds(seconds).alias("time"))


_SECONDS = "floor(value * 150)::BIGINT"


@query(f"SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dh %dm', s // 3600, s % 3600 // 60) END AS took FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 59 WHEN 2 THEN 60 WHEN 3 THEN 3599 WHEN 4 THEN 3600 ELSE {_SECONDS} END AS s FROM events)")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, minutes and hours, the borders between them included."""
    k = F.col("event_id") % 9
    s = F.when(k == 0, 0).when(k == 1, 59).when(k == 2, 60).when(k == 3, 3599).when(k == 4, 3600).otherwise(F.floor(F.col("value") * 150))
    return C.table(spark, sf_dir, "events").select("event_id", texts.clock(s).alias("clock"), texts.duration(s).alias("took"))


@query("SELECT doc_id, CASE WHEN n_chars >= 30000 THEN 2000 WHEN n_chars >= 5001 THEN 1500 WHEN n_chars = 5000 THEN 800 WHEN n_chars >= 3000 THEN 500 ELSE 300 END AS min_words, CASE WHEN n_chars >= 30000 THEN 5000 WHEN n_chars >= 5001 THEN 4000 WHEN n_chars = 5000 THEN 1500 WHEN n_chars >= 3000 THEN 1000 ELSE 800 END AS max_words, CASE WHEN n_chars > 15000 THEN 'map_reduce' ELSE 'direct' END AS route FROM documents")
def suggested_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return C.table(spark, sf_dir, "documents").select("doc_id", texts.suggested_length(n).alias("x"), texts.summary_route(n).alias("route")).select("doc_id", "x.*", "route")


@query("SELECT a.l_orderkey AS id, a.l_linenumber AS line, (l_partkey % 3, l_suppkey % 4, l_linenumber) > (1, 2, 3) AS newer FROM lineitem a")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string"), F.lit("."), (F.col("l_suppkey") % 4).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (texts.version(v) > texts.version(F.lit("v1.2.3"))).alias("newer"))


_HIT = lambda words: " OR ".join(f"contains(low, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)
_CLASS = f"""CASE WHEN timed_out THEN 'timeout' WHEN {_HIT(errors.NETWORK)} THEN 'network' WHEN contains(low, 'authentication') AND ({_HIT(("webpage", "without a successful"))}) THEN 'network'
  WHEN contains(stderr, '429') OR {_HIT(("rate limit", "too many requests"))} THEN 'rate_limit' WHEN {_HIT(errors.COOKIE_EXPIRED)} THEN 'cookie_expired' WHEN {_HIT(errors.AUTH)} THEN 'auth'
  WHEN {_HIT(errors.CONTENT)} THEN 'content' WHEN contains(low, 'does not look like a netscape format') OR contains(low, 'cookie') AND contains(low, 'format') THEN 'auth' ELSE 'external_service' END"""
_LOW = "m AS (SELECT *, CASE WHEN length(array_to_string(list_filter(string_split(stderr, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), 'WARNING:')), chr(10))) = 0 THEN lower(stderr) ELSE lower(array_to_string(list_filter(string_split(stderr, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), 'WARNING:')), chr(10))) END AS low FROM messages)"


@query(with_("messages") + f", {_LOW}, c AS (SELECT event_id, {_CLASS} AS error_type FROM m) SELECT event_id, error_type, error_type IN ('network', 'timeout', 'rate_limit', 'external_service', 'unknown') AS retry FROM c")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.messages(spark, sf_dir).select("event_id", errors.classify(F.col("stderr"), F.col("timed_out")).alias("error_type"))
    return found.withColumn("retry", errors.should_retry(F.col("error_type")))


@query(with_("messages") + f", {_LOW}, c AS (SELECT {_CLASS} AS error_type FROM m) SELECT error_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM c GROUP BY error_type")
def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = C.messages(spark, sf_dir).groupBy(errors.classify(F.col("stderr"), F.col("timed_out")).alias("error_type")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()), 9))


@query(with_("videos") + "SELECT video_id, stage NOT IN ('done', 'skipped') AND (stage <> 'failed' OR error_type IS NULL OR error_type NOT IN ('AUTH', 'CONTENT', 'INVALID_INPUT')) AS resumable, stage NOT IN ('done', 'skipped') AND (stage <> 'failed' OR error_type IS NULL OR upper(error_type) NOT IN ('AUTH', 'CONTENT', 'INVALID_INPUT')) AS resumable_any_case FROM videos")
def resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("stage"), F.col("error_type")
    return C.videos(spark, sf_dir).select("video_id", errors.is_resumable(s, e).alias("resumable"), errors.is_resumable(s, e, case_sensitive=False).alias("resumable_any_case"))


_LOG = r"'^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\] \[([A-Z]+)\] \[run:([^\]]*)\] \[task:([^\]]*)\] \[video:([^\]]*)\] (.*)$'"


@query(with_("log_lines") + f"SELECT event_id, regexp_extract(value, {_LOG}, 1) AS ts, regexp_extract(value, {_LOG}, 2) AS level, regexp_extract(value, {_LOG}, 4) AS task, regexp_extract(value, {_LOG}, 5) AS video_id, regexp_extract(value, {_LOG}, 6) AS message FROM log_lines WHERE regexp_matches(value, {_LOG})")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.readers import parse_log

    return parse_log(C.log_lines(spark, sf_dir)).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "task", "video_id", "message")


_RUN, _TOKEN = "[^;\\s&]", "[a-zA-Z0-9\\-_.]"
_MASK = "message"
for _p, _r in (
    ("(sk-[a-zA-Z0-9])[a-zA-Z0-9]{15,}([a-zA-Z0-9]{4})", "\\1***\\2"), ("\\b([a-zA-Z0-9]{4})[a-zA-Z0-9]{24,}([a-zA-Z0-9]{4})\\b", "\\1***\\2"),
    ("(?i)(Cookie:\\s*[^;=\\n]*=)([^;\\n]{4})[^;\\n]+([^;\\n]{3}[^;\\s])[^\\S\\n]*", "\\1\\2***\\3"), ("(?i)(Cookie:\\s*[^;=\\n]*=)(?:[^;\\n]{0,7}[^;\\s])[^\\S\\n]*([;\\n]|$)", "\\1***REDACTED***\\2"),
    (f"(?i)(cookie\\s*=\\s*)({_RUN}{{4}}){_RUN}+({_RUN}{{4}})", "\\1\\2***\\3"), ("(?i)(Authorization:\\s*)(\\S{4})\\S+(\\S{4})", "\\1\\2***\\3"),
    (f"(?i)bearer\\s+({_TOKEN}+)", "Bearer \\1"), (f"Bearer ({_TOKEN}{{4}}){_TOKEN}+({_TOKEN}{{4}})", "Bearer \\1***\\2"), ("(?i)basic\\s+([A-Za-z0-9+/=]{4})[A-Za-z0-9+/=]{12,}([A-Za-z0-9+/=]{4})", "Basic \\1***\\2"),
    *[(f"(?i)([?&]{name}=)([^&\\s]{{2}})[^&\\s]{{5,}}([^&\\s]{{2}})", "\\1\\2***\\3") for name in texts.SECRET_PARAMETERS],
    ("(?i)(password|pwd)\\s*=\\s*[^\\s&]+", "\\1=***REDACTED***"), ("://([^:]+):([^@]+)@", "://\\1:***REDACTED***@"),
):
    _MASK = f"regexp_replace({_MASK}, '{_p}', '{_r}', 'g')"


@query(with_("secrets") + f", m AS (SELECT doc_id, {_MASK} AS masked FROM secrets) SELECT doc_id, CASE WHEN length(masked) > 500 THEN left(masked, 500) || '... [truncated]' ELSE masked END AS masked FROM m")
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.secrets(spark, sf_dir).select("doc_id", texts.mask_secrets(F.col("message")).alias("masked"))


_HAN = f"(length(t) - length(translate(t, '{languages.SIMPLIFIED}', '')))", f"(length(t) - length(translate(t, '{languages.TRADITIONAL}', '')))"


_GREETING = "CASE WHEN doc_id % 5 = {0} THEN 'مرحبا' ELSE '' END"


@query(f"""WITH x AS (SELECT doc_id, {_GREETING.format(0)} || repeat('{languages.SIMPLIFIED}', (doc_id % 3)::INT) || repeat('{languages.TRADITIONAL}', (doc_id % 4)::INT) || text || chr(10) || {_GREETING.format(1)} AS t FROM documents
) SELECT doc_id, CASE WHEN {_HAN[0]} + {_HAN[1]} < 10 THEN 'zh' WHEN {_HAN[0]}::DOUBLE / ({_HAN[0]} + {_HAN[1]}) > 0.7 THEN 'zh-CN' WHEN {_HAN[0]}::DOUBLE / ({_HAN[0]} + {_HAN[1]}) < 0.3 THEN 'zh-TW' ELSE 'zh' END AS variant, (length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')))::INT AS han,
  coalesce(list_bool_or(list_transform(list_filter(string_split(t, chr(10))[1:51], lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '^[0-9]+$') AND NOT contains(l, '-->'))[1:5], lambda l: regexp_matches(l, '[؀-ۿ]'))), false) AS arabic FROM x""")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of whole texts with Chinese before them, and Arabic at their head, at their end, or nowhere."""
    k = F.col("doc_id")
    t = F.concat(F.when(k % 5 == 0, "مرحبا").otherwise(""), F.expr(f"repeat('{languages.SIMPLIFIED}', cast(doc_id % 3 as int))"), F.expr(f"repeat('{languages.TRADITIONAL}', cast(doc_id % 4 as int))"), F.col("text"), F.lit("\n"), F.when(k % 5 == 1, "مرحبا").otherwise(""))
    x = C.table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return x.select("doc_id", languages.chinese_variant(F.col("t")).alias("variant"), languages.count_range(F.col("t"), "一", "鿿").alias("han"), languages.has_arabic(F.col("t")).alias("arabic"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US' WHEN 'de' THEN 'de-DE' WHEN 'fr' THEN 'fr-FR' WHEN 'es' THEN 'es-ES' END AS source, CASE doc_id % 3 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'zh-TW' ELSE 'ja-JP' END AS target, trim(text) AS cue_text FROM documents")
def prompt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt holds can be read back from it: whole texts, and languages by their names."""
    k = F.col("doc_id") % 3
    prompt = texts.translation_prompt(F.col("lang"), F.when(k == 0, "zh").when(k == 1, "zh_TW").otherwise("ja"), F.col("text"))
    made = C.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))
    return made.select("doc_id", texts.prompt_languages(F.col("prompt")).alias("l"), texts.prompt_text(F.col("prompt")).alias("cue_text")).select("doc_id", "l.*", "cue_text")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'U' || (event_id % 10) WHEN 1 THEN 'DE' WHEN 2 THEN 'TW' END AS region, user_id::VARCHAR AS session FROM events")
def cookie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a cookie string; the last of equal names counts, and the region comes from the first place that has one."""
    k = F.col("event_id") % 4
    where = F.when(k == 0, F.concat(F.lit("PREF=f1=5&gl=u"), (F.col("event_id") % 10).cast("string"), F.lit("&hl=x; GL=FR"))).when(k == 1, "PREF=f1=5; gl=de; HL=zh-TW").when(k == 2, "hl=zh-TW").otherwise("none")
    raw = F.concat(F.lit("SID=old; "), where, F.lit("; SID="), F.col("user_id").cast("string"))
    rows = C.table(spark, sf_dir, "events").select("event_id", monitoring.cookie_pairs(raw).alias("_p"))
    return rows.select("event_id", monitoring.cookie_region(F.col("_p")).alias("region"), monitoring.cookie_value(F.col("_p"), "SID").alias("session"))
