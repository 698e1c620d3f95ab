"""Queries over batches of items: progress, chunks, manifests, failures, reports, rotation, profiles, artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import align, batches, cues, outputs, profiles, providers, state
from tidemark.plans.registry import query
from tidemark.plans.structured import BLOCKS_SQL, SHIFTED_SQL, blocks, shifted
from tidemark.sources import carriers as C
from tidemark.sources import readers
from tidemark.sources.carriers import TIME_SQL, with_

_NL = "chr(10)"
_DURATION = "CASE WHEN {0} < 60 THEN printf('%ds', {0}) WHEN {0} < 3600 THEN printf('%dm %ds', {0} // 60, {0} % 60) ELSE printf('%dh %dm', {0} // 3600, {0} % 3600 // 60) END"
_NAMED = "CASE {0} WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' WHEN 'es' THEN 'Español' ELSE {0} END"


# --- progress and chunks ----------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS total, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS elapsed FROM events
), p AS (SELECT a.user_id, a.event_id, count(*) AS n, sum(b.value * (least(a.k, 10) - (a.k - b.k))) AS s FROM w a JOIN w b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 9 AND a.k GROUP BY 1, 2
), r AS (SELECT w.user_id, w.event_id, k, total, elapsed, CASE WHEN n >= 2 THEN s * 2 / (n * (n + 1)) END AS average FROM w JOIN p ON w.user_id = p.user_id AND w.event_id = p.event_id
), e AS (SELECT *, CASE WHEN average IS NULL THEN NULL WHEN total = k THEN 0.0::DOUBLE ELSE average * (total - k) END AS eta FROM r)
SELECT user_id, event_id, k AS completed, total - k AS remaining, round(100.0::DOUBLE * k / total, 6) AS percent, round(elapsed, 6) AS elapsed, round(average, 6) AS average, round(eta, 6) AS eta,
  CASE WHEN eta <= 0 THEN 'almost done' ELSE 'about ' || {_DURATION.format("floor(round(eta, 6))::BIGINT")} || ' left' END AS shown FROM e""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user has done after each event, what is left, and how long that takes."""
    rows = batches.progress(C.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", ["event_id"])
    rounded = [F.round(c, 6).alias(c) for c in ("percent", "elapsed", "average", "eta")]
    return rows.select("user_id", "event_id", "completed", "remaining", *rounded, batches.eta_text(F.col("eta")).alias("shown"))


_CHUNK_EVENTS = """c AS (SELECT DISTINCT l_orderkey AS video_id, l_linenumber AS chunk_index FROM lineitem
), first_line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem
), x AS (
  SELECT l_orderkey AS video_id, l_linenumber AS chunk_index, 1 AS seq, CASE WHEN l_returnflag = 'N' THEN 'failed' ELSE 'completed' END AS kind, 'first ' || l_partkey AS content FROM first_line WHERE r = 1 AND l_partkey % 4 > 0
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'failed', NULL FROM first_line WHERE r = 1 AND l_linestatus = 'F'
  UNION ALL SELECT l_orderkey, l_linenumber, 3, 'completed', 'again ' || l_partkey FROM first_line WHERE r = 1 AND l_partkey % 5 = 0
), g AS (SELECT video_id, chunk_index, bool_or(kind = 'completed') AS done, arg_max(kind, seq) = 'failed' AS bad, arg_max(content, seq) FILTER (WHERE kind = 'completed') AS translated FROM x GROUP BY 1, 2
), p AS (SELECT c.video_id, c.chunk_index, coalesce(done, false) AS is_completed, coalesce(bad, false) AS failed, translated FROM c LEFT JOIN g USING (video_id, chunk_index))"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = C.table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("chunk_index")]
    r = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    one = lines.withColumn("r", r).where("r = 1")
    part = F.col("l_partkey").cast("string")
    e = one.where("l_partkey % 4 > 0").select(*keys, F.lit(1).alias("seq"), F.when(F.col("l_returnflag") == "N", "failed").otherwise("completed").alias("kind"), F.concat(F.lit("first "), part).alias("content"))
    e = e.unionByName(one.where("l_linestatus = 'F'").select(*keys, F.lit(2).alias("seq"), F.lit("failed").alias("kind"), F.lit(None).cast("string").alias("content")))
    e = e.unionByName(one.where("l_partkey % 5 = 0").select(*keys, F.lit(3).alias("seq"), F.lit("completed").alias("kind"), F.concat(F.lit("again "), part).alias("content")))
    return batches.chunk_progress(lines.select(*keys).distinct(), e, ["video_id"])


@query(f"WITH {_CHUNK_EVENTS} SELECT * FROM p")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after completions and failures came in, some of them repeated."""
    return _progress(spark, sf_dir)


@query(f"WITH {_CHUNK_EVENTS} SELECT video_id, chunk_index, failed FROM p WHERE NOT is_completed")
def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that are left when a run is taken up again."""
    return batches.pending_chunks(_progress(spark, sf_dir)).select("video_id", "chunk_index", "failed")


@query(f"""WITH {_CHUNK_EVENTS} SELECT video_id, '{{"total_chunks":' || count(*) || ',"completed_chunks":[' || coalesce(string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) FILTER (WHERE is_completed), '') || '],"failed_chunks":[' || coalesce(string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) FILTER (WHERE failed), '') || ']}}' AS document FROM p GROUP BY video_id""")
def chunk_progress_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.progress_documents(_progress(spark, sf_dir), ["video_id"])


# --- manifests --------------------------------------------------------------------------------------------------------------


_MANIFEST = "m AS (SELECT 'b' || (user_id % 20) AS batch_id, user_id AS video_id, arg_max(event_type, event_id) AS stage, arg_max(CASE WHEN event_type = 'error' THEN 'NETWORK' ELSE '-' END, event_id) AS kind, arg_min(event_id * 7, event_id)::VARCHAR AS started_at, arg_max(event_id * 7, event_id)::VARCHAR AS updated_at FROM events GROUP BY user_id)"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "events").select(F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")).alias("batch_id"), F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.when(F.col("event_type") == "error", "NETWORK").alias("error_type"), (F.col("event_id") * 7).cast("string").alias("at"))
    return batches.manifest(rows)


@query(f"WITH {_MANIFEST} SELECT batch_id, video_id, stage, nullif(kind, '-') AS error_type, started_at, updated_at FROM m")
def manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of batches after all their updates."""
    return _manifest(spark, sf_dir)


@query(f"""WITH {_MANIFEST} SELECT batch_id, '{{"batch_id":"' || batch_id || '","videos":{{' || string_agg('"' || video_id || '":{{"stage":"' || stage || '","error_type":' || CASE WHEN kind = '-' THEN 'null' ELSE '"' || kind || '"' END || ',"started_at":"' || started_at || '","updated_at":"' || updated_at || '"}}', ',' ORDER BY video_id::VARCHAR) || '}}}}' AS document FROM m GROUP BY batch_id""")
def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.manifest_documents(_manifest(spark, sf_dir))


# --- failures ---------------------------------------------------------------------------------------------------------------


_FAILURES = "f AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS made, CASE WHEN event_id % 3 > 0 THEN 'r' || (event_id % 9) END AS batch, user_id::VARCHAR AS video, 'https://youtu.be/' || (user_id % 40) AS url, ['network', 'auth', 'file_io', 'odd'][event_id % 4 + 1] AS kind, 'no ' || event_id AS reason, CASE WHEN event_id % 2 = 0 THEN 'download' END AS stage FROM events)"
_LINE = "'[' || made || ']' || coalesce(' [batch:' || batch || ']', '') || ' [video:' || video || '] ' || url || ' error=' || kind || ' msg=' || reason || coalesce(' stage=' || stage, '')"


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("network", "auth", "file_io", "odd")]), (k % 4 + 1).cast("int"))
    return C.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(k % 3 > 0, F.concat(F.lit("r"), (k % 9).cast("string"))).alias("batch"), F.col("user_id").cast("string").alias("video"), F.concat(F.lit("https://youtu.be/"), (F.col("user_id") % 40).cast("string")).alias("url"), kinds.alias("kind"), F.concat(F.lit("no "), k.cast("string")).alias("reason"), F.when(k % 2 == 0, "download").alias("stage"))


def _line():
    return batches.failure_line(*[F.col(c) for c in ("at", "batch", "video", "url", "kind", "reason", "stage")])


@query(f"WITH {_FAILURES} SELECT event_id, {_LINE} AS line FROM f")
def failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures as lines of the log that people read."""
    return _failures(spark, sf_dir).select("event_id", _line().alias("line"))


@query(f"WITH {_FAILURES} SELECT DISTINCT url FROM f WHERE url NOT IN (SELECT 'https://youtu.be/' || (doc_id * 3) FROM labels)")
def failure_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses for the list of failed ones, once each and only new ones."""
    known = C.table(spark, sf_dir, "labels").select(F.concat(F.lit("https://youtu.be/"), (F.col("doc_id") * 3).cast("string")).alias("url"))
    return batches.new_failed_urls(_failures(spark, sf_dir), known)


@query(f"""WITH {_FAILURES} SELECT event_id, CASE WHEN bad = 0 THEN made END AS "at", CASE WHEN bad = 0 THEN batch END AS batch, CASE WHEN bad = 0 THEN video END AS video, CASE WHEN bad = 0 THEN url END AS url,
  CASE bad WHEN 0 THEN kind WHEN 1 THEN 'timeout' END AS error_type, CASE WHEN bad = 0 THEN reason || coalesce(' stage=' || stage, '') END AS message, bad = 0 AS parsed FROM (SELECT *, CASE event_id % 10 WHEN 3 THEN 1 WHEN 6 THEN 2 WHEN 9 THEN 3 ELSE 0 END AS bad FROM f) WHERE bad <> 3""")
def failure_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines read back, among lines of another form and blank ones."""
    k = F.col("event_id") % 10
    value = F.when(k == 3, "something error=timeout happened").when(k == 6, "no form at all").when(k == 9, "   ").otherwise(_line())
    return batches.parse_failures(_failures(spark, sf_dir).select("event_id", value.alias("value")))


_NAMES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in batches.ERROR_NAMES.items()) + " ELSE 'unknown error' END"


@query(f"WITH {_FAILURES} SELECT event_id, '[' || {_NAMES} || '] ' || video || ' - ' || reason AS shown, event_id % 5 > 0 AS recorded FROM f")
def failure_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each failure; dry runs record none."""
    info = batches.failure_info(F.col("video"), F.col("kind"), F.col("reason"), F.col("event_id") % 5 == 0)
    return _failures(spark, sf_dir).select("event_id", info.alias("i")).select("event_id", "i.*")


@query(f"WITH {_FAILURES} SELECT kind AS error_type, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, kind))::INT AS rank FROM f GROUP BY kind")
def error_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.ranked_errors(_failures(spark, sf_dir).select(F.col("kind").alias("error_type")))


@query(with_("cues") + SHIFTED_SQL + ", w AS (SELECT video_id, list(pos || ': ' || problem ORDER BY pos) AS l FROM p WHERE problem IS NOT NULL GROUP BY video_id) SELECT video_id, len(l) AS n, l[1:3] AS shown FROM w")
def timeline_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three problems of each file's times."""
    return batches.first_warnings(state.timeline_problems(shifted(spark, sf_dir), ["video_id"]), ["video_id"])


# --- proxies ----------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT event_id // 5 AS request, event_id % 5 AS attempt, 'p' || user_id AS proxy, value > 60 AS ok, event_id % 7 > 0 AS retryable FROM events WHERE event_id % 5 < 3
), s AS (SELECT request, coalesce(min(attempt) FILTER (WHERE ok OR NOT retryable), max(attempt)) AS last FROM a GROUP BY request)
SELECT request, CASE WHEN ok THEN 'done' WHEN retryable THEN 'exhausted' ELSE 'refused' END AS outcome, (last + 1)::INT AS attempts, proxy,
  coalesce((SELECT list(b.proxy ORDER BY b.attempt) FROM a b WHERE b.request = s.request AND b.attempt <= s.last AND NOT b.ok AND b.retryable), []) AS failed FROM s JOIN a USING (request) WHERE attempt = last""")
def proxy_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that go from proxy to proxy, three attempts at most; an error that no retry helps ends them."""
    k = F.col("event_id")
    rows = C.table(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("request"), (k % 5).alias("attempt"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("proxy"), (F.col("value") > 60).alias("ok"), (k % 7 > 0).alias("retryable"))
    return batches.rotation(rows, ["request"])


# --- reports ----------------------------------------------------------------------------------------------------------------


_URL = "'https://youtu.be/' || doc_id"


@query(f"""WITH d AS (SELECT source, doc_id, {_URL} AS url, coalesce(n_chars > 1000, false) AS has FROM documents), t AS (SELECT source, count(*) AS total FROM d GROUP BY source)
SELECT d.source, CASE WHEN has THEN 'with_subtitle.txt' ELSE 'without_subtitle.txt' END AS file, {_NL} || '# 2024-01-01 | Channel: ' || d.source || ' [UC1] | Count: ' || max(total) || {_NL} || '# ' || CASE WHEN has THEN 'With' ELSE 'Without' END || ' subtitles (' || count(*) || ')' || {_NL} || {_NL} || string_agg(url, {_NL} ORDER BY doc_id) || {_NL} || '# ' || repeat('=', 80) || {_NL} || {_NL} AS content
FROM d JOIN t ON d.source = t.source GROUP BY d.source, has""")
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of documents with and without long texts, per source."""
    items = C.table(spark, sf_dir, "documents").where("source is not null").select("source", F.col("doc_id").alias("pos"), F.concat(F.lit("https://youtu.be/"), F.col("doc_id").cast("string")).alias("url"), F.coalesce(F.col("n_chars") > 1000, F.lit(False)).alias("has_subtitles"))
    line = batches.header(F.lit("2024-01-01"), F.col("source"), F.lit("UC1"), F.lit(None).cast("string"), F.col("total"))
    return batches.detection_report(items, "source", line)


@query(f"SELECT source, {_NL} || '# 2024-01-01 | Source: ' || source || ' | Count: ' || count(*) || {_NL} || string_agg({_URL}, {_NL} ORDER BY doc_id) || {_NL} || '# ' || repeat('=', 60) || {_NL} AS content FROM documents WHERE source IS NOT NULL GROUP BY source")
def video_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = C.table(spark, sf_dir, "documents").where("source is not null").select("source", F.col("doc_id").alias("pos"), F.concat(F.lit("https://youtu.be/"), F.col("doc_id").cast("string")).alias("url"))
    none = F.lit(None).cast("string")
    return batches.url_list(items, "source", batches.header(F.lit("2024-01-01"), none, none, F.col("source"), F.count("*")))


_LOGS = "['app_a.log', 'app.log.3', 'other.log', 'app_b.txt']"


@query(f"SELECT event_id, {_LOGS}[event_id % 4 + 1] AS name FROM events WHERE event_id % 4 < 2 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 14 DAYS")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the log that are old enough to go."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("app_a.log", "app.log.3", "other.log", "app_b.txt")]), (F.col("event_id") % 4 + 1).cast("int"))
    files = C.table(spark, sf_dir, "events").select("event_id", name.alias("name"), F.col("ts").alias("modified"))
    return readers.outdated(files, F.expr("timestamp_ntz '2024-01-20 00:00:00'")).select("event_id", "name")


# --- prompts ----------------------------------------------------------------------------------------------------------------


_RANGE = "CASE WHEN {0} >= 30000 THEN '2000-5000' WHEN {0} >= 5001 THEN '1500-4000' WHEN {0} = 5000 THEN '800-1500' WHEN {0} >= 3000 THEN '500-1000' ELSE '300-800' END"
_TITLE = f"CASE WHEN doc_id % 2 = 0 THEN 'Title: t' || doc_id || {_NL} ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, {_NAMED.format("lang")} AS name, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5('Summarise the subtitles in ' || name || ', in ' || {_RANGE.format("length(t)")} || ' words, as Markdown, complete first of all.' || {_NL} || {_TITLE} || 'Subtitles:' || {_NL} || t) AS summary,
  md5('Summarise part 2/3 of the subtitles in ' || name || ', in 200-500 words, without a heading.' || {_NL} || 'Subtitles:' || {_NL} || t) AS part,
  md5('Merge the summaries of all parts in ' || name || ', in ' || {_RANGE.format("length(t) * 9")} || ' words, as Markdown, complete first of all.' || {_NL} || {_TITLE} || 'Subtitles:' || {_NL} || t) AS merged,
  md5('Translate the subtitles from ' || name || ' to ' || CASE WHEN doc_id % 3 = 0 THEN '繁体中文' WHEN doc_id % 3 = 1 THEN '简体中文' ELSE 'Français' END || '. Keep numbers and times.' || {_NL} || 'Subtitles:' || {_NL} || t) AS translation FROM d""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the four prompts over whole texts."""
    k, lang, t = F.col("doc_id"), F.col("lang"), F.coalesce("text", F.lit(""))
    title = F.when(k % 2 == 0, F.concat(F.lit("t"), k.cast("string")))
    target = F.when(k % 3 == 0, "zh-TW").when(k % 3 == 1, "zh").otherwise("fr")
    made = {"summary": texts.summary_prompt(lang, t, title), "part": texts.part_prompt(lang, t, F.lit(2), F.lit(3)), "merged": texts.merge_prompt(lang, t, title, F.length(t) * 9), "translation": texts.translation_prompt(lang, target, t)}
    return C.table(spark, sf_dir, "documents").select("doc_id", *[F.md5(p).alias(name) for name, p in made.items()])


# --- files ------------------------------------------------------------------------------------------------------------------


@query(BLOCKS_SQL + f"SELECT video_id, string_agg((part + 1) || {_NL} || {TIME_SQL.format('start_ms')} || ' --> ' || {TIME_SQL.format('end_ms')} || {_NL} || text || {_NL}, {_NL} ORDER BY part) AS content FROM blocks GROUP BY video_id")
def blocks_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged blocks as a file, with the times of the blocks."""
    return blocks(spark, sf_dir).groupBy("video_id").agg(cues.render_blocks(F.array_sort(F.collect_list(F.struct("part", "start_ms", "end_ms", "text")))).alias("content"))


@query(with_("cues") + f"SELECT video_id, string_agg(pos || {_NL} || start || ' --> ' || \"end\" || {_NL} || replace(text, 'e', 'E') || {_NL}, {_NL} ORDER BY pos) AS content FROM cues GROUP BY video_id")
def vtt_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web files whose cues a provider translates, as plain files."""
    return providers.translate_cues(C.vtt_files(spark, sf_dir), ["video_id"], "vtt", "mark", lambda c: cues.parse_for_merge(cues.vtt_to_srt(c)))


@query(BLOCKS_SQL + "SELECT video_id, part + 1 AS block_no, replace(text, 'e', 'E') AS text FROM blocks")
def block_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks translated by a provider, one call a block, and put back by their marks."""
    rows = blocks(spark, sf_dir).select("video_id", (F.col("part") + 1).cast("int").alias("block_no"), "text")
    return align.apply_blocks(rows, providers.translate_blocks(rows, ["video_id"], "mark"))


@query(with_("cues", "srt_files") + f""", t AS (SELECT video_id, string_agg(text, {_NL} || {_NL} ORDER BY pos) AS txt, string_agg(pos || {_NL} || start || ' --> ' || "end" || {_NL} || text || {_NL} || replace(text, 'e', 'E') || {_NL}, {_NL} ORDER BY pos) AS both_srt, string_agg(text || {_NL} || replace(text, 'e', 'E'), {_NL} || {_NL} ORDER BY pos) AS both_txt FROM cues GROUP BY video_id
), a AS (
  SELECT video_id, 'original.en.srt' AS file, content FROM srt_files UNION ALL SELECT video_id, 'original.en.txt', txt FROM t
  UNION ALL SELECT video_id, 'translated.de.srt', replace(content, 'e', 'E') FROM srt_files UNION ALL SELECT video_id, 'translated.de.txt', replace(txt, 'e', 'E') FROM t
  UNION ALL SELECT video_id, 'bilingual.en-de.srt', both_srt FROM t UNION ALL SELECT video_id, 'bilingual.en-de.txt', both_txt FROM t
  UNION ALL SELECT video_id, 'summary.de.md', '# ' || video_id FROM t WHERE video_id % 2 = 0 UNION ALL SELECT video_id, 'metadata.json', '{{}}' FROM t
) SELECT video_id, file, md5(content) AS content FROM a""")
def artifact_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that an item's output holds, with its content's digest."""
    files = C.srt_files(spark, sf_dir).select("video_id", F.lit("en").alias("lang"), "content", F.lit("de").alias("summary_lang"), F.when(F.col("video_id") % 2 == 0, F.concat(F.lit("# "), F.col("video_id").cast("string"))).alias("summary"), F.lit("{}").alias("metadata"))
    return outputs.artifacts(files.select("video_id"), files, ["de"], lambda c, _: F.replace(c, F.lit("e"), F.lit("E"))).withColumn("content", F.md5("content"))


@query(with_("videos") + """SELECT video_id, '{"tool_version":"1","run_id":"r","generated_at":"2024-01-01","video":{"video_id":' || video_id || ',"url":"u' || video_id || '","title":null},"detection":{"has_subtitles":' || has_original || ',"manual_languages":["' || original_lang || '"],"auto_languages":[]},"language_config":{"ui_language":"zh-CN","subtitle_target_languages":["' || lower(regexp_extract(original_lang, '^[^-_]*', 0)) || '"],"summary_language":"zh-CN","bilingual_mode":"none","translation_strategy":"OFFICIAL_AUTO_THEN_AI","subtitle_format":"srt","source_language":null},"translation_ai":' || CASE WHEN stage = 'done' THEN '{"provider":"mark","model":"m"}' ELSE 'null' END || ',"summary_ai":null,"files":{"original":' || CASE WHEN has_original THEN '"original.srt"' ELSE 'null' END || ',"translated":{"de":"translated.de.srt"},"summary":null}}' AS document FROM videos""")
def metadata_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole metadata document per item, with nulls written out."""
    none, lang = F.lit(None).cast("string"), F.col("original_lang")
    config = profiles.language_config(F.concat(F.lit('{"target_languages":["'), lang, F.lit('"]}')))
    detection = F.struct(F.col("has_original").alias("has_subtitles"), F.array(lang).alias("manual_languages"), F.array().cast("array<string>").alias("auto_languages"))
    ai = F.when(F.col("stage") == "done", F.struct(F.lit("mark").alias("provider"), F.lit("m").alias("model")))
    files = F.struct(F.when(F.col("has_original"), "original.srt").alias("original"), F.create_map(F.lit("de"), F.lit("translated.de.srt")).alias("translated"), none.alias("summary"))
    video = F.struct("video_id", F.concat(F.lit("u"), F.col("video_id").cast("string")).alias("url"), none.alias("title"))
    return C.videos(spark, sf_dir).select("video_id", outputs.metadata_document(video, F.lit("r"), F.lit("2024-01-01"), detection, config, ai, none, files).alias("document"))


# --- profiles and configurations --------------------------------------------------------------------------------------------


def _profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    json = F.concat(F.lit('{"profiles":{"fast":{"provider":"p'), (k % 3).cast("string"), F.lit('","model":"m'), k.cast("string"), F.lit('","base_url":""},"off":{"enabled":false,"model":"x","max_retries":7,"api_key_env":"K"}},"task_mapping":{"translate":"fast","summarize":"off","other":"gone"}}'))
    return C.table(spark, sf_dir, "documents").select("doc_id", F.when(k % 11 == 0, "{broken").otherwise(json).alias("json"))


@query("SELECT doc_id, name, name = 'fast' AS enabled, CASE name WHEN 'fast' THEN 'p' || (doc_id % 3) ELSE 'openai' END AS provider, CASE name WHEN 'fast' THEN 'm' || doc_id ELSE 'x' END AS model, CASE name WHEN 'fast' THEN 2 ELSE 7 END AS max_retries, NULL::VARCHAR AS base_url, CASE name WHEN 'off' THEN 'env:K' END AS anthropic_key FROM documents, (VALUES ('fast'), ('off')) n(name) WHERE doc_id % 11 <> 0")
def ai_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of JSON documents, some broken, with defaults and an old key field."""
    rows = profiles.profiles(_profile_documents(spark, sf_dir))
    return rows.select("doc_id", "name", "enabled", "config.provider", "config.model", "config.max_retries", "config.base_url", F.col("config.api_keys")["anthropic"].alias("anthropic_key"))


@query("SELECT doc_id, task, CASE WHEN task = 'translate' AND doc_id % 11 <> 0 THEN 'm' || doc_id WHEN doc_id % 2 = 0 THEN 'fallback' END AS model FROM documents, (VALUES ('translate'), ('summarize'), ('other'), ('none')) t(task)")
def task_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of each task: of its enabled profile, else the fallback."""
    documents = _profile_documents(spark, sf_dir)
    tasks = documents.select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("translate", "summarize", "other", "none")])).alias("task"), F.when(F.col("doc_id") % 2 == 0, "fallback").alias("fallback"))
    return profiles.resolve(tasks, profiles.task_profiles(documents), profiles.profiles(documents), ["doc_id"])


@query("""SELECT doc_id, '{"ui_language":"' || CASE WHEN doc_id % 2 = 0 THEN 'zh-TW' ELSE 'zh-CN' END || '","subtitle_target_languages":["' || lang || '"],"summary_language":"zh-CN","bilingual_mode":"' || CASE WHEN doc_id % 3 = 0 THEN 'source+target' ELSE 'none' END || '","translation_strategy":"OFFICIAL_AUTO_THEN_AI","subtitle_format":"srt"' || CASE WHEN doc_id % 3 = 1 THEN ',"source_language":"en"' ELSE '' END || '}' AS document FROM documents""")
def language_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations decoded, with old field names and defaults, and encoded again."""
    k = F.col("doc_id")
    json = F.concat(F.lit("{"), F.when(k % 2 == 0, '"ui_language":"zh_tw",').otherwise(""), F.when(k % 3 == 0, '"bilingual_mode":"source+target",').when(k % 3 == 1, '"source_language":"en-US",').otherwise(""), F.when(k % 5 == 0, '"subtitle_').otherwise('"'), F.lit('target_languages":["'), F.upper("lang"), F.lit('-x"]}'))
    return C.table(spark, sf_dir, "documents").select("doc_id", profiles.config_json(profiles.language_config(json)).alias("document"))


_BASES = ("http://LOCALHOST:11434/v1", "https://api.example.com", "http://127.0.0.1/v1", None, "", "http://[::1]:80", "http://0.0.0.0", "http://10.0.0.1")


@query("SELECT event_id, event_id % 8 IN (0, 2, 5, 6) AS local FROM events")
def local_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.element_at(F.array(*[F.lit(b) for b in _BASES]), (F.col("event_id") % 8 + 1).cast("int"))
    return C.table(spark, sf_dir, "events").select("event_id", profiles.is_local(base).alias("local"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id || ' of ' || event_type WHEN 1 THEN 'no names' WHEN 2 THEN '{user} and {gone}' WHEN 3 THEN 'open { brace' ELSE event_type || event_type END AS shown FROM events")
def message_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their names filled in; those that cannot be come back as they are."""
    templates = ("{user} of {kind}", "no names", "{user} and {gone}", "open { brace", "{kind}{kind}")
    template = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("event_id") % 5 + 1).cast("int"))
    return C.table(spark, sf_dir, "events").select("event_id", profiles.formatted(template, {"user": F.col("user_id").cast("string"), "kind": F.col("event_type")}).alias("shown"))


@query(with_("tracks") + ", o AS (SELECT video_id, lang, row_number() OVER (PARTITION BY video_id ORDER BY is_auto, pos) AS k FROM tracks) SELECT video_id, lang FROM o WHERE k = 1")
def translation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first manual track's language, else the first automatic one's."""
    ordered = lambda auto: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_auto") == auto, F.struct("pos", "lang")))), lambda x: x["lang"])
    lists = C.tracks(spark, sf_dir).groupBy("video_id").agg(ordered(False).alias("manual"), ordered(True).alias("auto"))
    return lists.select("video_id", align.first_listed(F.col("manual"), F.col("auto")).alias("lang"))
