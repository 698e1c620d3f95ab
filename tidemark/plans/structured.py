"""Queries over cues, joins, ordered folds, state and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import errors
from tidemark.operators import align, cues, folds, monitoring, state
from tidemark.plans.registry import query
from tidemark.sources import carriers as C
from tidemark.sources.carriers import with_

_NL = "chr(10)"


# --- chunks, blocks, slices -----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations
), f AS (
  SELECT conv_id, i, 0 AS part, 1 AS k, n AS chars FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN f.k >= 5 OR f.chars + t.n > 800 THEN f.part + 1 ELSE f.part END, CASE WHEN f.k >= 5 OR f.chars + t.n > 800 THEN 1 ELSE f.k + 1 END, CASE WHEN f.k >= 5 OR f.chars + t.n > 800 THEN t.n ELSE f.chars + t.n END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1
)
SELECT f.conv_id, part, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns, sum(n)::BIGINT AS chars FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i GROUP BY f.conv_id, part""")
def chunk_split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in greedy chunks of at most five turns and 800 characters."""
    turns = C.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.length("text").alias("n"))
    parts = folds.chunk_parts(turns, ["conv_id"], "n", 5, 800)
    return parts.groupBy("conv_id", "part").agg(F.min("pos").alias("first_turn"), F.max("pos").alias("last_turn"), F.count("*").alias("turns"), F.sum("n").alias("chars"))


_ENTRY = f"length(pos || {_NL} || start || ' --> ' || \"end\" || {_NL} || text || {_NL} || {_NL})"


def _fold_sql(new: str, first: str, step: str, columns: str) -> str:
    return f"""f AS (
  SELECT video_id, pos, 0 AS part, {first} FROM e WHERE pos = 1
  UNION ALL
  SELECT e.video_id, e.pos, CASE WHEN {new} THEN f.part + 1 ELSE f.part END, {step.replace("NEW", new)} FROM f JOIN e ON e.video_id = f.video_id AND e.pos = f.pos + 1
), parts AS (SELECT e.*, f.part FROM f JOIN e ON e.video_id = f.video_id AND e.pos = f.pos) {columns}"""


@query(with_("cues") + f", e AS (SELECT *, {_ENTRY} AS size FROM cues), " + _fold_sql("(f.k >= 20 OR f.chars + e.size > 1500)", "1 AS k, size AS chars", "CASE WHEN NEW THEN 1 ELSE f.k + 1 END, CASE WHEN NEW THEN e.size ELSE f.chars + e.size END", "SELECT video_id, part, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, sum(size)::BIGINT AS chars FROM parts GROUP BY video_id, part"))
def chunk_split_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in chunks of at most 20 cues and 1500 characters, counted as the cues are written."""
    size = F.length(F.concat(F.col("pos").cast("string"), F.lit("\n"), "start", F.lit(" --> "), "end", F.lit("\n"), "text", F.lit("\n\n")))
    parts = folds.chunk_parts(C.cues(spark, sf_dir).select("video_id", "pos", size.alias("size")), ["video_id"], "size", 20, 1500)
    return parts.groupBy("video_id", "part").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), F.sum("size").alias("chars"))


BLOCKS_SQL = with_("cues") + f", e AS (SELECT *, right(trim(text), 1) IN ('。','！','？','.','!','?','；',';','：') AS ended FROM cues), " + _fold_sql("(e.start_ms - f.last_end > 1200 OR f.ended OR f.chars + length(e.text) > 300)", "length(text) AS chars, end_ms AS last_end, ended", "CASE WHEN NEW THEN length(e.text) ELSE f.chars + 1 + length(e.text) END, e.end_ms, e.ended", ", blocks AS (SELECT video_id, part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, trim(string_agg(text, ' ' ORDER BY pos)) AS text, count(*) AS n_cues FROM parts GROUP BY video_id, part) ")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = folds.block_parts(C.cues(spark, sf_dir).select("video_id", "pos", "text", "start_ms", "end_ms"), ["video_id"], most_chars=300)
    return folds.merge_blocks(parts, ["video_id"])


@query(BLOCKS_SQL + "SELECT video_id, part, start_ms, end_ms, text, n_cues FROM blocks")
def cue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues merged to blocks at gaps, sentence ends and 300 characters."""
    return blocks(spark, sf_dir)


@query(BLOCKS_SQL + f"SELECT video_id, string_agg('[BLOCK_' || (part + 1) || ']' || {_NL} || text, {_NL} || {_NL} ORDER BY part) AS marked FROM blocks GROUP BY video_id")
def block_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks behind their marks, in order."""
    return align.marked(blocks(spark, sf_dir).select("video_id", (F.col("part") + 1).alias("block_no"), "text"))


@query(BLOCKS_SQL + "SELECT video_id, part + 1 AS block_no, CASE WHEN part % 3 = 2 THEN text ELSE replace(text, 'e', 'E') END AS text FROM blocks")
def block_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A translation of two blocks in three, put back by its marks; each third block keeps its text."""
    rows = blocks(spark, sf_dir).select("video_id", (F.col("part") + 1).cast("int").alias("block_no"), "text")
    answer = align.marked(rows.where("block_no % 3 != 0").withColumn("text", F.replace("text", F.lit("e"), F.lit("E")))).withColumnRenamed("marked", "answer")
    return align.apply_blocks(rows, answer)


@query("SELECT doc_id, i AS slice, substr(text, i * 1000 + 1, 1000) AS part FROM documents, range(0, 100000) r(i) WHERE i * 1000 < length(text)")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in slices of 1000 code points."""
    return C.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(folds.text_slices(F.col("text"), 1000)).alias("slice", "part")).select("doc_id", F.col("slice").cast("long").alias("slice"), "part")


@query(with_("cues") + r""", s AS (SELECT video_id, pos, text, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS i FROM cues
), c AS (
  SELECT video_id, i AS split_at, 1.0::DOUBLE - abs(i - n // 2)::DOUBLE / (least(n - 1, n * 3 // 4) - greatest(1, n // 4) + 1)::DOUBLE + CASE WHEN regexp_matches(text, '[.!?。！？][\s"''）\]}]*$') THEN 2.0::DOUBLE WHEN regexp_matches(text, '[,;:，；：、][\s"''）\]}]*$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM s WHERE n >= 2 AND i >= greatest(1, n // 4) AND i <= least(n - 1, n * 3 // 4)
), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, split_at) AS k FROM c)
SELECT video_id, split_at, score FROM r WHERE k = 1""")
def split_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.split_points(C.cues(spark, sf_dir), ["video_id"])


# --- files ----------------------------------------------------------------------------------------------------------------


@query(with_("cues", "srt_files") + "SELECT video_id, content FROM srt_files")
def srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("index"), "start", "end", "text")))
    return C.cues(spark, sf_dir).groupBy("video_id").agg(cues.render(ordered).alias("content"))


@query(with_("cues") + "SELECT video_id, pos AS index, start, \"end\", text FROM cues")
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is rendered parses back to the same cues."""
    return C.srt_files(spark, sf_dir).select("video_id", F.inline(cues.parse_for_merge(F.col("content"))))


@query(with_("cues") + f"SELECT video_id, string_agg(text, {_NL} || {_NL} ORDER BY pos) AS txt, string_agg(text, ' ' ORDER BY pos) AS plain FROM cues GROUP BY video_id")
def srt_to_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = C.srt_files(spark, sf_dir)
    return files.select("video_id", cues.to_text(cues.parse_for_output(F.col("content"))).alias("txt"), cues.plain_text(F.col("content")).alias("plain"))


@query(with_("cues", "srt_files") + "SELECT video_id, content FROM srt_files")
def vtt_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web files with notes and settings, made from the cues, give the plain files back."""
    files = C.vtt_files(spark, sf_dir)
    return files.select("video_id", cues.to_srt(F.col("vtt")).alias("content"))


@query(with_("cues", "srt_files") + "SELECT video_id, content FROM srt_files")
def json3_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two segments each, and one without, give the plain files back."""
    event = lambda c: F.struct(c["start_ms"].alias("tStartMs"), (c["end_ms"] - c["start_ms"]).alias("dDurationMs"), F.array(F.struct(F.left(c["text"], F.lit(3)).alias("utf8")), F.struct(F.substring(c["text"], F.lit(4), F.length(c["text"])).alias("utf8"))).alias("segs"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start_ms", "end_ms", "text")))
    files = C.cues(spark, sf_dir).groupBy("video_id").agg(F.to_json(F.struct(F.transform(ordered, event).alias("events"))).alias("json"))
    return files.select("video_id", cues.to_srt(F.col("json")).alias("content"))


@query(with_("cues", "srt_files") + "SELECT video_id, content FROM srt_files")
def srv3_to_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("d"), escaped.alias("text"))))
    body = F.array_join(F.transform(ordered, lambda c: F.concat(F.lit('<p t="'), c["start_ms"].cast("string"), F.lit('" d="'), c["d"].cast("string"), F.lit('">'), c["text"], F.lit("</p>"))), "\n")
    files = C.cues(spark, sf_dir).groupBy("video_id").agg(F.concat(F.lit('<?xml version="1.0"?><timedtext>'), body, F.lit("</timedtext>")).alias("xml"))
    return files.select("video_id", cues.to_srt(F.col("xml")).alias("content"))


_HEADS = (
    ("  WEBVTT\n\n", "vtt"), ('{"events": [], "x": 1}', "json3"), ("<?xml version='1.0'?>", "srv3"), ("a<transcript>", "srv3"), ("1\n00:00:01,000 --> 00:00:02,000\n", "srt"), ("{no json ", None),
    ("WEB VTT\n", None), ('{"other": 1}', None), ("one\n00:00:01,000 --> 00:00:02,000\n", None), ("12\nno time\n", None), ('x <p t="1" d="2">', "srv3"), (" 7 \n00:00:01.000 --> 00:00:02.000\n", "srt"),
)


@query("SELECT doc_id, [" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in _HEADS) + f"][doc_id % {len(_HEADS)} + 1] AS format FROM documents")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by their heads, and heads that only look like one, before whole texts."""
    json = F.array(*[F.lit(h.startswith("{")) for h, _ in _HEADS])
    at = (F.col("doc_id") % len(_HEADS) + 1).cast("int")
    content = F.concat(F.element_at(F.array(*[F.lit(h) for h, _ in _HEADS]), at), F.when(F.element_at(json, at), "").otherwise(F.coalesce("text", F.lit(""))))
    return C.table(spark, sf_dir, "documents").select("doc_id", cues.detect_format(content).alias("format"))


@query(with_("cues") + f", r AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS n, start, \"end\", text FROM cues WHERE pos % 3 <> 0) SELECT video_id, string_agg(n || {_NL} || start || ' --> ' || \"end\" || {_NL} || text || {_NL}, {_NL} ORDER BY n) AS content FROM r GROUP BY video_id")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("index"), "start", "end", "text")))
    files = C.cues(spark, sf_dir).where("pos % 3 != 0").groupBy("video_id").agg(cues.render(ordered).alias("content"))
    return files.select("video_id", cues.render(cues.renumbered(cues.parse_for_output(F.col("content")))).alias("content"))


SHIFTED_SQL = ", s AS (SELECT video_id, pos, CASE WHEN pos % 9 = 0 THEN end_ms + 5 WHEN pos % 7 = 0 THEN start_ms - 700 ELSE start_ms END AS start_ms, end_ms FROM cues), l AS (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY pos) AS before FROM s), p AS (SELECT video_id, pos, start_ms, end_ms, CASE WHEN start_ms >= end_ms THEN 'inverted' WHEN before > 0 AND start_ms < before THEN 'overlap' END AS problem FROM l)"


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues some of which are inverted or overlap the one before."""
    start = F.when(F.col("pos") % 9 == 0, F.col("end_ms") + 5).when(F.col("pos") % 7 == 0, F.col("start_ms") - 700).otherwise(F.col("start_ms"))
    return C.cues(spark, sf_dir).select("video_id", "pos", start.alias("start_ms"), "end_ms")


@query(with_("cues") + SHIFTED_SQL + " SELECT * FROM p WHERE problem IS NOT NULL")
def timeline_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.timeline_problems(shifted(spark, sf_dir), ["video_id"])


@query(with_("cues") + "SELECT video_id, count(*)::INT AS arrows, CASE video_id % 4 WHEN 0 THEN true WHEN 1 THEN count(*) = 1 WHEN 2 THEN false ELSE true END AS complete, video_id % 4 IN (0, 1) AS valid FROM cues GROUP BY video_id")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many arrows in a translation as in its source: whole ones, ones cut to the first cue, blank ones, ones without numbers."""
    k, upper = F.col("video_id") % 4, F.upper("content")
    translated = F.when(k == 0, upper).when(k == 1, F.regexp_extract(upper, r"(?s)^(.*?-->[^\n]*\n)", 1)).when(k == 2, " ").otherwise(F.regexp_replace(upper, r"(?m)^\d+\n", ""))
    files = C.srt_files(spark, sf_dir).select("video_id", "content", translated.alias("translated"))
    return files.select("video_id", F.regexp_count("content", F.lit("-->")).alias("arrows"), cues.is_complete(F.col("content"), F.col("translated")).alias("complete"), cues.is_valid(F.col("translated")).alias("valid"))


# --- joins and priorities ---------------------------------------------------------------------------------------------------


_TARGET = f", target AS (SELECT video_id, pos, start, \"end\", replace(text, 'e', 'E') AS text FROM cues WHERE pos % 4 <> 0 UNION ALL SELECT video_id, pos + 100000, start, \"end\", 'again ' || pos FROM cues WHERE pos % 10 = 1), last AS (SELECT video_id, start, \"end\", arg_max(text, pos) AS other FROM target GROUP BY ALL), b AS (SELECT c.video_id, c.pos, c.start, c.\"end\", CASE WHEN other IS NULL THEN c.text ELSE c.text || {_NL} || other END AS text, other IS NOT NULL AS matched FROM cues c LEFT JOIN last l ON c.video_id = l.video_id AND c.start = l.start AND c.\"end\" = l.\"end\") "


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = C.cues(spark, sf_dir).select("video_id", "pos", "start", "end", "text")
    again = source.where("pos % 10 = 1").select("video_id", (F.col("pos") + 100000).alias("pos"), "start", "end", F.concat(F.lit("again "), F.col("pos").cast("string")).alias("text"))
    return source, source.where("pos % 4 != 0").withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))).unionByName(again)


@query(with_("cues") + _TARGET + "SELECT * FROM b")
def bilingual_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.bilingual(*_targets(spark, sf_dir))


@query(with_("cues") + _TARGET + f"SELECT video_id, string_agg(text, {_NL} || {_NL} ORDER BY pos) AS text FROM b GROUP BY video_id")
def bilingual_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.bilingual_text(*_targets(spark, sf_dir))


_PRIM = "lower(regexp_extract({0}, '^[^-_]*', 0))"
_APART = "((replace(lower({0}), '_', '-') = 'zh-cn' AND replace(lower({1}), '_', '-') = 'zh-tw') OR (replace(lower({0}), '_', '-') = 'zh-tw' AND replace(lower({1}), '_', '-') = 'zh-cn'))"


def _match(a: str, b: str) -> str:
    return f"({a} = {b} OR (NOT {_APART.format(a, b)} AND {_PRIM.format(a)} = {_PRIM.format(b)}))"


_COMMON = "common AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in align.COMMON) + "]) AS common, generate_subscripts([" + ", ".join("1" for _ in align.COMMON) + "], 1) - 1 AS rank)"


@query(with_("videos", "tracks") + f""", {_COMMON}, h AS (SELECT t.*, rank, row_number() OVER (PARTITION BY video_id, rank ORDER BY is_auto, pos) AS r FROM tracks t JOIN common c ON {_match("t.lang", "c.common")}
), every AS (
  SELECT video_id, lang, 1 AS tier, rank FROM h WHERE r = 1 AND fetched
  UNION ALL SELECT video_id, 'original', 2, 0 FROM videos WHERE has_original
  UNION ALL SELECT video_id, lang, CASE WHEN is_auto THEN 4 ELSE 3 END, pos FROM tracks t WHERE fetched AND NOT EXISTS (SELECT 1 FROM common c WHERE {_match("t.lang", "c.common")})
), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY tier, rank) AS r FROM every)
SELECT video_id, lang, tier FROM k WHERE r = 1""")
def source_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.select_source(C.videos(spark, sf_dir), C.tracks(spark, sf_dir))


@query(with_("tracks") + f""", o AS (SELECT unnest([{", ".join(f"'{c}'" for c in align.ORIGINAL)}]) AS c, generate_subscripts([{", ".join("1" for _ in align.ORIGINAL)}], 1) AS rank
), m AS (SELECT video_id, lang, is_auto, pos, coalesce((SELECT min(rank) FROM o WHERE {_match("t.lang", "o.c")}), 99) AS rank FROM tracks t
), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank = 99, is_auto, rank, pos) AS k FROM m)
SELECT video_id, lang FROM r WHERE k = 1""")
def source_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.source_languages(C.tracks(spark, sf_dir))


@query(with_("tracks") + ", r AS (SELECT *, row_number() OVER (PARTITION BY video_id, lang ORDER BY is_auto, ext NOT IN ('srt', 'vtt', 'srv3', 'json3'), pos) AS k FROM tracks) SELECT video_id, lang, is_auto, pos, fetched, ext FROM r WHERE k = 1")
def track_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.choose_track(C.tracks(spark, sf_dir))


@query(with_("videos", "tracks") + f""", g AS (SELECT video_id, original_lang, unnest(['en', 'zh-CN', 'de']) AS target FROM videos
), h AS (SELECT g.video_id, target, arg_min(lang, (CASE WHEN lang <> target THEN 1 ELSE 0 END) * 1000 + pos) AS official FROM g JOIN tracks t ON g.video_id = t.video_id AND {_match("t.lang", "g.target")} GROUP BY 1, 2)
SELECT g.video_id, g.target, CASE WHEN official IS NOT NULL THEN 'official' WHEN {_match("original_lang", "g.target")} THEN 'original' ELSE 'ai' END AS action, official AS track FROM g LEFT JOIN h ON g.video_id = h.video_id AND g.target = h.target""")
def strategy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = C.videos(spark, sf_dir).select("video_id", "original_lang", F.explode(F.array(F.lit("en"), F.lit("zh-CN"), F.lit("de"))).alias("target"))
    return align.strategy(targets, C.tracks(spark, sf_dir))


@query(with_("videos") + ", t AS (SELECT video_id, 'translated' AS kind, 'zh-CN' AS lang, 1 AS pos FROM videos WHERE video_id % 4 = 0 UNION ALL SELECT video_id, 'translated', 'de', 2 FROM videos WHERE video_id % 4 < 2 UNION ALL SELECT video_id, 'original', original_lang, 0 FROM videos WHERE has_original), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN kind = 'translated' AND lang = 'zh-CN' THEN 1 WHEN kind = 'original' THEN 2 ELSE 3 END, pos) AS k FROM t) SELECT video_id, kind, lang FROM r WHERE k = 1")
def summary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation into the summary's language, else the original, else any translation."""
    v, k = C.videos(spark, sf_dir), F.col("video_id") % 4
    row = lambda kind, lang, pos: ("video_id", F.lit(kind).alias("kind"), lang.alias("lang"), F.lit(pos).alias("pos"))
    rows = v.where(k == 0).select(*row("translated", F.lit("zh-CN"), 1)).unionByName(v.where(k < 2).select(*row("translated", F.lit("de"), 2))).unionByName(v.where("has_original").select(*row("original", F.col("original_lang"), 0)))
    return align.select_summary(rows, "zh-CN")


@query(with_("cues") + """, t AS (SELECT video_id, pos, start_ms + 150 + pos % 3 * 900 AS s, end_ms + pos % 4 * 700 AS e, 'at ' || pos AS text FROM cues WHERE pos % 5 <> 2), j AS (
  SELECT c.video_id, c.pos, string_agg(t.text, ' ' ORDER BY t.s, t.pos) AS other, count(*) AS n FROM cues c JOIN t ON t.video_id = c.video_id AND c.start_ms < t.e AND t.s < c.end_ms AND t.s < t.e AND c.start_ms < c.end_ms GROUP BY 1, 2)
SELECT c.video_id, c.pos, c.start_ms, c.end_ms, c.text, j.other, coalesce(j.n, 0) AS n_overlaps FROM cues c LEFT JOIN j ON j.video_id = c.video_id AND j.pos = c.pos""")
def bilingual_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with the texts of another file's cues that overlap them, where the two files are timed differently."""
    cues_ = C.cues(spark, sf_dir).select("video_id", "pos", "start_ms", "end_ms", "text")
    moved = cues_.where("pos % 5 <> 2").select("video_id", "pos", (F.col("start_ms") + 150 + F.col("pos") % 3 * 900).alias("start_ms"), (F.col("end_ms") + F.col("pos") % 4 * 700).alias("end_ms"), F.concat(F.lit("at "), F.col("pos").cast("string")).alias("text"))
    return align.overlapping(cues_, moved)


# --- sets and archives ------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def archive_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no archive lists."""
    lines = C.table(spark, sf_dir, "labels").select(F.concat(F.lit("youtube  "), F.col("doc_id").cast("string")).alias("value"))
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), "doc_id", "source")
    return state.unprocessed(docs, state.read_archive(lines), "video_id").select("doc_id", "source")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def archive_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", "lang").join(C.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT 'youtube ' || doc_id AS line FROM labels UNION SELECT 'youtube ' || (item_id * 3) FROM benchmark")
def archive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.table(spark, sf_dir, "labels").select(F.concat(F.lit("youtube "), F.col("doc_id").cast("string")).alias("line"))
    b = C.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("youtube "), (F.col("item_id") * 3).cast("string")).alias("line"))
    return a.union(b).distinct()


@query("WITH f AS (SELECT user_id, min(event_id) AS first_event FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, first_event FROM f WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def failed_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures once each, without those listed before."""
    failed = C.table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return failed.join(C.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id")), "user_id", "left_anti")


@query("SELECT 'left' AS side, x AS key FROM (SELECT doc_id % 97 AS x FROM documents EXCEPT SELECT event_id % 89 FROM events) UNION ALL SELECT 'both', x FROM (SELECT doc_id % 97 AS x FROM documents INTERSECT SELECT event_id % 89 FROM events)")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("key"))
    b = C.table(spark, sf_dir, "events").select((F.col("event_id") % 89).alias("key"))
    return a.subtract(b).select(F.lit("left").alias("side"), "key").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "key"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value, min(event_id) AS position, count(*) - 1 AS repeats FROM events GROUP BY user_id")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each key, at its first position."""
    return C.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("value"), F.min("event_id").alias("position"), (F.count("*") - 1).alias("repeats"))


@query("SELECT doc_id, left(text, 50) AS title, (SELECT count(*) FROM documents) - 5 AS more FROM documents ORDER BY doc_id LIMIT 5")
def preview_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five, and how many more there are."""
    docs = C.table(spark, sf_dir, "documents")
    return docs.orderBy("doc_id").limit(5).select("doc_id", F.left("text", F.lit(50)).alias("title")).crossJoin(docs.agg((F.count("*") - 5).alias("more")))  # one row


# --- counts and windows -----------------------------------------------------------------------------------------------------


@query(with_("videos") + ", s AS (SELECT unnest(['pending', 'detecting', 'downloading', 'translating', 'summarizing', 'outputting', 'done', 'failed', 'skipped']) AS stage) SELECT s.stage, count(v.video_id) AS n FROM s LEFT JOIN videos v ON v.stage = s.stage GROUP BY s.stage")
def stage_stats_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stage_statistics(C.videos(spark, sf_dir))


_ITEMS = ", i AS (SELECT error_type AS error, CASE WHEN stage = 'skipped' THEN 'archived' END AS skip_reason, stage = 'done' AS done FROM videos)"


@query(with_("videos") + _ITEMS + " SELECT count(*) AS total, count_if(error IS NULL AND skip_reason IS NULL AND done) AS success, count_if(error IS NOT NULL OR (skip_reason IS NULL AND NOT done)) AS failed, count_if(error IS NULL AND skip_reason IS NOT NULL) AS skipped, count(*) - count_if(error IS NULL AND skip_reason IS NULL AND done) AS failed_staged FROM i")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = C.videos(spark, sf_dir).select(F.col("error_type").alias("error"), F.when(F.col("stage") == "skipped", "archived").alias("skip_reason"), (F.col("stage") == "done").alias("done"))
    return state.run_totals(items)


_EVENTS = "e AS (SELECT user_id, event_id, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS kind, epoch_us(ts)::BIGINT // 1000 AS ms FROM (SELECT user_id, event_id, ts, CASE WHEN user_id % 2 = 0 THEN 'translate' ELSE event_type END AS event_type FROM events))"


@query(f"WITH {_EVENTS}, l AS (SELECT *, lag(kind) OVER w AS k0, lag(stage) OVER w AS s0, lag(ms) OVER w AS m0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT stage, count(*) AS n, round(avg(ms - m0), 3) AS avg_ms, min(ms - m0) AS min_ms, max(ms - m0) AS max_ms, avg(ms - m0) AS a FROM l WHERE kind = 'end' AND k0 = 'start' AND stage = s0 GROUP BY stage) SELECT stage, n, avg_ms, min_ms, max_ms, round(a / sum(a) OVER (), 9) AS share FROM g")
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = C.table(spark, sf_dir, "events")
    stage = F.when(F.col("user_id") % 2 == 0, "translate").otherwise(F.col("event_type"))
    rows = events.select("user_id", "event_id", stage.alias("stage"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    timed = state.stage_timing(rows, ["user_id"], ["event_id"])
    return timed.withColumn("avg_ms", F.round("avg_ms", 3)).withColumn("share", F.round("share", 9))


@query(f"""WITH {_EVENTS}, l AS (SELECT *, lag(kind) OVER w AS k0, lag(stage) OVER w AS s0, lag(ms) OVER w AS m0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT stage, count(*) AS n, true AS close FROM l WHERE kind = 'end' AND k0 = 'start' AND stage = s0 GROUP BY stage""")
def stage_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations per stage: sketches of each day, merged; close: whether the merged median and ninth decile lie within 0.03 of these ranks."""
    events = C.table(spark, sf_dir, "events")
    stage = F.when(F.col("user_id") % 2 == 0, "translate").otherwise(F.col("event_type"))
    rows = events.select("user_id", "event_id", F.to_date("ts").alias("day"), stage.alias("stage"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    took = state.stage_durations(rows, ["user_id"], ["event_id"]).select("stage", "day", "took")
    merged = state.merged_quantiles(state.duration_sketches(took, ["stage", "day"]), ["stage"], [0.5, 0.9])
    ranks = took.join(F.broadcast(merged), "stage").groupBy("stage", "n")  # a row per stage
    off = lambda i, q: [F.avg((F.col("took") < F.col("quantiles")[i]).cast("double")) - q, q - F.avg((F.col("took") <= F.col("quantiles")[i]).cast("double"))]
    return ranks.agg((F.greatest(*off(0, 0.5), *off(1, 0.9)) <= 0.03).alias("close"))


@query("""WITH w AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
), p AS (
  SELECT a.user_id, a.event_id, count(*) AS n, sum(b.value * (least(a.k, 10) - (a.k - b.k))) AS s FROM w a JOIN w b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 9 AND a.k GROUP BY 1, 2)
SELECT user_id, event_id, round(CASE WHEN n >= 2 THEN s * 2 / (n * (n + 1)) END, 6) AS average FROM p""")
def eta_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving averages over each user's last ten values, the newest heaviest."""
    rows = state.weighted_average(C.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", ["event_id"])
    return rows.select("user_id", "event_id", F.round("average", 6).alias("average"))


@query("""WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events
), c AS (SELECT user_id, event_id, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS consecutive, sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures FROM r)
SELECT *, consecutive >= 2 AS unhealthy FROM c""")
def proxy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = C.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return state.consecutive_failures(events, ["user_id"], F.col("event_type") != "error", ["event_id"], 2).drop("event_type")


@query("WITH p AS (SELECT user_id, count(*) AS requests, count_if(event_type = 'error')::DOUBLE / count(*) AS rate FROM events GROUP BY user_id) SELECT event_day, best FROM (SELECT 0 AS event_day, (SELECT user_id FROM p ORDER BY rate, user_id LIMIT 1) AS best)")
def proxy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy with the least share of failures, the first on a tie."""
    best = monitoring.best_proxy(C.table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")
    return best.select(F.lit(0).alias("event_day"), "best")


@query("SELECT lang, count_if(n_chars > 1000) AS has_tracks, count_if(NOT n_chars > 1000) AS none, bool_or(n_chars > 20000) AS any_long FROM documents GROUP BY lang")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.detection_counts(C.table(spark, sf_dir, "documents"), "lang", F.col("n_chars") > 1000, F.col("n_chars") > 20000)


_CHUNKS = "c AS (SELECT l_orderkey AS video_id, l_linenumber AS chunk_index, l_returnflag <> 'N' AS is_completed, l_linestatus = 'F' AS failed, CASE WHEN l_quantity > 3 THEN 'chunk ' || l_partkey END AS translated FROM lineitem)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_quantity") > 3, F.concat(F.lit("chunk "), F.col("l_partkey").cast("string")))
    return C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_returnflag") != "N").alias("is_completed"), (F.col("l_linestatus") == "F").alias("failed"), text.alias("translated"))


@query(f"WITH {_CHUNKS} SELECT video_id, count(*) AS total, count_if(is_completed) AS completed, count_if(failed AND NOT is_completed) AS failed, count(*) - count_if(is_completed) AS pending, 100.0::DOUBLE * count_if(is_completed) / count(*) AS percent, count_if(is_completed) >= count(*) AS is_complete FROM c GROUP BY video_id")
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.chunk_status(_chunks(spark, sf_dir), ["video_id"])


@query(f"WITH {_CHUNKS} SELECT video_id, string_agg(translated, {_NL} || {_NL} ORDER BY chunk_index, translated) AS content FROM c GROUP BY video_id HAVING count(*) = count(translated)")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined in order, for items whose chunks are all translated."""
    return state.merge_chunks(_chunks(spark, sf_dir), ["video_id"])


@query("SELECT user_id AS video_id, arg_max(event_type, event_id) AS stage, count(*) AS updates, min(event_id) AS started FROM events GROUP BY user_id")
def manifest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage of each item; the batch twin of the stream in tidemark.streaming."""
    return C.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.max_by("event_type", "event_id").alias("stage"), F.count("*").alias("updates"), F.min("event_id").alias("started"))


@query(with_("messages") + "SELECT event_id, stderr AS stderr, CASE WHEN event_id % 10 = 1 THEN 'ERROR: Connection reset by peer' ELSE stderr END AS message FROM messages")
def stderr_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.messages(spark, sf_dir).select("event_id", "stderr", errors.message_of(F.col("stderr")).alias("message"))
