"""Joins of cues and tracks: bilingual files, blocks and their translations, sources by priority, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.languages import matches, primary

#: Languages that are good sources for translation, the best first (fixed values).
COMMON = ("en", "en-US", "zh-CN", "zh-TW", "es", "es-ES", "de", "de-DE", "ja", "ja-JP", "fr", "fr-FR", "pt", "pt-PT", "ru", "ru-RU", "ko", "ko-KR")
#: Languages that an original is looked for in, the best first (fixed values).
ORIGINAL = ("en", "zh-CN", "ja", "de", "fr", "es", "ru", "pt", "ko", "it", "ar", "hi")


def bilingual(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Each source cue (`keys`, pos, start, end, text) with the target's text below it where both times are the same strings.

    Of target cues with equal times the last one counts; source cues with equal times all find it.
    """
    last = target.groupBy(*keys, "start", "end").agg(F.max_by("text", "pos").alias("_other"))
    joined = source.join(last, [*keys, "start", "end"], "left")
    return joined.select(*keys, "pos", "start", "end", F.when(F.col("_other").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "_other")).alias("text"), F.col("_other").isNotNull().alias("matched"))


def overlapping(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("video_id",), bucket_ms: int = 10_000) -> DataFrame:
    """Each source cue (`keys`, pos, start_ms, end_ms, text) with the texts of all target cues that overlap it in time, in the order of their starts.

    Both sides are dealt into buckets of `bucket_ms`, a cue into each one it touches, so a cue has one row per bucket and only
    meets cues of its buckets; a pair that shares several counts in the one where its overlap begins. Cues that end before they start, or
    when they start, overlap nothing.
    """
    keys = list(keys)
    touched = F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))).alias("_bucket")
    lasting = F.col("start_ms") < F.col("end_ms")
    a = source.where(lasting).select(*keys, "pos", "start_ms", "end_ms", touched)
    b = target.where(lasting).select(*keys, F.col("pos").alias("_pos"), F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end"), F.col("text").alias("_text"), touched)
    meet = (F.col("start_ms") < F.col("_end")) & (F.col("_start") < F.col("end_ms")) & (F.floor(F.greatest("start_ms", "_start") / bucket_ms) == F.col("_bucket"))
    found = a.join(b, [*keys, "_bucket"]).where(meet)
    ordered = F.array_sort(F.collect_list(F.struct("_start", "_pos", "_text")))
    texts = found.groupBy(*keys, "pos").agg(F.array_join(F.transform(ordered, lambda x: x["_text"]), " ").alias("other"), F.count("*").alias("n_overlaps"))
    joined = source.join(texts, [*keys, "pos"], "left")
    return joined.select(*keys, "pos", "start_ms", "end_ms", "text", "other", F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"))


def bilingual_text(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """The joined texts of each video, blank ones left out, apart by blank lines."""
    rows = bilingual(source, target, keys).where(F.btrim("text", F.lit(" \t\n\r")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.btrim("text", F.lit(" \t\n\r")).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))


def marked(blocks: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """`keys`, marked: blocks (`keys`, block_no, text) in order, each behind its mark, apart by blank lines."""
    mark = lambda b: F.concat(F.lit("[BLOCK_"), b["block_no"].cast("string"), F.lit("]\n"), b["text"])
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), mark), "\n\n").alias("marked"))


def apply_blocks(blocks: DataFrame, answer: DataFrame, key: str = "video_id") -> DataFrame:
    """Blocks (`key`, block_no, text) with the texts that an answer (`key`, answer) gives behind [BLOCK_n] marks.

    Blocks that the answer lacks keep their text; of repeated marks the last counts.
    """
    parts = answer.select(key, F.posexplode(F.split("answer", r"\[BLOCK_"))).select(key, "pos", F.regexp_extract("col", r"^(\d+)\]", 1).try_cast("int").alias("block_no"), F.btrim(F.regexp_replace("col", r"^\d+\]\s*\n", ""), F.lit(" \t\n\r")).alias("new"))
    last = parts.where("block_no is not null").groupBy(key, "block_no").agg(F.max_by("new", "pos").alias("new"))
    return blocks.join(last, [key, "block_no"], "left").select(key, "block_no", F.coalesce("new", "text").alias("text"))


def with_folded(tracks: DataFrame) -> DataFrame:
    """`tracks` with _low and _head, their codes folded once, which hits() compares with."""
    return tracks.withColumns({"_low": F.replace(F.lower("lang"), F.lit("_"), F.lit("-")), "_head": primary(F.col("lang"))})


def hits(code: str) -> Column:
    """matches() of a track's language (with_folded()) and a code, as one or two comparisons of strings."""
    apart = {"zh-cn": "zh-tw", "zh-tw": "zh-cn"}.get(code.lower())
    same = F.col("_head") == code.split("-")[0].lower()
    return same & (F.col("_low") != apart) if apart else same


def first_common(manual: Column, auto: Column, order: Sequence[str] = ORIGINAL) -> Column:
    """The source language: by priority among manual tracks, then among automatic ones, then the first there is."""

    def like(code: str):
        return lambda x: matches(x, F.lit(code))

    found = [F.get(F.filter(tracks, like(c)), F.lit(0)) for tracks in (manual, auto) for c in order]
    return F.coalesce(*found, F.get(manual, F.lit(0)), F.get(auto, F.lit(0)))


def source_languages(tracks: DataFrame) -> DataFrame:
    """video_id, lang: first_common() of each video's tracks (video_id, lang, is_auto, pos), by one aggregation."""
    rank = None
    for i, code in enumerate(ORIGINAL):
        rank = F.when(hits(code), i) if rank is None else rank.when(hits(code), i)
    ranked = with_folded(tracks).select("video_id", "lang", "is_auto", "pos", rank.alias("_rank"))
    return ranked.groupBy("video_id").agg(F.min_by("lang", F.struct(F.col("_rank").isNull().alias("other"), "is_auto", F.coalesce("_rank", F.lit(0)).alias("rank"), "pos")).alias("lang"))


def first_listed(manual: Column, auto: Column) -> Column:
    """The source language of a translation: the first manual track's, else the first automatic one's."""
    return F.coalesce(F.get(manual, F.lit(0)), F.get(auto, F.lit(0)))


def select_source(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """Which track of each video to translate from: video_id, lang, tier (1 common, 2 original, 3 manual, 4 automatic).

    `videos`: video_id, has_original. `tracks`: video_id, lang, is_auto, pos, fetched. In tier 1, each common language in order
    looks at its first matching track only, manual before automatic. A video without a track is left out. Tracks are
    aggregated once; codes of one primary part look at the same tracks, but for the two Chinese scripts.
    """
    heads = list(dict.fromkeys(c if c.startswith("zh") else c.split("-")[0] for c in COMMON))
    order = F.struct("is_auto", "pos")
    first = [F.min_by(F.struct("lang", "fetched"), F.when(hits(h), order)).alias(f"_t{i}") for i, h in enumerate(heads)]
    common = F.col("_head").isin(*sorted({c.split("-")[0] for c in COMMON}))
    rest = F.min_by(F.struct("lang", F.when(F.col("is_auto"), 4).otherwise(3).alias("tier")), F.when(~common & F.col("fetched"), order)).alias("_rest")
    seen = with_folded(tracks).groupBy("video_id").agg(*first, rest)
    tier1 = F.coalesce(*[F.when(F.col(f"_t{i}.fetched"), F.struct(F.col(f"_t{i}.lang").alias("lang"), F.lit(1).alias("tier"))) for i in range(len(heads))])
    tier2 = F.when(F.col("has_original"), F.struct(F.lit("original").alias("lang"), F.lit(2).alias("tier")))
    both = videos.where("has_original").select("video_id", "has_original").join(seen, "video_id", "full")
    return both.select("video_id", F.coalesce(tier1, tier2, "_rest").alias("best")).where("best is not null").select("video_id", "best.lang", "best.tier")


def select_summary(texts: DataFrame, language: str) -> DataFrame:
    """Which text of each video to summarise: video_id, kind, lang of the translation into `language`, else the original, else any translation.

    `texts`: video_id, kind (translated or original), lang, pos.
    """
    wanted = (F.col("kind") == "translated") & (F.col("lang") == language)
    tier = F.when(wanted, 1).when(F.col("kind") == "original", 2).otherwise(3)
    return texts.groupBy("video_id").agg(F.min_by(F.struct("kind", "lang"), F.struct(tier.alias("t"), "pos")).alias("_b")).select("video_id", "_b.kind", "_b.lang")


def supplement(wanted: DataFrame, there: DataFrame, tracks: DataFrame) -> DataFrame:
    """Languages (video_id, lang) that are wanted, that a result lacks, and that have a fetched track."""
    return wanted.join(there, ["video_id", "lang"], "left_anti").join(tracks.where("fetched").select("video_id", "lang"), ["video_id", "lang"], "left_semi")


def choose_track(tracks: DataFrame) -> DataFrame:
    """One file per video and language: manual before automatic, then a known format before others, then the first."""
    known = F.col("ext").isin("srt", "vtt", "srv3", "json3")
    first = F.row_number().over(Window.partitionBy("video_id", "lang").orderBy("is_auto", ~known, "pos"))
    return tracks.withColumn("_r", first).where("_r = 1").drop("_r")


def strategy(targets: DataFrame, tracks: DataFrame, mode: str = "official_first") -> DataFrame:
    """What to do for each video and target language: official (a track of that language), original (same language), ai, or fail.

    `targets`: video_id, target, original_lang. `tracks`: video_id, lang, pos. Exact codes come before matching ones.
    """
    # codes are folded once per track and once per target, so that a comparison is one of strings
    folded = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit("-"))
    track = F.struct("pos", "lang", folded(F.col("lang")).alias("low"), primary(F.col("lang")).alias("head"))
    listed = tracks.groupBy("video_id").agg(F.array_sort(F.collect_list(track)).alias("_tracks"))  # a video's tracks
    joined = targets.withColumn("_low", folded(F.col("target"))).withColumn("_head", primary(F.col("target"))).join(listed, "video_id", "left")
    other = F.when(F.col("_low") == "zh-cn", "zh-tw").when(F.col("_low") == "zh-tw", "zh-cn").otherwise("")
    joined = joined.withColumn("_other", other)  # the script that a Chinese target is told apart from
    found = F.filter("_tracks", lambda t: (t["lang"] == F.col("target")) | ((t["head"] == F.col("_head")) & (t["low"] != F.col("_other"))))
    exact = F.filter("_tracks", lambda t: t["lang"] == F.col("target"))
    official = F.coalesce(F.get(exact, F.lit(0)), F.get(found, F.lit(0)))["lang"]
    joined = joined.withColumn("official", official)
    same = F.coalesce(matches(F.col("original_lang"), F.col("target")), F.lit(False))
    if mode == "ai_only":
        action = F.lit("ai")
    else:
        action = F.when(F.col("official").isNotNull(), "official").when(same, "original").otherwise("fail" if mode == "official_only" else "ai")
    return joined.select("video_id", "target", action.alias("action"), F.when(action == "official", F.col("official")).alias("track"))
