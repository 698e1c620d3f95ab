"""Output documents and their sinks. Documents are columns; Spark's writers commit them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.texts import clock
from tidemark.operators.align import bilingual
from tidemark.operators.cues import parse_for_output, render, to_text


def _numbered(chapters: DataFrame, key: str, line) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("start_s", F.lit(0)).alias("start_s"))))
    return F.array_join(F.transform(ordered, line), "\n")


def chapters_list(chapters: DataFrame, key: str) -> DataFrame:
    """A numbered list per item from its chapters (`key`, pos, title, start_s)."""
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". ["), clock(c["start_s"]), F.lit("] "), c["title"])
    return chapters.groupBy(key).agg(F.concat(F.lit("# Chapters\n\n"), _numbered(chapters, key, line)).alias("markdown"))


def chapters_table(chapters: DataFrame, key: str) -> DataFrame:
    """A table per item; bars in titles are escaped."""
    line = lambda c, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), clock(c["start_s"]), F.lit(" | "), F.replace(c["title"], F.lit("|"), F.lit("\\|")), F.lit(" |"))
    return chapters.groupBy(key).agg(F.concat(F.lit("| # | Time | Title |\n|---|---|---|\n"), _numbered(chapters, key, line)).alias("markdown"))


def json_document(*columns: Column | str) -> Column:
    """A document with nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def cookie_line(domain: Column, name: Column, value: Column) -> Column:
    return F.concat_ws("\t", domain, F.lit("TRUE"), F.lit("/"), F.lit("TRUE"), F.lit("0"), name, value)


def write_documents(documents: DataFrame, path: str, content: str = "content", by: tuple[str, ...] = ()) -> None:
    """One text record per row below `path`, in folders by the columns `by`; committed as a whole or not at all."""
    rows = documents.select(*by, F.col(content).alias("value"))
    (rows.write.mode("overwrite").partitionBy(*by) if by else rows.write.mode("overwrite")).text(path)


def write_named(documents: DataFrame, path: str, file: Column, content: str = "content", overwrite: bool = False) -> None:
    """One file per row below `path`, with the name in `file` and the text in `content`; what lies there stays unless `overwrite`.

    Files come into being together when the job ends well; a failed one leaves none.
    """
    from tidemark.sources.named_files import NamedFiles

    documents.sparkSession.dataSource.register(NamedFiles)
    documents.select(file.alias("file"), F.col(content).alias("content")).write.format("named_files").mode("append").option("path", path).option("replace", str(overwrite).lower()).save()


def chunk_files(chunks: DataFrame, existing: DataFrame, key: str = "video_id") -> DataFrame:
    """`key`, file, content of the chunks (`key`, chunk_index, content) whose file is not among the `existing` ones (`key`, file)."""
    named = chunks.select(key, F.format_string("chunk_%04d.srt", F.col("chunk_index").cast("long")).alias("file"), "content")
    return named.join(existing, [key, "file"], "left_anti")


def append_archive(done: DataFrame, path: str, key: str = "video_id") -> None:
    """Adds lines for items that are done to an archive. Call after their outputs are committed."""
    done.select(F.concat(F.lit("youtube "), F.col(key).cast("string")).alias("value")).distinct().write.mode("append").text(path)


def append_failures(failures: DataFrame, path: str) -> None:
    """Adds failure records as JSON lines; empty optional fields are left out."""
    filled = failures.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in failures.dtypes])
    filled.write.mode("append").json(path)


def clear_archive(spark: SparkSession, path: str) -> None:
    """Leaves an archive without lines."""
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)


def _bilingual(made: DataFrame, code: str) -> DataFrame:
    """video_id, _stem, content: files (video_id, lang, content) with their translation (_other) below each cue that has the same times there."""
    keys = ["video_id", "lang"]
    each = lambda c: made.select(*keys, F.posexplode(parse_for_output(F.col(c))).alias("pos", "_c")).select(*keys, "pos", "_c.index", "_c.start", "_c.end", "_c.text")
    met = bilingual(each("content"), each("_other"), keys).select(*keys, "pos", "start", "end", "text")
    cue = F.struct("pos", (F.col("pos") + 1).alias("index"), "start", "end", "text")
    files = met.groupBy(*keys).agg(render(F.array_sort(F.collect_list(cue))).alias("content"))
    every = made.select(*keys).join(files, keys, "left")  # a file without cues has an empty one
    return every.select("video_id", F.concat(F.lit("bilingual."), "lang", F.lit(f"-{code}")).alias("_stem"), F.coalesce("content", F.lit("")).alias("content"))


def artifacts(videos: DataFrame, files: DataFrame, languages: Sequence[str], translate: Callable[[Column, str], Column], text_format: str = "both") -> DataFrame:
    """video_id, file, content: what an item's output holds, from `files` (video_id, lang, content: the original as SRT, summary, metadata).

    The original, its translations, and both below each other, as SRT, as text, or both (`text_format`: srt, txt, both); a summary and
    metadata where they are given. `translate` makes a file's translation into a language.
    """
    rows = videos.select("video_id").join(files, "video_id")
    original = rows.where("content is not null").select("video_id", "lang", "content")
    kinds = [original.select("video_id", F.concat(F.lit("original."), "lang").alias("_stem"), "content")]
    for code in languages:
        made = original.select("video_id", "lang", "content", translate(F.col("content"), code).alias("_other"))
        kinds.append(made.select("video_id", F.lit(f"translated.{code}").alias("_stem"), F.col("_other").alias("content")))
        kinds.append(_bilingual(made, code))
    stems = kinds[0]
    for k in kinds[1:]:
        stems = stems.unionByName(k)
    out = []
    if text_format in ("srt", "both"):
        out.append(stems.select("video_id", F.concat("_stem", F.lit(".srt")).alias("file"), "content"))
    if text_format in ("txt", "both"):
        out.append(stems.select("video_id", F.concat("_stem", F.lit(".txt")).alias("file"), to_text(parse_for_output(F.col("content"))).alias("content")))
    out.append(rows.where("summary is not null").select("video_id", F.concat(F.lit("summary."), "summary_lang", F.lit(".md")).alias("file"), F.col("summary").alias("content")))
    out.append(rows.where("metadata is not null").select("video_id", F.lit("metadata.json").alias("file"), F.col("metadata").alias("content")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def metadata_document(video: Column, run_id: Column, made_at: Column, detection: Column, config: Column, ai: Column, summary_ai: Column, files: Column, version: str = "1") -> Column:
    """An item's metadata as JSON: `video`'s fields at the top, then what was found, asked for, used and written. Nulls are written out."""
    top = [F.lit(version).alias("tool_version"), run_id.alias("run_id"), made_at.alias("generated_at"), video.alias("video")]
    return F.to_json(F.struct(*top, detection.alias("detection"), config.alias("language_config"), ai.alias("translation_ai"), summary_ai.alias("summary_ai"), files.alias("files")), {"ignoreNullFields": "false"})
