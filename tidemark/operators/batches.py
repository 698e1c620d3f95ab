"""Batches of items: progress and what is left, chunk and manifest state from events, failure records, reports, proxy rotation.

Every function takes and returns DataFrames or columns; state is what the events of a key add up to, so it can be computed anew
from the events at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import duration
from tidemark.operators.state import weighted_average

#: A line of the failure log whose fields may be missing (fixed pattern): time, batch, video, address, class, message.
LOOSE_FAILURE = r"^\[([^\]]+)\](?:\s+\[batch:([^\]]+)\])?(?:\s+\[video:([^\]]+)\])?\s+(.+?)(?:\s+error=([^\s]+))?(?:\s+msg=(.+))?$"


def progress(records: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each record with completed, remaining, percent, elapsed (seconds spent so far), average and eta (average times remaining).

    `records` are all items of a key, done in this order; `value` is how long each took. The average is the weighted one over the
    last ten; without it there is no eta, and where nothing remains it is 0. A key's records are in one task.
    """
    by = Window.partitionBy(*keys)
    so_far = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = weighted_average(records, keys, value, order)
    rows = rows.withColumn("completed", F.count("*").over(so_far)).withColumn("total", F.count("*").over(by)).withColumn("elapsed", F.sum(value).over(so_far))
    rows = rows.withColumn("remaining", F.col("total") - F.col("completed")).withColumn("percent", F.lit(100.0) * F.col("completed") / F.col("total"))
    return rows.withColumn("eta", F.when(F.col("remaining") <= 0, F.when(F.col("average").isNotNull(), 0.0)).otherwise(F.col("average") * F.col("remaining")))


def eta_text(seconds: Column) -> Column:
    """What is left in words, in whole seconds (up to a millionth short of one counts as one); nothing where that is not known."""
    return F.when(seconds <= 0, "almost done").when(seconds > 0, F.concat(F.lit("about "), duration(F.round(seconds, 6)), F.lit(" left")))


def chunk_progress(chunks: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """`chunks` (`keys`, chunk_index) with is_completed, failed, translated, from `events` (`keys`, chunk_index, seq, kind, content).

    A chunk that was completed stays so; a completion takes it off the failed ones, a later failure puts it there again.
    Repeated events change nothing; events of chunks that do not exist are ignored.
    """
    done = F.col("kind") == "completed"
    last = events.groupBy(*keys, "chunk_index").agg(F.bool_or(done).alias("is_completed"), (F.max_by("kind", "seq") == "failed").alias("failed"), F.max_by(F.when(done, F.col("content")), F.when(done, F.col("seq"))).alias("translated"))
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return chunks.join(last, [*keys, "chunk_index"], "left").select(*chunks.columns, false("is_completed"), false("failed"), "translated")


def pending_chunks(progress: DataFrame) -> DataFrame:
    """The chunks that a run which is taken up again must do."""
    return progress.where(~F.col("is_completed"))


def progress_documents(progress: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, document: the progress of each item as JSON, completed and failed chunks in order."""
    of = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("chunk_index"))))
    by = progress.groupBy(*keys).agg(F.count("*").alias("total_chunks"), of("is_completed").alias("completed_chunks"), of("failed").alias("failed_chunks"))
    return by.select(*keys, F.to_json(F.struct("total_chunks", "completed_chunks", "failed_chunks")).alias("document"))


def manifest(updates: DataFrame) -> DataFrame:
    """batch_id, video_id, stage, error_type, started_at, updated_at from `updates` (batch_id, video_id, seq, stage, error_type, at).

    The last update decides, any stage may follow any other, and the first one sets started_at for good.
    """
    last = F.max_by(F.struct("stage", "error_type", "at"), "seq").alias("_l")
    by = updates.groupBy("batch_id", "video_id").agg(last, F.min_by("at", "seq").alias("started_at"))
    return by.select("batch_id", "video_id", "_l.stage", "_l.error_type", "started_at", F.col("_l.at").alias("updated_at"))


def manifest_documents(items: DataFrame) -> DataFrame:
    """batch_id, document: a JSON line per batch, its items in the order of their ids; missing values are written as null.

    A batch's items are one row, as its file has them.
    """
    entry = F.struct("stage", "error_type", "started_at", "updated_at")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("video_id").cast("string").alias("k"), entry.alias("v"))))
    by = items.groupBy("batch_id").agg(F.map_from_entries(ordered).alias("videos"))
    return by.select("batch_id", F.to_json(F.struct("batch_id", "videos"), {"ignoreNullFields": "false"}).alias("document"))


def write_manifests(items: DataFrame, path: str) -> None:
    """A file per batch below `path`, which readers.read_manifest() takes; committed as a whole or not at all."""
    manifest_documents(items).select(F.col("batch_id").alias("batch"), F.col("document").alias("value")).write.mode("overwrite").partitionBy("batch").text(path)


def failure_line(at: Column, batch: Column, video: Column, url: Column, kind: Column, reason: Column, stage: Column) -> Column:
    """A failure as a line of the log; batch and stage only where they are given."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat_ws(" ", F.concat(F.lit("["), at, F.lit("]")), F.when(given(batch), F.concat(F.lit("[batch:"), batch, F.lit("]"))), F.concat(F.lit("[video:"), video, F.lit("]")), url, F.concat(F.lit("error="), kind), F.concat(F.lit("msg="), reason), F.when(given(stage), F.concat(F.lit("stage="), stage)))


def new_failed_urls(failures: DataFrame, known: DataFrame) -> DataFrame:
    """url: addresses of failures, once each, that the list of failed ones lacks."""
    return failures.select("url").distinct().join(known.select("url"), "url", "left_anti")


def parse_failures(lines: DataFrame) -> DataFrame:
    """Lines (value, and other columns) of a failure log with at, batch, video, url, error_type, message and parsed.

    A line of another form keeps its class, if it names one, and parsed is false. Blank lines are left out.
    """
    rows = lines.withColumn("_v", F.btrim("value", F.lit(" \t\r\n"))).where("_v != ''")
    ok, part = F.col("_v").rlike(LOOSE_FAILURE), lambda i: F.nullif(F.regexp_extract("_v", LOOSE_FAILURE, i), F.lit(""))
    named = F.nullif(F.regexp_extract("_v", r"error=([^\s]+)", 1), F.lit(""))
    fields = [part(1).alias("at"), part(2).alias("batch"), part(3).alias("video"), F.when(ok, F.coalesce(part(4), F.lit(""))).alias("url")]
    return rows.select(*[c for c in lines.columns if c != "value"], *fields, F.when(ok, F.coalesce(part(5), F.lit("unknown"))).otherwise(named).alias("error_type"), F.when(ok, F.coalesce(part(6), F.lit(""))).alias("message"), ok.alias("parsed"))


#: What classes of errors are called (fixed set of classes; any other is unknown).
ERROR_NAMES = {"network": "network error", "timeout": "timed out", "rate_limit": "rate limited", "auth": "authentication failed", "content": "content unavailable", "file_io": "file error", "parse": "parse error", "invalid_input": "invalid input", "cancelled": "cancelled", "external_service": "external service error", "unknown": "unknown error"}


def error_name(kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ERROR_NAMES.items() for x in pair])
    return F.coalesce(F.get(F.transform(F.array(kind), lambda k: F.try_element_at(names, k)), F.lit(0)), F.lit(ERROR_NAMES["unknown"]))


def failure_info(video: Column, kind: Column, reason: Column, dry_run: Column) -> Column:
    """What is shown of a failure, and whether it is recorded: not in a dry run."""
    return F.struct(F.concat(F.lit("["), error_name(kind), F.lit("] "), video, F.lit(" - "), reason).alias("shown"), (~dry_run).alias("recorded"))


def ranked_errors(items: DataFrame, key: str = "error_type") -> DataFrame:
    """Counts of classes with their rank, the most frequent first; equal counts by name."""
    return items.groupBy(key).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))  # a row per class


def first_warnings(problems: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """`keys`, n, shown: the first `most` problems (pos, problem) of each item as lines, and how many there are."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "problem")))
    line = lambda p: F.concat(p["pos"].cast("string"), F.lit(": "), p["problem"])
    return problems.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.slice(ordered, 1, most), line).alias("shown"))


def rotation(attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """What became of requests whose `attempts` (`keys`, attempt from 0, proxy, ok, retryable) go from proxy to proxy.

    `keys`, outcome (done, refused for an error that no retry helps, exhausted), attempts made, proxy of the last one, and the
    proxies whose failure is noted: those of failed attempts that may be retried. Attempts behind the deciding one, or `most`, did
    not happen.
    """
    made = attempts.where(F.col("attempt") < most)
    stop = F.coalesce(F.min(F.when(F.col("ok") | ~F.col("retryable"), F.col("attempt"))), F.max("attempt"))
    row = F.struct("attempt", "proxy", "ok", "retryable")
    by = made.groupBy(*keys).agg(stop.alias("_at"), F.array_sort(F.collect_list(row)).alias("_rows"))
    last = F.get(F.filter("_rows", lambda r: r["attempt"] == F.col("_at")), F.lit(0))
    failed = F.transform(F.filter("_rows", lambda r: (r["attempt"] <= F.col("_at")) & ~r["ok"] & r["retryable"]), lambda r: r["proxy"])
    outcome = F.when(F.col("_l.ok"), "done").when(F.col("_l.retryable"), "exhausted").otherwise("refused")
    return by.withColumn("_l", last).select(*keys, outcome.alias("outcome"), (F.col("_at") + 1).cast("int").alias("attempts"), F.col("_l.proxy").alias("proxy"), failed.alias("failed"))


def header(at: Column, channel_name: Column, channel_id: Column, source: Column, n: Column, dry_run: Column | None = None) -> Column:
    """The line above a list: when, of which channel or source, how many."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    whose = F.when(given(channel_name) & given(channel_id), F.concat(F.lit("Channel: "), channel_name, F.lit(" ["), channel_id, F.lit("]"))).when(given(channel_id), F.concat(F.lit("Channel ID: "), channel_id)).when(given(source), F.concat(F.lit("Source: "), source))
    return F.concat_ws(" | ", F.concat(F.lit("# "), at), F.when(dry_run, "[Dry Run]") if dry_run is not None else F.lit(None).cast("string"), whose, F.concat(F.lit("Count: "), n.cast("string")))


def url_list(items: DataFrame, key: str, line: Column, width: int = 60) -> DataFrame:
    """`key`, content: a block per `key` of a header `line` over the aggregated items (pos, url), the addresses in order, and a rule."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"])
    return items.groupBy(key).agg(F.concat(F.lit("\n"), line, F.lit("\n"), F.array_join(ordered, "\n"), F.lit("\n# " + "=" * width + "\n")).alias("content"))


def detection_report(items: DataFrame, key: str, line: Column) -> DataFrame:
    """`key`, file, content: of items (`key`, pos, url, has_subtitles) those with and those without, each as a block below the header `line`.

    `line` may use total, the number of a key's items of both kinds. It is the same for dry runs. A block's addresses are one row, as
    its file has them.
    """
    by_kind = items.groupBy(key, F.when(F.col("has_subtitles"), "with_subtitle.txt").otherwise("without_subtitle.txt").alias("file")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
    total = by_kind.withColumn("total", F.sum("n").over(Window.partitionBy(key)))  # two rows a key
    title = F.concat(F.lit("# "), F.when(F.col("file") == "with_subtitle.txt", "With subtitles").otherwise("Without subtitles"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return total.select(key, "file", F.concat(F.lit("\n"), line, F.lit("\n"), title, F.lit("\n\n"), F.array_join("urls", "\n"), F.lit("\n# " + "=" * 80 + "\n\n")).alias("content"))
