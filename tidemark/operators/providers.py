"""Calls to text providers inside Spark tasks, with deterministic offline stand-ins.

A provider is a class made once per partition; its `generate(prompt)` returns text. Calls may fail: the error comes back as a
column, and the row stays. The number of partitions caps how many calls run at once. Results should be written before they
are used twice, because a column computed twice is paid for twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.texts import MARKER, merge_prompt, part_prompt, summary_prompt, summary_route


class UpperCase:
    """Returns the prompt in upper case."""

    def generate(self, prompt: str) -> str:
        return prompt.upper()


class Mark:
    """Returns the prompt with each e as E."""

    def generate(self, prompt: str) -> str:
        return prompt.replace("e", "E")


class FirstWords:
    """Returns the first words of the prompt's first line."""

    def __init__(self, words: int = 12):
        self.words = words

    def generate(self, prompt: str) -> str:
        return " ".join(prompt.split("\n")[0].split(" ")[: self.words])


class MarkText:
    """Returns what stands behind the prompt's marker, with each e as E."""

    def generate(self, prompt: str) -> str:
        return prompt.rpartition(MARKER)[2].replace("e", "E")


class Failing:
    """Refuses prompts that hold a 7 in their last line; returns others behind the marker with each e as E."""

    def generate(self, prompt: str) -> str:
        if "7" in prompt.rpartition("\n")[2]:
            raise RuntimeError("rate_limit: too many calls")
        return prompt.rpartition(MARKER)[2].replace("e", "E")


PROVIDERS: dict[str, Callable[[], object]] = {"upper": UpperCase, "mark": Mark, "first": FirstWords, "mark_text": MarkText, "failing": Failing}


def register(name: str, factory: Callable[[], object]) -> None:
    PROVIDERS[name.lower()] = factory


#: What providers can do (dimension): name, vision, streaming, most input tokens, most concurrent calls. A default for others.
CAPABILITIES = [("upper", False, False, 8000, 10), ("mark", False, False, 8000, 10), ("first", False, False, 8000, 10)]
DEFAULT_CAPABILITY = (False, False, 4096, 5)


def call(rows: DataFrame, provider: str, prompt: str, concurrency: int | None = None, tries: int = 3) -> DataFrame:
    """`rows` with answer and call_error. At most `concurrency` partitions call at once."""
    factory = PROVIDERS[provider.lower()]
    rows = rows.repartition(concurrency) if concurrency else rows
    out = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("call_error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            answers, failed = [], []
            for p in pdf[prompt]:
                answer, error = None, None
                for _ in range(tries):
                    try:
                        answer, error = (None if p is None else client.generate(p)), None
                        break
                    except Exception as e:  # noqa: BLE001  what a provider raises is data here
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                failed.append(error)
            yield pdf.assign(answer=answers, call_error=failed)

    return rows.mapInPandas(run, out)


def map_reduce(rows: DataFrame, key: str, text: str, provider: str, language: Column, title: Column | None = None, size: int = 10000) -> DataFrame:
    """`key`, summary: of short texts by one prompt, of long ones by a prompt per slice and one that merges the slices' answers.

    The slices of all texts are called first, then the texts; a slice without an answer, after a call's tries, is left out, and a
    text without any has no summary.
    """
    from tidemark.operators.folds import text_slices

    title = F.lit(None).cast("string") if title is None else title
    base = rows.select(key, F.col(text).alias("_text"), language.alias("_language"), title.alias("_title"), F.length(text).alias("_length"))
    direct = base.where((summary_route(F.col("_length")) == "direct") & (F.col("_length") > 0)).select(key, summary_prompt(F.col("_language"), F.col("_text"), F.col("_title")).alias("_prompt"))
    slices = base.where(summary_route(F.col("_length")) == "map_reduce").withColumn("_slices", text_slices(F.col("_text"), size))
    parts = slices.select(key, "_language", "_title", "_length", F.size("_slices").alias("_n"), F.posexplode("_slices").alias("_pos", "_slice"))
    mapped = call(parts.withColumn("_prompt", part_prompt(F.col("_language"), F.col("_slice"), F.col("_pos") + 1, F.col("_n"))).drop("_slice"), provider, "_prompt").where("answer is not null")
    ordered: Column = F.array_sort(F.collect_list(F.struct("_pos", "answer")))
    joined = mapped.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["answer"]), "\n---\n").alias("_joined"), *[F.first(c).alias(c) for c in ("_language", "_title", "_length")])
    merged = joined.select(key, merge_prompt(F.col("_language"), F.col("_joined"), F.col("_title"), F.col("_length")).alias("_prompt"))
    return call(direct.unionByName(merged), provider, "_prompt").select(key, F.col("answer").alias("summary"))


def translate_cues(rows: DataFrame, keys: list[str], content: str, provider: str, parse: Callable[[Column], Column]) -> DataFrame:
    """`keys`, content: each file's cues, as `parse` finds them, with texts by a provider; numbered anew, with comma milliseconds.

    A cue whose call fails keeps its text. A file's cues are one row, before and after.
    """
    from tidemark.operators import cues

    each = rows.select(*keys, F.posexplode(parse(F.col(content))).alias("_pos", "_c")).select(*keys, "_pos", "_c.*")
    done = call(each, provider, "text")
    times = lambda c: F.replace(c, F.lit("."), F.lit(","))
    cue = F.struct("_pos", (F.col("_pos") + 1).alias("index"), times(F.col("start")).alias("start"), times(F.col("end")).alias("end"), translate_or_keep(F.col("answer"), F.col("text")).alias("text"))
    return done.groupBy(*keys).agg(cues.render(F.array_sort(F.collect_list(cue))).alias("content"))


def translate_blocks(blocks: DataFrame, keys: list[str], provider: str) -> DataFrame:
    """`keys`, answer: marked blocks (`keys`, block_no, text), one call a block; a block whose call fails keeps its text."""
    done = call(blocks, provider, "text")
    row = F.struct("block_no", translate_or_keep(F.col("answer"), F.col("text")).alias("t"))
    mark = lambda b: F.concat(F.lit("[BLOCK_"), b["block_no"].cast("string"), F.lit("]\n"), b["t"])
    return done.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), mark), "\n\n").alias("answer"))


def translate_or_keep(answer: Column, original: Column) -> Column:
    """A failed call leaves the original text."""
    return F.coalesce(answer, original)


def _better_half(entries: Column) -> Column:
    """How many entries of a chunk go into its first half: folds.split_points() of their last lines."""
    from tidemark.operators.folds import CLAUSE_CUT, SENTENCE_CUT

    n, i = F.size(entries), F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(entries) - 1))
    low, high, mid = F.greatest(F.lit(1), F.floor(n / 4)), F.least(n - 1, F.floor(n * 3 / 4)), F.floor(n / 2)

    def scored(at: Column) -> Column:
        last = F.substring_index(F.get(entries, at - 1), "\n", -1)
        bonus = F.when(last.rlike(SENTENCE_CUT), 2.0).when(last.rlike(CLAUSE_CUT), 1.0).otherwise(0.0)
        return F.struct((F.abs(at - mid) / (high - low + 1) - 1.0 - bonus).alias("cost"), at.alias("at"))

    return F.array_min(F.transform(F.filter(i, lambda x: (x >= low) & (x <= high)), scored))["at"]


def call_bisecting(chunks: DataFrame, keys: list[str], text: str, provider: str, place: str, least: int = 500) -> DataFrame:
    """`keys`, answer: a provider's answers to chunks of cues; a chunk whose call fails is cut in two between cues and tried again.

    It is cut near the middle, better after a sentence's end than after a clause's. Halves of `least` characters or fewer, or of one
    cue, are not cut: if they fail, the whole chunk has no answer. Each round is written below `place`, so no call is paid for
    twice; only rows that failed reach the next round. Rounds end when nothing is left to cut, and each leaves every part shorter
    by a cue at least.
    """
    spark, pending, seen, number = chunks.sparkSession, chunks.select(*keys, F.lit("").alias("_path"), F.col(text).alias("_text")), None, 0
    while seen is None or not pending.isEmpty():
        call(pending, provider, "_text").write.mode("overwrite").parquet(f"{place}/round={number}")
        answered = spark.read.parquet(f"{place}/round={number}")
        entries = F.filter(F.split("_text", r"\n\n+"), lambda e: F.trim(e) != "")
        cut = answered.where("answer is null").withColumn("_e", entries).withColumn("_again", (F.length("_text") > least) & (F.size("_e") > 1))
        kept = answered.where("answer is not null").select(*keys, "_path", "answer").unionByName(cut.where("not _again").select(*keys, "_path", "answer"))
        seen = kept if seen is None else seen.unionByName(kept)
        again = cut.where("_again").withColumn("_half", _better_half(F.col("_e")).cast("int"))
        parts = F.array(F.struct(F.lit("0").alias("side"), F.array_join(F.slice("_e", F.lit(1), F.col("_half")), "\n\n").alias("t")), F.struct(F.lit("1").alias("side"), F.array_join(F.slice("_e", F.col("_half") + 1, F.size("_e")), "\n\n").alias("t")))
        pending = again.select(*keys, "_path", F.explode(parts).alias("_p")).select(*keys, F.concat("_path", "_p.side").alias("_path"), F.col("_p.t").alias("_text"))
        number += 1
    ordered = F.array_sort(F.collect_list(F.struct("_path", "answer")))
    whole = seen.groupBy(*keys).agg(F.count("*").alias("_n"), F.count("answer").alias("_there"), F.array_join(F.transform(ordered, lambda x: x["answer"]), "\n\n").alias("answer"))
    return whole.select(*keys, F.when(F.col("_n") == F.col("_there"), F.col("answer")).alias("answer"))
