"""Ordered folds over cues: blocks, chunks, slices and split points.

A rule that restarts at a boundary it sets itself is a fold. Cues of one video are gathered in order and folded by
`aggregate`: the accumulator holds the rule's state and where parts begin, and grows only there. So a video's cues are one row,
as the data model has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that end a sentence (fixed values).
SENTENCE_END = "。！？.!?；;："
#: Ends of sentences and clauses where a chunk may be cut, with closing marks behind them (fixed patterns).
SENTENCE_CUT = r"[.!?。！？][\s\"'）\]}]*$"
CLAUSE_CUT = r"[,;:，；：、][\s\"'）\]}]*$"


def ends_sentence(text: Column) -> Column:
    last = F.right(F.btrim(text, F.lit(" \t\n\r")), F.lit(1))
    return (last != "") & F.lit(SENTENCE_END).contains(last)


def _fold(cues: DataFrame, keys: list[str], state: Column, starts_new, after) -> DataFrame:
    """Adds part (from 0) to cues (`keys`, pos, ...): a new part begins where `starts_new(state, cue)` holds.

    `state` has a field n (cues in the part) besides the rule's own; `after(state, cue, new)` gives those others.
    """
    others = [c for c in cues.columns if c not in keys]
    packed = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in others if c != "pos"]))).alias("_cues"))

    def step(acc: Column, cue: Column) -> Column:
        s, at = acc["s"], (acc["at"] + 1).cast("int")
        new = (s["n"] > 0) & starts_new(s, cue)
        n = F.when(new, 1).otherwise(s["n"] + 1).cast("int")
        begins = F.when(new, F.concat(acc["begins"], F.array(at))).otherwise(acc["begins"])
        return F.struct(F.struct(n.alias("n"), *after(s, cue, new)).alias("s"), at.alias("at"), begins.alias("begins"))

    begins = F.aggregate("_cues", F.struct(state.alias("s"), F.lit(0).alias("at"), F.array(F.lit(1)).alias("begins")), step, lambda acc: acc["begins"])
    folded = packed.select(*keys, "_cues", begins.alias("_begins"))
    upto = lambda k: F.coalesce(F.get("_begins", k + 1), F.size("_cues") + 1)
    parts = F.transform("_begins", lambda at, k: F.struct(k.cast("int").alias("part"), F.slice("_cues", at, upto(k) - at).alias("cues")))
    rows = folded.select(*keys, F.explode(parts).alias("_p")).select(*keys, F.col("_p.part").alias("part"), F.explode("_p.cues").alias("_c"))
    return rows.select(*keys, "_c.*", "part")


def chunk_parts(cues: DataFrame, keys: list[str], size: str, most_cues: int = 50, most_chars: int = 8000) -> DataFrame:
    """Greedy chunks: a new one where the chunk is full, or where the cue's `size` would make it too long."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"))
    new = lambda s, c: (s["n"] >= most_cues) | (s["chars"] + c[size] > most_chars)
    after = lambda s, c, new: [(F.when(new, F.lit(0)).otherwise(s["chars"]) + c[size]).cast("long").alias("chars")]
    return _fold(cues, keys, start, new, after)


def block_parts(cues: DataFrame, keys: list[str], gap_ms: int = 1200, most_chars: int = 1000) -> DataFrame:
    """Blocks of cues (pos, start_ms, end_ms, text): a new one after a long gap, a sentence's end, or too many characters.

    The spaces that join texts count for what a block has, not for the cue that may join it.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("last_end"), F.lit(False).alias("ended"))
    new = lambda s, c: (c["start_ms"] - s["last_end"] > gap_ms) | s["ended"] | (s["chars"] + F.length(c["text"]) > most_chars)

    def after(s: Column, c: Column, new: Column) -> list[Column]:
        fresh = new | (s["chars"] == 0)
        chars = F.when(fresh, F.length(c["text"])).otherwise(s["chars"] + 1 + F.length(c["text"])).cast("long")
        return [chars.alias("chars"), c["end_ms"].alias("last_end"), ends_sentence(c["text"]).alias("ended")]

    return _fold(cues, keys, start, new, after)


def merge_blocks(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: its bounds, its cues' texts joined by spaces, how many there are."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return parts.groupBy(*keys, "part").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.btrim(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), F.lit(" \t\n\r")).alias("text"), F.count("*").alias("n_cues"))


def text_slices(text: Column, size: int) -> Column:
    """Slices of `size` code points; none of an empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def split_points(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Where to cut a chunk in two: near the middle, better after a sentence's end than after a clause's.

    `keys`, split_at (cues in the first half), score. Candidates lie between a quarter and three quarters; the first best wins.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    seen = cues.select(*keys, "pos", "text", n.alias("n"), at.alias("i")).where("n >= 2")
    low, high, mid = F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.least(F.col("n") - 1, F.floor(F.col("n") * 3 / 4)), F.floor(F.col("n") / 2)
    bonus = F.when(F.col("text").rlike(SENTENCE_CUT), 2.0).when(F.col("text").rlike(CLAUSE_CUT), 1.0).otherwise(0.0)
    score = 1.0 - F.abs(F.col("i") - mid) / (high - low + 1) + bonus
    ranked = seen.where((F.col("i") >= low) & (F.col("i") <= high)).withColumn("score", score)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "i"))
    return ranked.withColumn("_r", best).where("_r = 1").select(*keys, F.col("i").alias("split_at"), "score")
