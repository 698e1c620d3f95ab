"""Cues that arrive in a stream, merged into blocks as soon as they are there.

The streaming twin of folds.block_parts() and folds.merge_blocks(). Positions of a video's cues run from 1 without gaps; a cue that comes
early waits in the state until those before it are there, so blocks do not depend on how cues are cut into files or in which order these
come. State per video: the open block, and the cues that wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.folds import SENTENCE_END
from tidemark.streaming.ordered import use_state_store

_BLANK = " \t\n\r"
_OPEN = ("part", "start_ms", "end_ms", "text", "n_cues", "chars", "ended")


class Blocks(StatefulProcessor):
    """open: the position that is next, and the block that cues are added to. early: cues whose turn has not come, read and written as one value a batch."""

    def __init__(self, key: str, gap_ms: int, most_chars: int):
        self.key, self.gap_ms, self.most_chars = key, gap_ms, most_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "next long, part long, start_ms long, end_ms long, text string, n_cues long, chars long, ended boolean")
        self.early = handle.getValueState("early", "pos array<long>, start_ms array<long>, end_ms array<long>, text array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        turn, block, touched = 1, None, {}
        if self.open.exists():
            turn, *rest = self.open.get()
            block = dict(zip(_OPEN, rest, strict=True)) if rest[0] is not None else None
        come = {}
        for pdf in rows:
            come.update({int(p): (int(a), int(b), t or "") for p, a, b, t in zip(pdf["pos"], pdf["start_ms"], pdf["end_ms"], pdf["text"], strict=True) if p >= turn})
        waited = {p: cue for p, *cue in zip(*self.early.get(), strict=True)} if self.early.exists() else {}
        come = waited | come
        while turn in come:
            block = self._add(block, *come.pop(turn))
            touched[block["part"]] = block
            turn += 1
        if come:
            self.early.update((list(come), *[[cue[i] for cue in come.values()] for i in range(3)]))
        elif waited:
            self.early.clear()
        self.open.update((turn, *[block[c] for c in _OPEN]) if block else (turn, *[None] * len(_OPEN)))
        if touched:
            parts = list(touched.values())
            yield pd.DataFrame({self.key: [key[0]] * len(parts), **{c: [p[c] for p in parts] for c in ("part", "start_ms", "end_ms")}, "text": [p["text"].strip(_BLANK) for p in parts], "n_cues": [p["n_cues"] for p in parts]})

    def _add(self, block: dict | None, start: int, end: int, text: str) -> dict:
        last = text.strip(_BLANK)[-1:]
        ended = bool(last) and last in SENTENCE_END
        if block is None or start - block["end_ms"] > self.gap_ms or block["ended"] or block["chars"] + len(text) > self.most_chars:
            return {"part": 0 if block is None else block["part"] + 1, "start_ms": start, "end_ms": end, "text": text, "n_cues": 1, "chars": len(text), "ended": ended}
        chars = len(text) if block["chars"] == 0 else block["chars"] + 1 + len(text)
        return {**block, "end_ms": end, "text": block["text"] + " " + text, "n_cues": block["n_cues"] + 1, "chars": chars, "ended": ended}

    def close(self) -> None:
        pass


def merged_blocks(cues: DataFrame, key: str = "video_id", gap_ms: int = 1200, most_chars: int = 1000) -> DataFrame:
    """`key`, part (from 0), start_ms, end_ms, text, n_cues: blocks of a stream of cues (`key`, pos, start_ms, end_ms, text), as they stand after
    each batch that added to them; the last row of a part counts. Null texts count as empty, repeated positions once."""
    use_state_store(cues.sparkSession)
    out = f"{key} {dict(cues.dtypes)[key]}, part long, start_ms long, end_ms long, text string, n_cues long"
    return cues.select(key, "pos", "start_ms", "end_ms", "text").groupBy(key).transformWithStateInPandas(Blocks(key, gap_ms, most_chars), out, "Update", "None")
