"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers and the unmarked characters behind it. Where no piece of the model has a marker
behind another character, no piece crosses the start of a chunk, so chunks are segmented independently of each other: each
distinct chunk is segmented and decoded once per task, and ids and text are joined back by position with array lookups.
Whether a model allows this is read from its pieces; if not, whole texts go to the library.

The table lives as long as a task and is emptied once it holds `TABLE_CHARS` characters, so memory is bounded whatever the
texts hold, and a worker that goes on to other work keeps the model only. No shuffle is needed.

Defined cases: null text counts as empty and has no ids; empty tables give empty results; other columns are kept out of the
result, whatever their names; a text of any length is encoded as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import text_of
from tidemark.llm.pieces import give_back, pieces

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: What another than the identity normaliser changes: a ligature, a circled digit, a square, a combining mark.
_ODD = "\ufb01\u2460\u3300e\u0301"
#: Characters of distinct chunks that a worker holds before it starts a new table.
TABLE_CHARS = 2_000_000
#: Bytes of text that are put together at once.
SLICE_BYTES = 500_000

_codecs: dict[tuple[str, bool], Codec] = {}


class Codec:
    """A model with its table of distinct chunks; one that does not decode gives no texts."""

    def __init__(self, model_path: str, decodes: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crosses = any(MARK in p.lstrip(MARK) for p in pieces)
        bytes_of_any = sum(self.model.is_byte(i) for i in range(len(pieces))) == 256  # else unknown neighbours share one id
        marked = self.model.normalize(_ODD) == f"{MARK}{_ODD}" and self.model.decode(self.model.encode("  a b")) == "  a b"
        self.by_chunk, self.decodes = bytes_of_any and marked and not crosses, decodes
        self.clear()

    def clear(self) -> None:
        """Starts an empty table: chunks, without their first marker, to positions of their ids and decoded text."""
        self.index: dict[str, int] = {}
        self.decoded: list[str] = []
        self.same = np.empty(0, bool)
        self.ids, self.counts, self.starts, self.chars = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def learn(self, chunks: list[str]) -> None:
        """Segments chunks that the table does not have; the library itself puts the first marker back."""
        ids = [x if c else [self.model.piece_to_id(MARK)] for c, x in zip(chunks, self.model.encode(chunks, num_threads=1), strict=True)]  # an empty text has no marker
        if self.decodes:
            decoded = self.model.decode(ids, num_threads=1)
            self.same = np.append(self.same, [a == b for a, b in zip(chunks, decoded, strict=True)])
            self.decoded += decoded
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.counts = np.append(self.counts, [len(x) for x in ids]).astype(np.int64)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), np.int32))
        self.starts = np.cumsum(self.counts) - self.counts
        self.chars += sum(map(len, chunks))

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text without their first markers, which stand for a space or the text's start."""
        parts = text.split(" ")
        if "" in parts or MARK in text:
            return [c[1:] for c in _CHUNK.findall(self.model.normalize(text))] if text else []
        return parts

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Number of ids of each text, all ids, and the decoded texts."""
        if not self.by_chunk:
            ids = self.model.encode(texts, num_threads=1)
            return np.array([len(x) for x in ids], np.int64), np.fromiter(chain.from_iterable(ids), np.int32), self.model.decode(ids, num_threads=1) if self.decodes else []
        if self.chars > TABLE_CHARS:
            self.clear()
        parts = [self.chunks(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        found = list(map(self.index.get, flat))
        if None in found:
            self.learn(list(dict.fromkeys(c for c, x in zip(flat, found, strict=True) if x is None)))
            found = map(self.index.__getitem__, flat)
        at = np.fromiter(found, np.int64, len(flat))
        ends = np.cumsum([len(p) for p in parts])
        back = []
        if self.decodes:
            changed = np.r_[0, np.cumsum(~self.same[at])][np.r_[0, ends]]
            back = [t if c == 0 and (p or not t) else " ".join([self.decoded[self.index[x]] for x in p]) for t, p, c in zip(texts, parts, np.diff(changed).tolist(), strict=True)]
        counts = self.counts[at]
        upto = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], counts) + np.arange(upto[-1])]
        return np.diff(upto[np.r_[0, ends]]), ids, back


def codec(model_path: str, decodes: bool = True) -> Codec:
    if (model_path, decodes) not in _codecs:
        _codecs[model_path, decodes] = Codec(model_path, decodes)
    return _codecs[model_path, decodes]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, ids (array of int), and, unless `decode` is false, decoded (the text that the ids give back) per row of `docs`."""
    id_type = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("ids", pa.list_(pa.int32())), *[("decoded", pa.string())] * decode])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model_path, decode)
        try:
            for part in pieces(batches, 1, SLICE_BYTES):
                counts, ids, decoded = table.run(part.column(1).to_pylist())
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), *[pa.array(decoded, pa.string())] * decode], schema=schema)
        finally:
            table.clear()
            give_back()

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(rows, f"doc_id {id_type.simpleString()}, ids array<int>" + ", decoded string" * decode)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() returns."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
