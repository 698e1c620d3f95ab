"""Token ids in files of fixed-width bits.

Every id takes the least number of bits that the vocabulary needs. A file holds blocks of `BLOCK_IDS` ids, each packed by
itself, and an index at its end: where each block starts, and the id and length of each document. A reader can take any range
of ids by unpacking only the blocks it touches, with numpy operations over whole blocks.

Layout, little-endian throughout:
    magic "TIDEBITS", blocks, index, index length (u64), magic
    index: bits (u32), ids per block (u32), blocks (u64), documents (u64), ids (u64), block starts (u64 each),
           document ids (i64 each), document lengths (u64 each)

Documents are range-partitioned by id at sampled splitters and sorted, one partition makes one file, so the order of files
is the order of ids. A task writes to a name of its own and only then returns the name: files of attempts that failed are
never listed. The list of files is a small table beside them; it gives each file's base offset.

Tokenising uses a table of distinct words per worker: a space between two characters that are no white space always starts a
new pre-token of a byte-level BPE, so what stands between such spaces is tokenised once per worker and joined back by position.
A new word is cut into pre-tokens by the scheme's pattern and these go to the library's BPE model; words with characters beyond
Latin go to the library's full path. Texts in which a space touches other white space, or that hold an added token, are
encoded by the library as a whole.

Defined cases: null text counts as empty, and has the end id only; a null document id sorts last and reads back as null; rows
that repeat an id follow each other; an empty table gives a list without files; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, text_of

MAGIC = b"TIDEBITS"
BLOCK_IDS = 1 << 16
#: Characters of distinct words that a worker holds before it starts a new table.
TABLE_CHARS = 8_000_000
SLICE_CHARS = 2_000_000
_NULL_ID = np.iinfo(np.int64).max
#: The pre-token pattern of byte-level BPE (fixed by that scheme).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[^\0-\u024f]")

_tables: dict[str, WordTable] = {}


class WordTable:
    """A byte-level BPE tokenizer with the words it has met; `plain`: added tokens inside texts are plain text; a table of `most` characters."""

    def __init__(self, path: str, plain: bool = False, most: int = TABLE_CHARS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size(with_added_tokens=True)
        self.model.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.model.get_added_tokens_decoder().values()]
        # the rule above holds where a space starts a word, and nothing is put before the text
        pairs = self.model.pre_tokenizer.pre_tokenize_str("a b. 1 ,é\nz") if self.model.pre_tokenizer else []
        import regex

        self.pattern = regex.compile(PATTERN)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the scheme shows these bytes as themselves
        self.printable = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.by_word = self.model.normalizer is None and [p[0] for p in pairs] == ["a", "Ġb", ".", "Ġ1", "Ġ,", "Ã©", "Ċ", "z"]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.touching, self.chars = np.empty(0, bool), 0
        self.ids, self.counts, self.starts = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Tokenises words, each with a space before it; `touching` marks those that the rule above does not hold for."""
        tokenize, find, printable, space = self.model.model.tokenize, self.pattern.findall, self.printable, self.printable[32]
        found, counts = array("q"), array("q")
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        for word in words:
            if word.isalpha() and word.isascii():
                ids = [t.id for t in tokenize(space + word)]
            elif _BEYOND.search(word):
                ids = self.model.encode(" " + word, add_special_tokens=False).ids
            else:
                shown = [p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(printable) for p in find(" " + word)]
                ids = [t.id for p in shown for t in tokenize(p)]
            found.extend(ids)
            counts.append(len(ids))
        if collecting:
            gc.enable()
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.touching = np.append(self.touching, [not w or w[0].isspace() or w[-1].isspace() for w in words])
        self.ids, self.counts = np.append(self.ids, np.array(found, np.int64)), np.append(self.counts, counts).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.chars += sum(map(len, words))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.int64)

    def run(self, texts: list[str], spaced: bool = False) -> list[np.ndarray]:
        """The ids of each text; `spaced`: of a space and the text."""
        if self.chars > self.most:
            self.clear()
        parts = [t.split(" ") if self.by_word and t and not any(a in t for a in self.added) else [] for t in texts]
        if spaced:  # every word has a space before it
            parts = [["", *p] if p else p for p in parts]
        flat = list(chain.from_iterable(p[1:] for p in parts))
        found = list(map(self.index.get, flat))
        if None in found:
            self.learn(list(dict.fromkeys(w for w, x in zip(flat, found, strict=True) if x is None)))
            found = map(self.index.__getitem__, flat)
        at = np.fromiter(found, np.int64, len(flat))
        counts = self.counts[at]
        upto = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], counts) + np.arange(upto[-1])]
        cuts = np.r_[0, np.cumsum([max(0, len(p) - 1) for p in parts])]
        split = (np.diff(np.r_[0, np.cumsum(self.touching[at])][cuts]) == 0).tolist()
        split = [ok and bool(p) and (len(p) == 1 or spaced or p[0] != "" and not p[0][-1].isspace()) for ok, p in zip(split, parts, strict=True)]
        lead = " " if spaced else ""
        heads = [self.whole(p[0] if s else lead + t) for t, s, p in zip(texts, split, parts, strict=True)]
        ends = upto[cuts].tolist()
        return [np.concatenate((h, ids[a:b])) if s else h for h, s, a, b in zip(heads, split, ends, ends[1:], strict=False)]


def word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after the other, `bits` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype("<u8")[:, None] >> np.arange(bits, dtype="<u8")).astype(np.uint8) & 1
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids `start` to `stop` of packed ids, without unpacking those before."""
    first = start * bits // 8
    raw = np.frombuffer(data[first : -(-stop * bits // 8)] + bytes(8), np.uint8).astype("<u8")
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    low, shift = at >> 3, (at & 7).astype("<u8")
    value = np.zeros(stop - start, "<u8")
    for i in range((bits + 7 + 7) // 8):
        value |= raw[low + i] << np.uint64(8 * i)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64)


#: Spellings of schemes that Spark's file systems know and pyarrow's do not (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def plain_uri(path: str) -> str:
    """A path or URI as pyarrow's file systems take it; dbfs:/ is where such clusters mount it on every machine."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "dbfs":
        return "/dbfs/" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def _filesystem(path: str):
    """pyarrow's file system for a path or URI, on whichever machine this runs."""
    from pyarrow import fs

    path = plain_uri(path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; ids come document by document and leave memory block by block."""

    def __init__(self, path: str, bits: int):
        filesystem, name = _filesystem(path)
        filesystem.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.bits = filesystem.open_output_stream(name), bits
        self.out.write(MAGIC)
        self.at, self.starts, self.documents, self.lengths, self.held, self.n_held, self.ids = len(MAGIC), [], [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append(_NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.int64)
        cut = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, cut, BLOCK_IDS):
            data = pack(ids[i : min(cut, i + BLOCK_IDS)], self.bits)
            self.starts.append(self.at)
            self.at += len(data)
            self.out.write(data)
        self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def close(self) -> int:
        """Writes what is left and the index; returns the number of ids."""
        self._blocks(True)
        head = np.array([self.bits, BLOCK_IDS], "<u4").tobytes() + np.array([len(self.starts), len(self.documents), self.ids], "<u8").tobytes()
        index = head + np.array(self.starts, "<u8").tobytes() + np.array(self.documents, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.out.write(index + np.array([len(index)], "<u8").tobytes() + MAGIC)
        self.out.close()
        return self.ids


class Reader:
    """Random access to one file; as a context it closes the file."""

    def __init__(self, path: str):
        filesystem, name = _filesystem(path)
        self.file = filesystem.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        length = int(np.frombuffer(tail[:8], "<u8")[0])
        index = self.file.read_at(length, size - 16 - length)
        (self.bits, self.block), (blocks, documents, self.ids) = np.frombuffer(index[:8], "<u4").tolist(), np.frombuffer(index[8:32], "<u8").tolist()
        self.starts = np.r_[np.frombuffer(index, "<u8", blocks, 32), size - 16 - length].astype(np.int64)
        self.documents = np.frombuffer(index, "<i8", documents, 32 + 8 * blocks)
        self.ends = np.cumsum(np.frombuffer(index, "<u8", documents, 32 + 8 * (blocks + documents)).astype(np.int64))

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids `start` to `stop` of the file."""
        if start >= stop:
            return np.empty(0, np.int64)
        found = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            data = self.file.read_at(int(self.starts[b + 1] - self.starts[b]), int(self.starts[b]))
            found.append(unpack(data, self.bits, max(0, start - b * self.block), min(self.block, stop - b * self.block)))
        return np.concatenate(found)

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's document number `k`."""
        return self.read(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises `docs` into files below `path` and returns their list: task, file, documents, ids.

    The list is a table at `path`/files, which read() takes as well.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidemark.llm.pieces import slices

        words, writer, n, name = word_table(tokenizer_path), None, 0, f"{path}/{uuid.uuid4().hex}.bits"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(texts, SLICE_CHARS):
                writer = writer or Writer(name, bits_for(words.vocabulary))
                for doc_id, found in zip(ids[part], words.run(texts[part]), strict=True):
                    writer.add(doc_id, np.append(found, end_id))
                    n += 1
        if writer:
            total = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["task", "file", "documents", "ids"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"), "text")
    ordered.mapInArrow(rows, "task int, file string, documents long, ids long").write.parquet(f"{path}/files")
    return spark.read.schema("task int, file string, documents long, ids long").parquet(f"{path}/files")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (as little-endian unsigned 32-bit integers)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one row per file: a running sum over that many rows is small
    based = files.withColumn("base", F.sum("ids").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "file", F.coalesce("base", F.lit(0)).alias("base"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                with Reader(x["file"]) as reader:
                    starts = np.r_[0, reader.ends[:-1]]
                    step, k = 16 * reader.block, 0
                    while k < len(starts):  # documents that fit in a few blocks, one at least
                        end = max(k + 1, int(np.searchsorted(reader.ends, starts[k] + step, side="right")))
                        ids = reader.read(int(starts[k]), int(reader.ends[end - 1])).astype("<u4")
                        cuts = np.r_[0, reader.ends[k:end] - starts[k]]
                        offsets = pa.py_buffer((cuts * 4).astype(np.int32).tobytes())
                        data = pa.Array.from_buffers(pa.binary(), end - k, [None, offsets, pa.py_buffer(ids.tobytes())])
                        doc_ids = reader.documents[k:end]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL_ID), pa.array(starts[k:end] + x["base"]), pa.array(np.diff(cuts)), data], names=["doc_id", "start", "n_tokens", "ids"])
                        k = end

    return based.repartitionByRange(n, "task").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")
