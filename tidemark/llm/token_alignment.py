"""Alignment of two tokenizers over the same texts.

A text with a space before it is cut twice, by a byte-level BPE (A) and by a SentencePiece model (B). Both cuts are lists of byte
offsets at which tokens end. Inside mapInArrow the two lists are merged with one pointer into each: at every offset where either
side ends a token, the pointers name the pair of tokens in front of it, and those that end there move on. So
* links, pairs of tokens whose byte ranges overlap, are one per distinct offset, and
* groups are the stretches between offsets where both pointers move.
The merge runs over all texts of a piece at once: pointers are running counts of ends, and texts end in common offsets.

Each row keeps its distinct id pairs with how often they are linked; that table is written once. Spark counts in how many
documents each pair occurs (combined before the shuffle), takes the highest count of each id on either side, and joins both
back to the rows' pairs: pairs that many rows hold go to every worker (fewer than `COMMON`), rows of all others are shuffled.

Tokens' bytes: an entry of A is decoded from its byte-level letters; a piece of B is its UTF-8 with U+2581 as a space, and <0xHH> is
that byte. Strings of special tokens inside texts are plain text.

Defined cases: texts that are null or empty, or whose bytes either side does not give back (a U+2581 in the text, say), have no tokens
and no groups: zeros and ''; rows that repeat an id are separate rows, and separate documents in the counts; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import materialise, text_of
from tidemark.llm.pieces import pieces
from tidemark.llm.sentencepiece_codec import MARK, Codec
from tidemark.llm.token_files import WordTable

#: Bytes of text that are aligned at once, and characters of distinct words that a worker holds of A before it starts a new table.
SLICE_BYTES, TABLE_CHARS = 500_000, 4_000_000
#: Pairs that more than one in so many (row, pair) have go to every worker; there are fewer than that.
COMMON = 200_000

_aligners: dict[tuple[str, str], Aligner] = {}


def merge(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of two cuts of the same `size` bytes: where each ends, its index in A and in B, and whether a group ends there, too."""
    in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    in_a[ends_a] = in_b[ends_b] = True
    at = np.flatnonzero(in_a | in_b)
    a, b = in_a[at], in_b[at]
    return at, np.cumsum(a) - a, np.cumsum(b) - b, a & b


class Entries:
    """The bytes of a vocabulary's entries."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these entries, one behind the other."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Two tokenizers and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = WordTable(path_a, plain=True, most=TABLE_CHARS), Codec(path_b, decodes=False)
        letters = {v: k for k, v in self.a.printable.items()}
        byte = lambda c: letters.get(c, ord(c) & 255)
        self.entries_a = Entries([bytes(map(byte, self.a.model.id_to_token(i) or "")) for i in range(self.a.vocabulary)])
        model = self.b.model
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.entries_b = Entries([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)])
        # decimal ids with what stands behind them: inside a side, at its end
        self.n, self.m = self.a.vocabulary, len(names)
        self.shown = [f"{i}{end}" for end in ",|" for i in range(self.n)] + [f"{i}{end}" for end in ",;" for i in range(self.m)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts both sides give back, the ends of these (bytes), their ids by A and B, and the numbers of these."""
        raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        length = np.array([len(x) for x in raw], np.int64)
        by_a = self.a.run(texts, spaced=True)
        count_b, ids_b, _ = self.b.run(texts)
        count_a, ids_a, ids_b = np.array([len(x) for x in by_a], np.int64), np.concatenate(by_a) if by_a else np.empty(0, np.int64), ids_b.astype(np.int64)
        good = np.array([bool(t) for t in texts], bool)
        for entries, ids, counts in ((self.entries_a, ids_a, count_a), (self.entries_b, ids_b, count_b)):
            upto = np.r_[0, np.cumsum(entries.size[ids])][np.cumsum(counts)] if len(counts) else np.empty(0, np.int64)
            good &= np.diff(np.r_[0, upto]) == length
        # of those of the right length, all bytes
        wanted = np.frombuffer(b"".join(raw), np.uint8)[np.repeat(good, length)]
        for entries, ids, counts in ((self.entries_a, ids_a, count_a), (self.entries_b, ids_b, count_b)):
            other = entries.joined(ids[np.repeat(good, counts)]) != wanted
            if other.any():
                wrong = np.flatnonzero(good)[np.unique(np.searchsorted(np.cumsum(length[good]), np.flatnonzero(other), side="right"))]
                return self.encode([t if i not in set(wrong.tolist()) else "" for i, t in enumerate(texts)])
        return good, np.cumsum(length[good]), ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)], count_a[good], count_b[good]

    def run(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray]]:
        """Numbers (of A, of B, groups, links), groups and links (id of A * 2^32 + id of B) of each text."""
        if not texts:
            return
        good, ends, a, b, count_a, count_b = self.encode(texts)
        if good.any():
            at, i, j, closes = merge(np.cumsum(self.entries_a.size[a]), np.cumsum(self.entries_b.size[b]), int(ends[-1]))
            links = a[i] << 32 | b[j]
            group = np.cumsum(closes) - closes
            last_i, last_j = np.r_[i[1:] != i[:-1], True], np.r_[j[1:] != j[:-1], True]  # the link with which a token ends
            group_a, group_b = group[last_i], group[last_j]
            before = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, side="right")  # tokens of the other side in front
            codes = np.empty(len(a) + len(b), np.int64)
            codes[np.arange(len(a)) + before[0]] = a + self.n * closes[last_i]
            codes[np.arange(len(b)) + before[1]] = 2 * self.n + b + self.m * closes[last_j]
            link_end, token_end = np.searchsorted(at, ends, side="right"), np.cumsum(count_a + count_b)
            groups = np.diff(np.r_[0, np.cumsum(closes)[link_end - 1]])
            codes, k, link_from, token_from = codes.tolist(), 0, 0, 0
        for ok in good.tolist():
            if not ok:
                yield (0, 0, 0, 0), "", np.empty(0, np.int64)
                continue
            text = "".join(map(self.shown.__getitem__, codes[token_from : token_end[k]]))[:-1]
            mine = links[link_from : link_end[k]]
            yield (int(count_a[k]), int(count_b[k]), int(groups[k]), len(mine)), text, mine
            link_from, token_from, k = link_end[k], token_end[k], k + 1


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times (id pairs of the row as id of A * 2^32 + id of B, and how often each is linked).

    `whole_groups` adds groups, the text whose digest is groups_sha256.
    """
    id_type = docs.schema[id_col].dataType
    number, shown = pa.int64(), [("groups", pa.string())] if whole_groups else []
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), *[(c, number) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(number)), ("times", pa.list_(pa.int32())), *shown])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for part in pieces(batches, 1, SLICE_BYTES):
            numbers, digests, groups, pairs, times = [], [], [], [], []
            for n, text, found in both.run(part.column(1).to_pylist()):
                numbers.append(n)
                digests.append(hashlib.sha256(text.encode()).hexdigest() if len(found) else "")
                if whole_groups:
                    groups.append(text)
                distinct, k = np.unique(found, return_counts=True)
                pairs.append(distinct)
                times.append(k.astype(np.int32))
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in pairs])].astype(np.int32))
            columns = [pa.array(c, number) for c in np.array(numbers, np.int64).reshape(-1, 4).T]
            arrays = [part.column(0), *columns, pa.array(digests, pa.string()), *[pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(groups, pa.string())] if whole_groups else []), schema=schema)

    out = f"doc_id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>" + (", groups string" if whole_groups else "")
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(rows, out)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n: how many rows of links() hold each pair."""
    return linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def ranked_pairs(counts: DataFrame) -> DataFrame:
    """pair, n, a, b, count (n), best_a, best_b: whether no other pair of that id of A, or of B, is in more documents."""
    sides = counts.select("pair", "n", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"))
    most_a = sides.groupBy("a").agg(F.max("n").alias("_most_a"))  # a row per entry of the vocabulary
    most_b = sides.groupBy("b").agg(F.max("n").alias("_most_b"))
    found = sides.join(F.broadcast(most_a), "a").join(F.broadcast(most_b), "b")
    return found.select("pair", "n", "a", "b", F.col("n").alias("count"), (F.col("n") == F.col("_most_a")).alias("best_a"), (F.col("n") == F.col("_most_b")).alias("best_b"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256 for each row of `docs`.

    n_best: links whose pair is in as many documents as any of its id of A; n_best_b: of its id of B; count_sum: the sum of
    the pairs' document counts over the row's links.
    """
    linked = links(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    linked = materialise(linked, "token-links")
    ranked = materialise(ranked_pairs(materialise(pair_counts(linked), "pair-counts")), "ranked-pairs")
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * COMMON > total
    often = F.broadcast(ranked.where(common).select("pair", "count", "best_a", "best_b"))  # fewer than COMMON rows
    seldom = ranked.where(~common).select("pair", "count", "best_a", "best_b")
    each = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    times = F.col("times").cast("long")
    of = lambda met: met.groupBy("row").agg(F.sum(F.when(F.col("best_a"), times).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), times).otherwise(0)).alias("n_best_b"), F.sum(times * F.col("count")).alias("count_sum"))
    # common pairs never leave their task; of the others, a pair is in a small share of rows, so a merge join at every size
    sums = of(each.join(often, "pair")).unionByName(of(each.join(often.select("pair"), "pair", "left_anti").join(seldom.hint("merge"), "pair")))
    sums = sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")])
    found = linked.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("n_best_b"), zero("count_sum"), "groups_sha256")
