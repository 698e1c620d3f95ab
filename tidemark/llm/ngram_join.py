"""Exact Jaccard self-join on word n-grams: size-banded tiles, hashed bitmaps, sorted-array intersection.

1. A document is the set of its n-grams, as sorted 64-bit hashes; equal sets share a digest and are one node from here on.
2. Survivors: a set that links to another lacks few of its elements there. Of its least hashes, half as many again as it may lack are
   sent to a count of who has them; unless enough of these occur in another set too, it can link to nothing and leaves.
   Candidates: survivors order their elements by how many survivors have them, the rarest first, then by hash. Two linked sets
   share an element among as many of their first ones as a set may lack in a linked one, and one more. Elements of no other
   set, and passages that many unrelated texts share, thus say nothing: the former have no partner, the latter stand last.
   Buckets of one such element are linked to their least node, not pairwise, and connected components of these links hold all
   pairs that can reach the threshold.
3. Tiles: a component's sets are dealt into blocks of bounded size by size band; two blocks make a tile if their bands touch. In a
   tile, bitmaps of hashed elements are compared by bit counts: an element whose bit the other bitmap lacks is not in the other
   set, which bounds the overlap from above. Pairs that pass are decided by intersecting the sorted arrays. Pairs that are
   already connected in the tile need no comparison, so a tile of near copies costs about one row of it.
4. In a component of more than `PIVOT_FROM` sets, all are first compared with a few pivots; blocks whose sets link to the same
   pivot are not compared with each other, and those that link to none get new pivots while that links many. So groups of near
   copies that grow with the corpus cost in proportion.
5. Components of the verified links give each document its class.

N-grams are compared by 64-bit hashes of their words: two different ones are taken for equal with probability 2^-64 a pair.
Defined cases: documents without words or text have an empty set and link to nothing; fewer words than `n` make one n-gram of
the whole sequence; a null id counts as the largest and reads back as null; rows that repeat an id are separate documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SAMPLED, hot_keys, lookup, materialise, numbered, release, text_of
from tidemark.llm.components import components
from tidemark.llm.pieces import give_back, pieces

#: Sets, and elements, that a block holds on average at most.
BLOCK_SETS, BLOCK_ELEMENTS = 2048, 1_600_000
#: Bits of a bitmap at most; sets of more elements share bits, which loosens the bound and loses nothing.
MAX_BITS = 1 << 15
#: Components of more sets are compared with pivots first.
PIVOT_FROM, PIVOTS = 2000, 8
#: Distinct words whose hashes a worker keeps.
KEPT_WORDS = 200_000
_LAST_ID = np.iinfo(np.int64).max
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of word n-grams; A-Z are lower-cased, words are split at ASCII white space."""

    def __init__(self, n: int):
        from xxhash import xxh3_64_intdigest

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > KEPT_WORDS:
                    self.clear()
                value = xxh3_64_intdigest(word)
                if len(word) < 64:
                    self[word] = value
                return value

        self.n, self.hashes = n, Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        value = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            value = (value ^ h[i : len(h) - n + 1 + i]) * _M3
            value ^= value >> np.uint64(31)
        return np.unique(mixed(value))


def probes(size: int, percent: int) -> tuple[int, int]:
    """How many of its least hashes a set of this size sends, and how many of them a linked set must send as well.

    A set lacks at most `lost` elements in a linked one. Of two linked sets, the one whose sent hashes end first finds all it sent
    but `lost` among those the other sent; the bound returned holds for every partner's size.
    """
    lost = lambda n: n * (100 - percent) // 100
    need = lambda n: min(n - lost(n), lost(n) // 2 + 2)
    return lost(size) + need(size), min(need(size), need(max(1, -(-size * percent // 100))))


def prefix_size(size: Column, percent: int) -> Column:
    """How many elements of a set, in an order that all sets share, must hold one of any linked set's first elements."""
    return size - F.ceil(size * percent / F.lit(100)) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_table(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """doc_id, n_shingles, node (digest), short (its first 64 bits), need, probes (null where the task has sent them before), row (the key in `row_col`)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        shingles, sent = Shingler(n), set()
        for batch in pieces(batches, 1):
            sizes, nodes, needs, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                node = xxh3_128_digest(s.tobytes()) if len(s) else None
                nodes.append(node)
                send, need = probes(len(s), percent)
                needs.append(need)
                if node is None or node in sent:
                    lists.append(None)
                    continue
                if len(sent) > KEPT_WORDS:
                    sent.clear()
                sent.add(node)
                lists.append(_signed(s[:send]))
            short = np.array([int.from_bytes(x[:8], "little", signed=True) if x else 0 for x in nodes], np.int64)
            ends = np.cumsum([0 if x is None else len(x) for x in lists])
            offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[[x is None for x in lists], False])
            values = np.concatenate([x for x in lists if x is not None] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(short), pa.array(needs, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(values)), *batch.columns[2:]], names=["doc_id", "n_shingles", "node", "short", "need", "probes", *batch.schema.names[2:]])

    row = f", row {docs.schema[row_col].dataType.simpleString()}"
    return _rows(docs, id_col, text_col, row_col).mapInArrow(rows, f"doc_id long, n_shingles long, node binary, short long, need int, probes array<long>{row}")


def _rows(docs: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("doc_id"), text_of(text_col).alias("text"), F.col(row_col).alias("row"))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set: the bits of its hashed elements."""
    bits = min(MAX_BITS, max(256, 1 << int(4 * max(map(len, sets)) - 1).bit_length()))
    at = (mixed(np.concatenate(sets)) & np.uint64(bits - 1)).astype(np.int64) + np.repeat(np.arange(len(sets)) * bits, [len(s) for s in sets])
    flags = np.zeros(len(sets) * bits, np.uint8)
    flags[at] = 1
    return np.packbits(flags).view(np.uint64).reshape(len(sets), -1)


class Links:
    """Which sets of a tile are connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        self.root[self.root == self.root[b]] = self.root[a]


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of each other sorted array are in the first."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.r_[0, np.cumsum([len(o) for o in others])[:-1]])


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked between sets marked `left` and sets marked `right`.

    Sets of one label other than 0 are known to be connected. Links inside the result are enough to connect all that reach
    `percent`; they are not all such pairs.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    left, right, label = left[order], right[order], label[order]
    maps = bitmaps([sets[i] for i in order])
    links, found = Links(len(sets)), []
    for v in np.unique(label[label != 0]):
        same = np.flatnonzero(label == v)
        links.root[same] = same[0]
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        at = np.arange(i + 1, end)
        at = at[(links.root[at] != links.root[i]) & (left[i] & right[at] | right[i] & left[at])]
        if not len(at):
            continue
        both = size[i] + size[at]
        need = -(-(both * percent) // (100 + percent))  # the least overlap that reaches the threshold
        most = np.minimum(size[i] - np.bitwise_count(maps[i] & ~maps[at]).sum(1, dtype=np.int64), size[at] - np.bitwise_count(maps[at] & ~maps[i]).sum(1, dtype=np.int64))
        at, need = at[most >= need], need[most >= need]
        if not len(at):
            continue
        linked = at[overlaps(sets[order[i]], [sets[order[j]] for j in at]) >= need]
        for j in linked.tolist():
            if links.root[j] != links.root[i]:
                links.join(i, j)
                found.append((int(order[i]), int(order[j])))
    return found


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[not held or held[-1].column(key)[-1].as_py() != values[0], values[1:] != values[:-1]])
        for a, b in zip(np.r_[0, starts] if not len(starts) or starts[0] else starts, np.r_[starts, len(values)] if not len(starts) or starts[0] else np.r_[starts[1:], len(values)], strict=True):
            if a in starts and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held)
    held, batch = [], None
    give_back()


def _sets(table: pa.Table) -> list[np.ndarray]:
    """The sorted arrays of a table's column elements."""
    lists = table["elements"].combine_chunks()
    values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if len(ends) else []


def _compare_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """a, b: links found in tiles, which are rows tile, node, elements, side (0 left, 1 right, 2 both), label."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "tile"):
            nodes, side = table["node"].to_pylist(), table["side"].to_numpy()
            sets = _sets(table)
            found = compare(sets, side != 1, side != 0, table["label"].to_numpy(), percent) if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], names=["a", "b"])

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(rows, "a binary, b binary")


def _compare_with_pivots(members: DataFrame, percent: int) -> DataFrame:
    """node, pivot (short): the first pivot of its component that a set links to. Blocks hold sets and all their pivots."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "tile"):
            pivot = table["pivot"].to_numpy(zero_copy_only=False)
            nodes, sets = table["node"].to_pylist(), _sets(table)
            at = sorted(np.flatnonzero(pivot).tolist(), key=lambda i: nodes[i])
            rest = [i for i in np.flatnonzero(~pivot).tolist()]
            a, b = [], []
            if rest:
                sizes = np.array([len(sets[i]) for i in rest])
                for p in at:
                    shared = overlaps(sets[p], [sets[i] for i in rest])
                    ok = 100 * shared >= percent * (sizes + len(sets[p]) - shared)
                    a += [nodes[rest[i]] for i in np.flatnonzero(ok).tolist()]
                    b += [nodes[p]] * int(ok.sum())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(rows, "a binary, b binary")


def _band(percent: int) -> Column:
    """Size bands such that linked sets lie in one band or in neighbours."""
    return F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(100 / percent) * 1.000001)).cast("int")


def verified_links(sized: DataFrame, candidates: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: verified links that connect all linked sets of `sized` (node, short, n_shingles, elements) in one of `candidates` (short, comp).

    Also the tables that are of no use once the links are written.
    """
    # sizes of components come from numbers alone; elements are moved once, to a table that all branches read
    keyed = sized.select("short", "n_shingles").join(candidates, "short")
    of_comp = keyed.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total"))
    keys = candidates.join(of_comp, "comp")
    # a merge join at every size: the keys grow with the corpus, and both plans give the same rows
    dealt = sized.select("node", "short", "n_shingles", "elements").join(keys.hint("merge"), "short").drop("short")
    dealt = materialise(dealt, "dealt")
    small = (F.col("sets") <= BLOCK_SETS) & (F.col("total") <= BLOCK_ELEMENTS)
    # components that fit in a block are one tile
    tiles = dealt.where(small).select(F.xxhash64("comp").alias("tile"), "node", "elements", F.lit(2).alias("side"), F.lit(0).cast("long").alias("label"))
    links = _compare_tiles(tiles, percent)

    large = dealt.where(~small)
    if large.isEmpty():
        return links, [dealt]

    # every block of a very large component gets the component's pivots: its least nodes by residue of a hash; what links to
    # none of them gets new ones, as long as a round links a tenth of what is left
    rest, rounds, scratch, seen = large.where(F.col("sets") > PIVOT_FROM).select("comp", "node", "n_shingles", "elements"), [], [], None
    while True:
        sizes = rest.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total")).where(F.col("sets") > PIVOT_FROM)
        blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_ELEMENTS)).cast("int")
        huge = rest.join(sizes.select("comp", blocks.alias("blocks")), "comp")
        turn = F.pmod(F.xxhash64("node", F.lit(len(rounds))), F.lit(PIVOTS)).alias("turn")
        chosen = huge.groupBy("comp", turn).agg(F.min("node").alias("node")).select("comp", "node")
        own = huge.select(F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("tile"), "node", "elements", F.lit(False).alias("pivot"))
        sent = huge.join(chosen, ["comp", "node"]).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "comp", "node", "elements")
        near = materialise(_compare_with_pivots(own.unionByName(sent.select(F.xxhash64("comp", "block").alias("tile"), "node", "elements", F.lit(True).alias("pivot"))), percent), "pivot-links")
        rounds.append(near)
        linked = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        before = rest.count() if seen is None else seen
        rest = materialise(rest.join(linked, "node", "left_anti"), "unlinked")
        scratch.append(rest)
        seen = rest.count()
        if seen <= PIVOT_FROM or seen * 10 > before * 9:
            break
    near = rounds[0]
    for more in rounds[1:]:
        near = near.unionByName(more)
    labels = components(near).select("node", F.xxhash64("root").alias("label"))

    # blocks of a component, by label and size band
    parts = large.select("comp", "node", "n_shingles", "elements").join(labels, "node", "left").withColumn("label", F.coalesce("label", F.lit(0))).withColumn("band", _band(percent))
    parts = materialise(parts, "labelled")
    groups = parts.groupBy("comp", "label", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    a = groups.select("comp", F.col("label").alias("l1"), F.col("band").alias("b1"), F.col("blocks").alias("n1"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("b2"))
    b = groups.select("comp", F.col("label").alias("l2"), F.col("band").alias("b2"), F.col("blocks").alias("n2"))
    unknown = (F.col("l1") == 0) & (F.col("l2") == 0)
    same = (F.col("l1") == F.col("l2")) & (F.col("b1") == F.col("b2"))
    pairs = materialise(a.join(b, ["comp", "b2"]).where((unknown | (F.col("l1") != F.col("l2"))) & ((F.col("b1") != F.col("b2")) | (F.col("l1") <= F.col("l2")))).withColumn("same", same), "tile-pairs")

    mine = F.pmod(F.xxhash64("node"), F.col("mine_of")).cast("int")
    as_left = parts.join(pairs.select("comp", F.col("l1").alias("label"), F.col("b1").alias("band"), "l2", "b2", "same", F.col("n1").alias("mine_of"), F.col("n2").alias("other_of")), ["comp", "label", "band"])
    as_left = as_left.select("comp", F.col("label").alias("l1"), F.col("band").alias("b1"), "l2", "b2", mine.alias("h1"), F.explode(F.sequence(F.when(F.col("same"), mine).otherwise(F.lit(0)), F.col("other_of") - 1)).alias("h2"), "node", "elements", "label", "same").withColumn("side", F.when(F.col("same") & (F.col("h1") == F.col("h2")), 2).otherwise(0))
    as_right = parts.join(pairs.select("comp", F.col("l2").alias("label"), F.col("b2").alias("band"), "l1", "b1", "same", F.col("n2").alias("mine_of"), F.col("n1").alias("other_of")), ["comp", "label", "band"]).withColumn("_last", F.when(F.col("same"), mine).otherwise(F.col("other_of")) - 1).where("_last >= 0")
    as_right = as_right.select("comp", "l1", "b1", F.col("label").alias("l2"), F.col("band").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("h1"), mine.alias("h2"), "node", "elements", "label", "same", F.lit(1).alias("side"))
    both = as_left.unionByName(as_right).select(F.xxhash64("comp", "l1", "b1", "h1", "l2", "b2", "h2").alias("tile"), "node", "elements", "side", "label")
    return links.unionByName(near).unionByName(_compare_tiles(both, percent)), [dealt, *rounds, *scratch, parts, pairs]


def _bucket_links(sized: DataFrame, percent: int) -> DataFrame:
    """a, b: each set's links to the least set of its buckets; linked sets of `sized` (short, n_shingles, elements) are connected by these."""
    every = sized.select("short", F.explode("elements").alias("element"))
    hot = hot_keys(every, "element", "short")
    marked = every.join(F.broadcast(hot.select("element", (F.col("n") * SAMPLED).alias("hot"))), "element", "left")  # fewer than WINDOW_HOT rows
    # one row in, one row out: rows of hot elements are dealt by their set, so no group of the window is large
    own = F.when(F.col("hot").isNotNull(), F.col("short"))
    counted = marked.withColumn("n", F.coalesce("hot", F.count("*").over(Window.partitionBy("element", own)))).where("n > 1").select("short", "element", "n")
    # by rarity in coarse steps, then by hash; the last bits of the hash give way, which may only add candidates
    step = F.least(F.lit(31), F.floor(F.log2(F.col("n").cast("double")) * 1.5)).cast("long")
    place = F.shiftleft(step, 58).bitwiseOR(F.shiftrightunsigned("element", 6))
    # elements of one set; those that no other set has come before these and take places, too
    ranked = counted.groupBy("short").agg(F.sort_array(F.collect_list(place)).alias("places")).join(sized.select("short", "n_shingles"), "short")
    first = prefix_size(F.col("n_shingles"), percent) - (F.col("n_shingles") - F.size("places"))
    buckets = materialise(ranked.where(first > 0).select("short", F.explode(F.slice("places", F.lit(1), first.cast("int"))).alias("place")), "ngram-buckets")
    least = buckets.groupBy("place").agg(F.count("*").alias("n"), F.min("short").alias("least")).where("n > 1")
    return lookup(buckets, least, "place", F.col("short")).where("short != least").select(F.col("short").alias("a"), F.col("least").alias("b"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of `docs`.

    Two documents link when 100 times the size of their sets' intersection is at least `percent` times that of the union.
    `row_col`, a key of rows, adds it as row, and kept: the one row of its class that is first by id and key. Without it rows
    are numbered: texts are fetched by that key, so that rows without an id, or of one id, do not meet each other.
    """
    row = ["row"] if row_col else []
    if not row_col:
        docs, row_col = numbered(docs, list(dict.fromkeys([id_col, text_col]))), "_row"
    sets = materialise(set_table(docs, n, percent, id_col, text_col, row_col), "ngram-sets")

    # sets enough of whose least elements other sets have too
    sent = sets.where("probes is not null").select("short", "need", F.explode("probes").alias("probe"))
    hot = hot_keys(sent, "probe", "short")
    marked = sent.join(F.broadcast(hot.select("probe", F.lit(True).alias("hot"))), "probe", "left")  # fewer than WINDOW_HOT rows
    by_probe = Window.partitionBy("probe", F.when(F.col("hot"), F.col("short")))
    shared = marked.select("short", "need", F.coalesce("hot", F.min("short").over(by_probe) < F.max("short").over(by_probe)).alias("shared")).where("shared")
    survivors = shared.groupBy("short", "need").agg(F.count("*").alias("n")).where("n >= need").select("short")

    # the text of one row for each of them
    picked = materialise(sets.where("node is not null").join(survivors, "short", "left_semi").groupBy("node").agg(F.min("row").alias("row"), F.first("short").alias("short")), "ngram-picked")
    # a merge join at every size: what is picked grows with the corpus
    texts = _rows(docs, id_col, text_col, row_col).join(picked.hint("merge"), "row").select("node", "short", "text")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in pieces(batches, 2):
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in found])].astype(np.int32))
            values = pa.array(_signed(np.concatenate(found)) if found else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["node", "short", "n_shingles", "elements"])

    sized = materialise(texts.mapInArrow(elements, "node binary, short long, n_shingles long, elements array<long>"), "ngram-members")
    candidates = components(_bucket_links(sized, percent)).select(F.col("node").alias("short"), F.col("root").alias("comp"))
    links, scratch = verified_links(sized, candidates, percent)
    roots = components(links)
    release(hot, picked, sized, *scratch)

    # the least row of each distinct set, of each class, and back: hot sets and classes are looked up, not joined
    nodes = sets.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), *[F.min(F.struct("doc_id", r)).alias("first") for r in row])
    classed = materialise(nodes.join(roots, "node", "left").where("n > 1 or root is not null").withColumn("class", F.coalesce("root", "node")), "ngram-classes")
    of_class = classed.groupBy("class").agg(F.count("*").alias("n"), F.min("least").alias("least"), *[F.min("first").alias("first") for _ in row])
    of_node = lookup(classed.select("node", F.col("n").alias("rows"), "class"), of_class, "class", F.xxhash64("node")).withColumnRenamed("rows", "n").drop("class")
    spread = F.xxhash64("doc_id", *row)
    found = lookup(sets.select("doc_id", "n_shingles", "node", *row), of_node, "node", spread)
    shown = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c))
    least = F.coalesce("least", "doc_id")
    kept = [F.col("row"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept")] if row else []  # a row without words is a class of its own
    return found.select(shown("doc_id").alias("doc_id"), "n_shingles", F.when(least != _LAST_ID, least).alias("component_id"), *kept)


#: The same rows of distinct sets, all pairs that share an n-gram and reach each other in size, and all sets reachable by links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS grams FROM w
), d AS (
  SELECT doc_id, len(grams)::BIGINT AS n_shingles, CASE WHEN len(grams) = 0 THEN 'd' || doc_id ELSE sha256(array_to_string(grams, chr(10))) END AS node, grams FROM s
), n AS (
  SELECT node, min(doc_id) AS least, any_value(n_shingles) AS size, any_value(grams) AS grams FROM d GROUP BY node
), g AS (
  SELECT least, size, unnest(grams) AS gram FROM n
), p AS (
  SELECT a.least AS a, b.least AS b FROM g a JOIN g b ON a.gram = b.gram AND a.least <> b.least AND 100 * a.size >= 90 * b.size AND 100 * b.size >= 90 * a.size
  GROUP BY a.least, b.least, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))
), r AS (
  SELECT least AS a, least AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, n_shingles, component_id FROM d JOIN n USING (node) JOIN c ON c.a = n.least
"""
