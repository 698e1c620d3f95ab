"""Hard-negative mining by a Voronoi-partitioned kNN join.

Scores are inner products of integer vectors. Vectors are augmented so that a larger product is a smaller distance: with M the
largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0); then |a - x|^2 = |a|^2 + M^2 - 2 a.x.

1. Up to `PIVOTS` rows, chosen by a hash of their ids, span Voronoi cells; each row gets its cell and its distance to that pivot.
2. Each anchor meets one block of its own cell; the k-th score found there is a lower bound of its k-th best.
3. Anchors are grouped by cell, a cell of many anchors into several groups. A row of cell j at distance d of its pivot can only
   serve an anchor of cell i if d >= |p_i - p_j| - r_i - D_i, where r_i is the largest distance of an anchor of cell i to its pivot
   and D_i the largest distance at which one of them still takes a row (from its bound). Rows are replicated to the groups of
   those cells only. The bounds are a table of cells by cells.
4. A group meets its rows in tiles: rows of a group are dealt into blocks by a hash, each with the group's anchors. A tile
   holds its anchors and streams its rows in pieces, as products of matrices, and keeps the best `k` of each anchor; the bests of all
   tiles are merged. So rows of a hot cell, or many copies of one vector, are spread, and no pair is a row but the best ones.
5. The same join finds negatives: for each positive, rows of other labels whose score is in its window, the best first. The
   bound of an anchor is then the lower end of its lowest window.

Products are exact: single precision where no product exceeds 2^24, double up to 2^53, integers above.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows without an id, nor
those whose squared length is 2^62 or more (their scores would not fit a long); an empty vector scores 0 with all; missing components of
shorter vectors count as 0; rows that repeat an id are separate rows, ties among them go by a key of the row; equal scores go
by id; windows of positives with a score below 0 hold nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Voronoi cells at most, and rows of a cell on average at least, so that most cells give bounds.
PIVOTS, CELL_ROWS = 128, 200
#: Anchors of a group at most; rows of a block on average at most; blocks of a group at least, so that a group is spread.
GROUP_ANCHORS, BLOCK_ROWS, LEAST_BLOCKS = 16384, 16384, 16
#: Rows of an own-cell block, which only gives bounds.
BOUND_ROWS = 4096
#: Rows, and anchors, of a product of matrices.
PIECE_ROWS, PIECE_ANCHORS = 2048, 512
#: Squared lengths from here on have scores that do not fit a long.
TOO_LONG = float(1 << 62)

_ROW = "key long, id long, label long, v array<long>, norm double"


def prepared(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """key, id, label, v (components floor(256 * x)), norm (squared) of the rows that take part."""
    x = F.col(vector_col)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x")).where("label is not null")
    scaled = F.transform("x", lambda c: F.floor(c.cast("double") * 256))
    kept = kept.withColumn("v", F.when(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) * 65536 < TOO_LONG, scaled))
    kept = kept.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).where(F.col("norm") < TOO_LONG)
    return kept.select(F.monotonically_increasing_id().alias("key"), "id", "label", "v", "norm")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers, padded with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _kind(norm: float) -> type:
    """A type in which products of vectors up to this squared length, and all their partial sums, are exact."""
    return np.float32 if norm < 1 << 24 else np.float64 if norm < 1 << 53 else np.int64


class Cells:
    """Pivots and the distances of augmented vectors to them."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots.astype(np.float64), top
        self.extra = np.sqrt(np.maximum(0, top - (self.pivots**2).sum(1)))
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """Of rows, or of anchors, to each pivot."""
        v = v.astype(np.float64)
        norm = (v**2).sum(1)
        products, own = v @ self.pivots.T, norm if anchors else np.full(len(v), self.top)
        if not anchors:
            products += np.sqrt(np.maximum(0, self.top - norm))[:, None] * self.extra
        return np.sqrt(np.maximum(0, own[:, None] + self.top - 2 * products))

    def between(self) -> np.ndarray:
        return self.distances(self.pivots, False)

    def reach(self, norm: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest distance of a row with a score of `least` or more to anchors of these squared lengths."""
        return np.sqrt(np.maximum(0, norm + self.top - 2 * least))


def place(rows: DataFrame, cells: Cells, width: int) -> DataFrame:
    """`rows` with cell, dist (as rows) and acell, adist (as anchors; null for others)."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, anchor = _matrix(batch.column("v"), width), batch.column("anchor").to_numpy(zero_copy_only=False)
            d = sent.value.distances(v, False)
            acell, adist = np.zeros(len(v), np.int32), np.zeros(len(v))
            if anchor.any():
                of = sent.value.distances(v[anchor], True)
                acell[anchor], adist[anchor] = of.argmin(1), of.min(1)
            new = [pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), pa.array(acell, mask=~anchor), pa.array(adist, mask=~anchor)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "cell", "dist", "acell", "adist"])

    return rows.mapInArrow(placed, f"{_ROW}, anchor boolean, cell int, dist double, acell int, adist double")


class Best:
    """The `k` best rows of each query: the highest scores, then the least ids, then the least keys."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64)  # the score that a row needs now
        self.query, self.score, self.id, self.key = (np.empty(0, np.int64) for _ in range(4))
        self.queries = queries

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids, keys = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.id, ids], np.r_[self.key, keys]
        order = np.lexsort((keys, ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.query, self.score, self.id, self.key = query[place < self.k], score[order], ids[order], keys[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.query[last]] = np.maximum(self.least[self.query[last]], self.score[last])


def _search(anchors: pa.Table, stream: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """One tile: the best `k` rows of the stream for each query of its anchors.

    An anchor has one query for rows of its own label, or one for each positive and rows of other labels.
    """
    a_v, a_key, a_label, a_norm = _matrix(anchors["v"], width), anchors["key"].to_numpy(), anchors["label"].to_numpy(), anchors["norm"].to_numpy()
    windows = anchors["windows"].combine_chunks()
    per = windows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    negatives = bool(len(per)) and bool(per.any())
    own = np.repeat(np.arange(len(per)), per) if negatives else np.arange(len(per))  # the anchor of each query
    if negatives:
        flat = windows.flatten()
        other, high = flat.field("key").to_numpy(), flat.field("score").to_numpy()
        low = high - high // 5  # four fifths, rounded up
    else:
        other, high, low = np.full(len(own), -1, np.int64), None, np.full(len(own), -np.inf)
    best = Best(len(own), k, low)
    kinds: dict[type, np.ndarray] = {}
    for batch in stream:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            part = batch.slice(at, PIECE_ROWS)
            ids, keys, labels = (part.column(c).to_numpy() for c in ("id", "key", "label"))
            kind = _kind(max(float(a_norm.max()), float(part.column("norm").to_numpy().max())))
            if kind not in kinds:
                kinds[kind] = a_v.astype(kind)
            rows = _matrix(part.column("v"), width).astype(kind).T
            for q in range(0, len(own), PIECE_ANCHORS):
                of = own[q : q + PIECE_ANCHORS]
                first = of[0]
                scores = (kinds[kind][first : of[-1] + 1] @ rows)[of - first]
                same = a_label[of][:, None] == labels
                fits = scores >= best.least[q : q + len(of), None].astype(scores.dtype if kind is not np.int64 else np.float64)
                fits &= (~same & (scores <= high[q : q + len(of), None])) if negatives else (same & (a_key[of][:, None] != keys))
                if fits.sum() > 16 * k * len(of):  # only what may be among the best of this piece
                    kept = np.where(fits, scores, -np.inf)
                    fits &= scores >= np.partition(kept, kept.shape[1] - k, axis=1)[:, -k][:, None] if kept.shape[1] > k else True
                i, j = np.nonzero(fits)
                best.add(i + q, scores[i, j].astype(np.int64), ids[j], keys[j])
    if len(best.query):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (a_key[own[best.query]], other[best.query], best.score, best.id, best.key)], names=["anchor", "positive", "score", "id", "key"]
        )


def _tiles(rows: DataFrame, anchors: DataFrame, k: int, width: int) -> DataFrame:
    """anchor (key), positive (key or -1), score, id, key: the best `k` of each query in each tile.

    `rows`: tile and _ROW; `anchors`: the same and windows (an array of key and score of positives; empty: look for positives).
    """
    none = F.array().cast("array<struct<key:long,score:long>>")
    columns = ["tile", "key", "id", "label", "v", "norm"]
    both = anchors.select(*columns, "windows", F.lit(0).alias("side")).unionByName(rows.select(*columns, none.alias("windows"), F.lit(1).alias("side")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((b.slice(int(s), int(e - s)), int(b.column("tile")[int(s)].as_py()), int(b.column("side")[int(s)].as_py())) for b in batches if b.num_rows for s, e in _runs(b))
        ahead = next(parts, None)
        while ahead:
            tile, mine = ahead[1], []
            while ahead and ahead[1] == tile and ahead[2] == 0:
                mine.append(ahead[0])
                ahead = next(parts, None)

            def stream() -> Iterator[pa.RecordBatch]:
                nonlocal ahead
                while ahead and ahead[1] == tile:
                    yield ahead[0]
                    ahead = next(parts, None)

            if mine:
                yield from _search(pa.Table.from_batches(mine), stream(), k, width)
            for _ in stream():  # rows of a tile without anchors, or what is left
                pass

    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "tile").sortWithinPartitions("tile", "side").mapInArrow(run, "anchor long, positive long, score long, id long, key long")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Stretches of one tile and side."""
    tile, side = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
    new = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (side[1:] != side[:-1])])
    yield from zip(new, [*new[1:], batch.num_rows], strict=True)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best `k` of each query over all tiles, with rank; tiles of one query hold `k` rows each at most."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grouped(rows: DataFrame, anchors: DataFrame, cells: Cells, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with tile: anchors in groups of cells, rows replicated to the groups they might serve.

    `anchors` has least, a lower bound of what each still takes (null: none yet).
    """
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(cells.top) - 2 * F.coalesce(F.col("least").cast("double"), F.lit(-np.inf))))
    summary = anchors.groupBy("acell").agg(F.count("*").alias("n"), F.max("adist").alias("r"), F.max(reach).alias("d")).orderBy("acell").collect()  # a row per cell
    if not summary:
        return rows.limit(0).withColumn("tile", F.lit(0).cast("long")), anchors.limit(0).withColumn("tile", F.lit(0).cast("long"))
    between = cells.between()
    at = np.array([s["acell"] for s in summary])
    # neighbouring cells share groups: in the order of their distance to the first of them
    order = at[np.argsort(between[at[0]][at], kind="stable")].tolist()
    n = {s["acell"]: s["n"] for s in summary}
    first, parts, group, held = {}, {}, 0, 0
    for c in order:
        if n[c] > GROUP_ANCHORS:
            group += held > 0
            first[c], parts[c] = group, -(-n[c] // GROUP_ANCHORS)
            group, held = group + parts[c], 0
            continue
        if held + n[c] > GROUP_ANCHORS:
            group, held = group + 1, 0
        first[c], parts[c], held = group, 1, held + n[c]
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_ROWS))
    # the least distance to its pivot from which a row of cell j may serve an anchor of cell i
    least = {s["acell"]: between[s["acell"]] - s["r"] - s["d"] - cells.slack for s in summary}
    bounds = [(j, int(c), float(least[c][j]), first[c], parts[c]) for c in order for j in range(len(between))]
    spark = rows.sparkSession
    table = spark.createDataFrame(bounds, "cell int, acell int, least double, first int, parts int")  # cells by cells
    # per cell: bounds and groups of all anchor cells, as one row, so that a row's groups are found where it is
    served = table.groupBy("cell").agg(F.collect_list(F.struct("least", "first", "parts")).alias("_served"))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    tile = lambda group: group.cast("long") * blocks + block
    wanted = F.array_distinct(F.flatten(F.transform(F.filter("_served", lambda s: F.col("dist") >= s["least"]), lambda s: F.sequence(s["first"], s["first"] + s["parts"] - 1))))
    dealt = rows.join(F.broadcast(served), "cell").select("key", "id", "label", "v", "norm", F.explode(wanted).alias("_group")).withColumn("tile", tile(F.col("_group"))).drop("_group")
    groups = F.broadcast(spark.createDataFrame([(int(c), first[c], parts[c]) for c in order], "acell int, first int, parts int"))
    own = F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))
    sent = anchors.join(groups, "acell").withColumn("_group", own).withColumn("_from", F.col("_group").cast("long") * blocks)
    return dealt, sent.withColumn("tile", F.explode(F.sequence(F.col("_from"), F.col("_from") + (blocks - 1))))


def hard_negatives(rows: DataFrame, anchor: Column, label: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` tells, from the column id, which rows are anchors; `label` is each row's label, from the columns of `rows`. Of each
    anchor, the best `k` other rows of its label are its positives; of each positive, the best `k` rows of other labels with scores between 80
    and 100 hundredths of the positive's are its negatives.
    """
    table = materialise(prepared(rows, label, id_col, vector_col).withColumn("anchor", anchor), "vectors")
    total, top, width = table.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not total:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pivots = table.orderBy(F.xxhash64("id", "v"), "id").limit(min(PIVOTS, -(-total // CELL_ROWS))).select("v").toArrow()
    cells = Cells(np.unique(_matrix(pivots["v"], width), axis=0), top)
    placed = materialise(place(table, cells, width), "placed")

    none = F.array().cast("array<struct<key:long,score:long>>")
    anchors = placed.where("anchor").withColumn("windows", none)
    # a lower bound of each anchor's k-th best score, from a block of its cell
    of_cell = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / BOUND_ROWS).alias("_blocks")))  # a row per cell
    near = lambda df, c: df.join(of_cell.withColumnRenamed("cell", "_cell"), F.col(c) == F.col("_cell")).withColumn("tile", F.col(c).cast("long") * (1 << 40) + F.pmod(F.xxhash64("key"), F.col("_blocks")))
    some = _tiles(near(placed, "cell"), near(anchors, "acell"), k, width)
    least = some.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("score").alias("least")).where(F.col("_n") == k).select(F.col("anchor").alias("key"), "least")
    bounded = materialise(anchors.join(least, "key", "left"), "bounded-anchors")

    positives = materialise(_best(_tiles(*_grouped(placed, bounded, cells, total), k, width), k), "positives")
    windows = positives.where("score >= 0").groupBy(F.col("anchor").alias("key")).agg(F.collect_list(F.struct(F.col("key").alias("key"), "score")).alias("windows"), (F.min("score") - F.expr("min(score) div 5")).alias("least"))
    asked = materialise(anchors.drop("windows").join(windows, "key"), "asked-anchors")
    negatives = _best(_tiles(*_grouped(placed, asked, cells, total), k, width), k)
    known = positives.select("anchor", F.col("key").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = negatives.join(known, ["anchor", "positive"]).join(anchors.select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The contract in SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
