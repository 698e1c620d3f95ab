"""Exact deduplication by content sort.

Texts are normalised, range-partitioned at sampled splitters of their bytes, sorted externally inside each partition,
and compared in full with their neighbours. A splitter carries a short prefix of the text, a hash of all of it and a salt
from the id, so that the sampled keys the driver sees stay short whatever the texts' lengths, and a text that a third of
all rows hold is spread over as many partitions as its share deserves. Runs that touch a partition's border are joined
afterwards, again by comparing whole texts: a border has a handful of runs, so that step is small.

Defined cases: null text counts as empty, all empty texts form one group; a null id sorts after all others; rows that
repeat an id count as separate rows and only one row of a group is `kept`; an empty table gives an empty result; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, materialise, text_of

#: Code points of the text that a splitter holds.
SPLITTER_CHARS = 24

_RUNS = "doc_id {id}, n_chars long, text_sha256 string, task int, run long, head boolean, group_size long, keep_id {id}, edge boolean, edge_text string"


def _runs(id_type: pa.DataType):
    """Turns a partition sorted by (prefix, hash, text, length down, id) into rows that know their run."""
    schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("task", pa.int32()), ("run", pa.int64()), ("head", pa.bool_()), ("group_size", pa.int64()), ("keep_id", id_type), ("edge", pa.bool_()), ("edge_text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        first_hash = None
        run, last_text, open_rows = -1, None, []  # open_rows: closed only once the hash changes
        texts: dict[int, str] = {}  # the text of each open run

        def close(part: pa.Table, last: bool) -> pa.RecordBatch:
            runs = part["run"].to_numpy()
            starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
            sizes = np.diff(np.r_[starts, len(runs)])
            head = np.zeros(len(runs), bool)
            head[starts] = True
            at = np.repeat(starts, sizes)
            hashes = part["hash"].to_numpy()
            edge = (hashes == first_hash) | last & (hashes == hashes[-1])
            digests = np.array([hashlib.sha256(texts[r].encode("utf-8", "surrogatepass")).hexdigest() for r in runs[starts].tolist()], object)
            whole = [texts[int(r)] if h and e else None for r, h, e in zip(runs, head, edge, strict=True)] if edge.any() else [None] * len(runs)
            for r in runs[starts].tolist():
                del texts[r]
            ids = part["doc_id"].combine_chunks()
            return pa.RecordBatch.from_arrays([ids, part["n_chars"].combine_chunks(), pa.array(np.repeat(digests, sizes), pa.string()), pa.array(np.full(len(runs), task, np.int32)), pa.array(runs), pa.array(head), pa.array(np.repeat(sizes, sizes)), ids.take(pa.array(at)), pa.array(edge), pa.array(whole, pa.string())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            text, hashes = batch.column("norm"), batch.column("hash").to_numpy(zero_copy_only=False)
            same = np.r_[text[0].as_py() == last_text, pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)] if batch.num_rows > 1 else np.array([text[0].as_py() == last_text])
            runs = run + np.cumsum(~same.astype(bool))
            for i in np.flatnonzero(~same.astype(bool)).tolist():
                texts[int(runs[i])] = text[i].as_py()
            run, last_text = int(runs[-1]), text[batch.num_rows - 1].as_py()
            if first_hash is None:
                first_hash = int(hashes[0])
            open_rows.append(pa.table({"doc_id": batch.column("doc_id"), "n_chars": batch.column("n_chars"), "hash": batch.column("hash"), "run": pa.array(runs)}))
            differs = np.flatnonzero(hashes != hashes[-1])
            if len(differs) or len(open_rows) > 1 and open_rows[-2]["hash"][-1].as_py() != int(hashes[-1]):
                part = pa.concat_tables(open_rows)
                cut = int(np.flatnonzero(part["hash"].to_numpy() != int(hashes[-1]))[-1]) + 1
                yield close(part.slice(0, cut), False)
                open_rows = [part.slice(cut)]
        if open_rows:
            yield close(pa.concat_tables(open_rows), True)

    return rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those identical without ASCII white space. Of a group, the row with the most code points stays, then
    the one with the smallest id.
    """
    text = text_of(text_col)
    norm = F.regexp_replace(text, f"{SPACE}+", "")
    id_type = docs.schema[id_col].dataType
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), norm.alias("norm")).select(
        "doc_id", "n_chars", "norm", F.xxhash64("norm").alias("hash"), F.substring("norm", 1, SPLITTER_CHARS).alias("_prefix")
    )
    placed = keyed.repartitionByRange("_prefix", "hash", F.xxhash64("doc_id")).sortWithinPartitions("_prefix", "hash", "norm", F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    from pyspark.sql.pandas.types import to_arrow_type

    runs = materialise(placed.drop("_prefix").mapInArrow(_runs(to_arrow_type(id_type)), _RUNS.format(id=id_type.simpleString())), "dedup-runs")

    # Runs at partition borders: compare their whole texts again and let the best head win.
    heads = runs.where("edge_text is not null")
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "task", "run")
    won = heads.groupBy("edge_text").agg(F.min(order).alias("best"), F.sum("group_size").alias("total"))
    borders = heads.select("edge_text", "task", "run").join(won, "edge_text").select(
        F.col("task").alias("b_task"), F.col("run").alias("b_run"), F.col("best.i").alias("b_keep"), "total", ((F.col("best.task") == F.col("task")) & (F.col("best.run") == F.col("run"))).alias("b_wins")
    )
    joined = runs.drop("edge_text").join(borders, F.col("edge") & (F.col("task") == F.col("b_task")) & (F.col("run") == F.col("b_run")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("edge"), F.col("b_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("edge"), F.col("total")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("head") & (~F.col("edge") | F.coalesce(F.col("b_wins"), F.lit(False)))).alias("kept"),
        "text_sha256",
    )


#: The same result in SQL.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS rn,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
