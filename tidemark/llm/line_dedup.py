"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

The state is a table with one row per line key: in how many documents it is, and the smallest and largest of their ids; and
the postings, a row per key and document that has it. A key is a digest (128 bits) of the stripped, lower-cased line.
Documents are added to both tables or taken from them, so that they can come and go; only keys that a batch touches are counted
anew. Beside the tables, one cuckoo filter per shard holds the keys that several documents share, about `SHARD_KEYS` each.
Reading a corpus, only lines that the filters let through are looked up in the exact table; the filters err on one side only, so
no repeated line is missed and the table decides on the rest.

Filters of all shards go to the workers while they are below `FILTER_BYTES` together, which is checked; beyond it lines are
dealt to tasks by shard, each behind its shard's filter, with the same result. Counting combines rows before the shuffle, so a
line that a third of the documents hold costs one row per task, and its lookups are spread over all tasks. A document's lines
are put together where its text is.

Defined cases: a null or empty text is one empty line; keys shorter than `min_chars` code points are never dropped; a line
that repeats inside one document only stays; rows that repeat an id are one document for that rule, and each row keeps its
own lines; a null id counts as the largest; an empty table gives an empty result; other columns are ignored. Documents come and go by id: all rows of an id together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, lookup, materialise, text_of
from tidemark.llm.pieces import pieces

#: Most bytes of filters that are sent to every worker, and keys in a shard on average.
FILTER_BYTES, SHARD_KEYS = 32 << 20, 100_000
#: Bytes of text that a worker splits into lines at once: a text of short lines takes many times its bytes as Python objects.
SLICE_BYTES = 500_000
#: Tasks that the lines of one shard are dealt over where filters are not sent to every worker.
SPREAD = 16
_BLANK = b" \t\n\x0b\x0c\r"
_LAST_ID = np.iinfo(np.int64).max

COUNTS = "key binary, n_docs long, min_doc long, max_doc long"
FILTERS = "shard int, shards int, filter binary"


class CuckooFilter:
    """Sets of 128-bit digests, four 16-bit fingerprints to a bucket, with deletion. Operations take arrays of digests."""

    SLOTS = 4

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, capacity) / (0.8 * self.SLOTS)))))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    @staticmethod
    def digests(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = np.maximum(digests[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        first = (digests[:, 0] >> np.uint64(8)).astype(np.int64) & (len(self.table) - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(digests)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(1)

    def _place(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; returns which found one."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        free = self.table[sorted_] == 0
        fits = rank < free.sum(1)
        slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
        self.table[sorted_[fits], slot[fits]] = print_[order[fits]]
        done = np.zeros(len(bucket), bool)
        done[order[fits]] = True
        return done

    def insert(self, digests: np.ndarray) -> bool:
        """Adds keys; False if the filter is too full, and then it must be built anew, larger."""
        print_, a, b = self._places(digests)
        left = ~self._place(a, print_)
        left[left] = ~self._place(b[left], print_[left])
        for bucket, p in zip(b[left].tolist(), print_[left].tolist(), strict=True):
            for step in range(500):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = p
                    break
                slot = (p + step) % self.SLOTS
                p, self.table[bucket, slot] = int(self.table[bucket, slot]), p
                bucket = int(self._other(np.array([bucket]), np.array([p], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, digests: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        for p, *both in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            for bucket in both:
                if len(at := np.flatnonzero(self.table[bucket] == p)):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).astype(np.uint16))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter of just these keys."""
        digests, capacity = cls.digests(keys), len(keys)
        while not (made := cls(capacity)).insert(digests):
            capacity = 2 * max(1, capacity)
        return made


def split_lines(text: str, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and the digest of each one's key, or None if that is too short."""
    import xxhash

    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.lower().strip(_BLANK) for x in lines]
    long = [len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "surrogatepass")) >= min_chars) for k in keys]
    return lines, [xxhash.xxh3_128_digest(k) if ok else None for k, ok in zip(keys, long, strict=True)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("doc_id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("h"))


def shard_of(key: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long") % shards).cast("int")


def _shards(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u4")[3::4].astype(np.int64) % shards


def line_keys(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", filters: list[tuple[int, int, bytes]] | None = None, hashed: bool = False) -> DataFrame:
    """doc_id, key: the distinct keys of each row's lines; with all shards' filters (shard, shards, filter), only those they let through.

    `hashed` adds h, a hash of the row's text: rows of one id, or without one, are told apart by it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None if sent is None else {s: CuckooFilter.from_bytes(f) for s, _, f in sent.value}
        shards = sent.value[0][1] if sent is not None and sent.value else 1
        for batch in pieces(batches, 1, SLICE_BYTES):
            ids, hashes, keys = [], [], []
            for doc_id, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {k for k in split_lines(text, min_chars)[1] if k is not None}
                keys += own
                ids += [doc_id] * len(own)
                hashes += [h] * len(own)
            if tables is not None and keys:
                digests, of = CuckooFilter.digests(keys), _shards(keys, shards)
                kept = np.zeros(len(keys), bool)
                for s in np.unique(of).tolist():
                    if s in tables:
                        at = of == s
                        kept[at] = tables[s].contains(digests[at])
                ids, hashes, keys = np.array(ids, np.int64)[kept], np.array(hashes, np.int64)[kept], [k for k, ok in zip(keys, kept.tolist(), strict=True) if ok]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), *([pa.array(hashes, pa.int64())] if hashed else [])], names=["doc_id", "key", *(["h"] if hashed else [])])

    return _rows(docs, id_col, text_col).mapInArrow(rows, "doc_id long, key binary" + (", h long" if hashed else ""))


def _behind_filters(keys: DataFrame, filters: DataFrame, shards: int, hot: DataFrame) -> DataFrame:
    """Rows of `keys` (doc_id, key, h) that their shard's filter lets through: filters and keys meet by shard, filters first.

    `hot` keys (key; fewer than HOT rows), which are known to be repeated, need no filter: their rows are dealt over all tasks. So no key
    left has more than one in HOT rows, and SPREAD tasks a shard are enough.
    """
    none = F.lit(None)
    tasks = max(shards, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = keys.join(F.broadcast(hot.select("key", F.lit(True).alias("_hot"))), "key", "left")
    free = F.coalesce("_hot", F.lit(False))
    shard = F.when(free, F.lit(-1)).otherwise(shard_of(F.col("key"), shards))
    part = F.pmod(F.xxhash64("doc_id", "h"), F.when(free, F.lit(tasks)).otherwise(F.lit(SPREAD))).cast("int")
    lines = marked.select(shard.alias("shard"), part.alias("part"), F.lit(1).alias("kind"), none.cast("binary").alias("filter"), "doc_id", "key", "h")
    sent = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), F.lit(0).alias("kind"), "filter", none.cast("long").alias("doc_id"), none.cast("binary").alias("key"), none.cast("long").alias("h"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = None, None
        for batch in batches:
            of, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            kept = of == -1
            for s in dict.fromkeys(of[of >= 0].tolist()):
                at = np.flatnonzero(of == s)
                if kind[at[0]] == 0:
                    shard, table = s, CuckooFilter.from_bytes(batch.column("filter")[int(at[0])].as_py())
                at = at[kind[at] == 1]
                if s == shard and len(at):
                    kept[at] = table.contains(CuckooFilter.digests(batch.column("key").take(pa.array(at)).to_pylist()))
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("doc_id", "key", "h")], names=["doc_id", "key", "h"])

    return lines.unionByName(sent).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "kind").mapInArrow(rows, "doc_id long, key binary, h long")


def counted(postings: DataFrame) -> DataFrame:
    """key, n_docs, min_doc, max_doc of postings (doc_id, key)."""
    return postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))


def reference_counts(docs: DataFrame, min_chars: int = 10, **columns: str) -> DataFrame:
    """key, n_docs, min_doc, max_doc over all lines of `docs`."""
    return counted(line_keys(docs, min_chars, **columns))


def repeated() -> Column:
    """Whether a key is in two documents at least."""
    return F.col("min_doc") < F.col("max_doc")


def insert(counts: DataFrame, postings: DataFrame, come: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and postings after the documents with the postings `come` came (line_keys() gives these)."""
    both = counts.unionByName(counted(come))
    both = both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("min_doc").alias("min_doc"), F.max("max_doc").alias("max_doc"))
    return both, postings.unionByName(come)


def delete(counts: DataFrame, postings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and postings after the documents with the postings `gone` went. Only keys that these had are counted anew."""
    left, touched = postings.join(gone.distinct(), ["doc_id", "key"], "left_anti"), gone.select("key").distinct()
    return counts.join(touched, "key", "left_anti").unionByName(counted(left.join(touched, "key", "left_semi"))), left


def build_filters(counts: DataFrame, shard_keys: int = 0) -> DataFrame:
    """shard, shards, filter: a cuckoo filter of the repeated keys of each shard; `shard_keys` of them (`SHARD_KEYS` if 0) on average."""
    keys = counts.where(repeated()).select("key")
    shards = max(1, -(-keys.count() // (shard_keys or SHARD_KEYS)))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "shards": [shards], "filter": [CuckooFilter.of(pdf["key"].tolist()).to_bytes()]})

    return keys.select("key", shard_of(F.col("key"), shards).alias("shard")).groupBy("shard").applyInPandas(make, FILTERS)


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Filters after keys (a column `key`) became repeated and others ceased to be. A shard that gets too full comes back
    without a filter, as it stays until build_filters() makes it anew. Null keys count for nothing, repeated ones once."""
    first = filters.select("shards").first()
    shards = first["shards"] if first else 1
    batch = lambda keys, add: keys.where("key is not null").select("key").distinct().select("key", F.lit(add).alias("add"))
    changes = batch(added, True).unionByName(batch(removed, False)).withColumn("shard", shard_of(F.col("key"), shards))

    def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held, ok = old["filter"].iloc[0] if len(old) else None, True
        shard = int((old if len(old) else new)["shard"].iloc[0])
        if len(old) and held is None:
            return pd.DataFrame({"shard": [shard], "shards": [shards], "filter": [None]})
        table = CuckooFilter.from_bytes(held) if held is not None else CuckooFilter(len(new))
        gone, come = new.loc[~new["add"].astype(bool), "key"].tolist(), new.loc[new["add"].astype(bool), "key"].tolist()
        if gone:
            table.delete(CuckooFilter.digests(gone))
        if come:
            ok = table.insert(CuckooFilter.digests(come))
        return pd.DataFrame({"shard": [shard], "shards": [shards], "filter": [table.to_bytes() if ok else None]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, FILTERS)


def drop_lines(docs: DataFrame, counts: DataFrame, filters: DataFrame | None = None, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays) per row of `docs`.

    `counts` are the reference counts of a corpus that holds `docs`; `filters` those of build_filters().
    """
    keys = line_keys(docs, min_chars, id_col, text_col, hashed=True) if filters is None else None
    if filters is not None:
        bytes_, shards = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
        if bytes_ <= FILTER_BYTES:
            keys = line_keys(docs, min_chars, id_col, text_col, [(r["shard"], r["shards"], bytes(r["filter"])) for r in filters.collect()], True)  # FILTER_BYTES at most
        else:
            lines = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
            hot = counts.where(repeated() & (F.col("n_docs") * HOT > lines)).select("key")  # fewer than HOT rows
            keys = _behind_filters(line_keys(docs, min_chars, id_col, text_col, hashed=True), filters, shards, hot)
    shared = counts.where(repeated()).select("key", F.col("n_docs").alias("n"), "min_doc")
    gone = lookup(keys, shared, "key", F.xxhash64("doc_id", "h")).where(F.col("doc_id") > F.col("min_doc"))
    gone = gone.groupBy("doc_id", "h").agg(F.collect_set("key").alias("gone"))  # at most a text's own lines

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, SLICE_BYTES):
            n, dropped, kept = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if keys:
                    lines, own = split_lines(text, min_chars)
                    out = set(keys)
                    stay = [x for x, k in zip(lines, own, strict=True) if k not in out]
                    n.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                else:
                    n.append(text.count("\n") + 1)
                    dropped.append(0)
                    kept.append(text)
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == _LAST_ID), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return _rows(docs, id_col, text_col).join(gone, ["doc_id", "h"], "left").select("doc_id", "text", "gone").mapInArrow(rows, "doc_id long, n_lines long, n_dropped long, kept string")


#: The contract's line dedup in SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.*, m.key IS NOT NULL AND k.doc_id <> m.first_doc AS gone FROM k LEFT JOIN m USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
