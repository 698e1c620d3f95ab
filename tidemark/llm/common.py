"""Pieces that the training-data operators share: tables in the shared folder, word patterns, splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and words, as the operators' contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where a session on one machine names none, as in tests, a temporary folder is made and remembered as that setting; on a
    cluster that is an error, because executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Removes, at its end, the tables that operators materialise inside. Write a result before the scope that it comes of ends."""
    held: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), held))
    try:
        yield held
    finally:
        _scopes.reset(token)
        release(*held)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what is read later no longer depends on shuffle files of executors that may be lost, and
    Python stages behind it run once however often the table is read. release(), or the end of a scope() unless it is to
    `keep`, removes the table.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    if _scopes.get() and not keep:
        _scopes.get()[-1].append(table)
    return table


def release(*tables: DataFrame) -> None:
    """Removes materialised tables. Call once everything that reads them is written itself."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of an Arrow batch for Python.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold about BATCH_BYTES, or one row, unless the session has a limit of its own.

    Otherwise they hold 10,000 rows, or 64 MB. Executors keep a batch several times outside their heap, and each worker once more.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


#: Keys that more than one in HOT rows have are hot; so there are fewer than HOT of them.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column, hot: int = HOT) -> DataFrame:
    """`rows` with the columns of `table` (unique `key`, n: how many of `rows` have it); nulls where the table lacks the key.

    Hot keys, those that more than one in `hot` rows have, go to every worker, and their rows, dealt by `spread` instead of the key, never meet in one task. All
    other keys are joined.
    """
    table = materialise(table, "lookup")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    values = [c for c in table.columns if c not in (key, "n")]
    frequent = F.col("n") * hot > total
    often = table.where(frequent).select(key, F.struct(*values).alias("_often"))  # fewer than `hot` rows
    seldom = table.where(~frequent).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_of"), F.struct(*values).alias("_seldom"))
    found = rows.join(F.broadcast(often), key, "left")
    cold = F.col("_often").isNull()
    found = found.withColumn("_k", F.when(cold, F.col(key))).withColumn("_s", F.when(cold, F.lit(0).cast("long")).otherwise(spread))
    joined = found.join(seldom, (F.col("_k") == F.col("_key")) & (F.col("_s") == F.col("_of")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_often.{c}"), F.col(f"_seldom.{c}")).alias(c) for c in values])


#: One in SAMPLED owners is looked at to find hot keys.
SAMPLED = 64


#: Keys that more than one in so many rows have do not enter a window over keys: a window's largest group is then smaller than
#: the mean partition, whatever the number of partitions up to this one.
WINDOW_HOT = 100_000


def hot_keys(rows: DataFrame, key: str, owner: str, hot: int = WINDOW_HOT) -> DataFrame:
    """key, n: keys that more than one in `hot` rows of a sample of owners have, with their number there; fewer than `hot` rows.

    Each one is held by two owners at least. Windows over the other keys then have no large group.
    """
    sample = rows.where(F.pmod(F.xxhash64(owner), F.lit(SAMPLED)) == 0)
    counts = materialise(sample.groupBy(key).agg(F.count("*").alias("n"), F.min(owner).alias("_a"), F.max(owner).alias("_b")), "sampled-keys")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = materialise(counts.where((F.col("n") * hot > total) & (F.col("_a") < F.col("_b"))).select(key, "n"), "hot-keys")
    release(counts)
    return found


def numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `docs` and _row, a key of each row that stays the same however often the table is read.

    It is the row's file, by a hash of 64 bits, and its place in there. What is not a table of files is written first.
    """
    plan = getattr(docs, "_jdf", None)  # a remote session has none
    if plan is None or plan.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        return materialise(docs.select(*columns).withColumn("_row", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows")
    try:
        return docs.select(*columns, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"))
    except AnalysisException:  # files of a format without row numbers
        return materialise(docs.select(*columns).withColumn("_row", F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal form, modulo `modulus`; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")
