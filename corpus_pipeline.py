"""A corpus pipeline: language filter, exact dedup, near dedup, mixing to target weights, tokenisation.

Each stage reads what the one before it kept, as a table; all but the last return the columns of documents. Rows are joined to
a stage's decision by their place in that table's files, so rows that repeat an id, or have none, are decided one by one; of
equal rows the first in that order counts as the least. Null texts have no language and go first. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from tidemark.llm.common import bounded_batches, fold, materialise, numbered, release, scope
from tidemark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """COLUMNS of `docs` and _row, a key of each row."""
    return numbered(docs, COLUMNS)


def _keep(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `docs` (with _row) with a _row in `rows`."""
    return docs.join(rows.select("_row"), "_row", "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null or without a letter, and those that the network, which also learns what is no language, mostly takes for that.

    The network learns from every row with a language outside the held-out fold; the bound comes from all rows in it. Texts of
    every learned language stay, and texts in several of them. Where no row has a language to learn, all texts with letters stay.
    """
    bounded_batches(spark)
    net = language_id.train_on_all(docs, fold(3) != 1)
    scored = materialise(language_id.with_reject(docs.select(*COLUMNS), net), "language-scores")
    return scored.where(F.col("reject") <= language_id.reject_bound(scored, fold(3) == 1)).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    bounded_batches(spark)
    docs = _numbered(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    return _keep(docs, exact_dedup.exact_dedup(docs.withColumn("_place", place), id_col="_place").where("kept").select(F.col("doc_id.row").alias("_row")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies: five-word n-grams, a Jaccard of 0.8 or more."""
    bounded_batches(spark)
    docs = _numbered(docs)
    return _keep(docs, ngram_join.ngram_join(docs, n=5, percent=80, row_col="_row").where("kept").select(F.col("row").alias("_row")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes as many copies of each document as the mix of weights 5, 2, 1 asks for; documents it leaves out go."""
    docs = _numbered(docs)
    copies = mixing.mix(docs, row_col="_row").select(F.col("row").alias("_row"), F.col("copies").cast("int").alias("_copies")).where("_copies > 0")
    taken = docs.join(materialise(copies, "copies").hint("merge"), "_row")  # a merge join at every size: the keys grow with the corpus
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, one row per copy."""
    bounded_batches(spark)
    return sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model"), decode=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("SentencePiece", tokens)]

#: The trained network of the first stage has no counterpart in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read back as the next one's input.

    Once a stage's rows are written, the tables it made on the way, and its input, are removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope():
            after = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
