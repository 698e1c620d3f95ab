"""The queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, exact_dedup, hard_negatives, language_id, line_dedup, mixing, ngram_join, ppm, quality, sentencepiece_codec, spotsigs, token_alignment, token_files
from tidemark.llm.common import documents, fold, materialise


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each text, from a network trained on two thirds of the documents' sample."""
    docs = documents(spark, sf_dir)
    net = language_id.train(language_id.examples(docs, fold(3) != 1))
    return language_id.identify(docs.select("doc_id", "text"), net).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each text, from a classifier that knows positive and unlabelled texts."""
    docs = documents(spark, sf_dir)
    model, prior = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(3) != 1)
    scored = quality.score(docs, model, prior)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of weights 5, 2, 1 takes of each document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness."""
    found = spotsigs.fingerprints(documents(spark, sf_dir))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length_class")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word n-grams reach a Jaccard of 0.9, by links."""
    return ngram_join.ngram_join(documents(spark, sf_dir), n=3, percent=90)  # rows are numbered by their place in the files


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the text that they decode to."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document has and loses, and a digest of what stays."""
    docs = documents(spark, sf_dir)
    counts = materialise(line_dedup.reference_counts(docs), "line-counts")
    filters = materialise(line_dedup.build_filters(counts), "line-filters")
    return line_dedup.drop_lines(docs, counts, filters).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of each document's ids, as read back from the files."""
    files = token_files.write(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of each text under the byte model and under word frequencies."""
    scored = ppm.score(documents(spark, sf_dir), fold(5) != 1)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text that occur in a window of a benchmark item, and a digest of these items."""
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that are nearly as alike to anchors as their positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of each text's tokens by two tokenizers, and how common the linked ids are."""
    return token_alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_pareto_mix, op4_spotsigs, op5_ngram_join, op6_exact_dedup, op7_sentencepiece, op8_line_dedup, op9_token_files, op10_ppm, op11_decontamination, op12_hard_negatives, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op3_pareto_mix": mixing.ORACLE, "op4_spotsigs": spotsigs.ORACLE, "op5_ngram_join": ngram_join.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_decontamination": decontamination.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
