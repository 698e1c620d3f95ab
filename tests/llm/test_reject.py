"""The language stage's bound and scripts come from all rows."""

from pyspark.sql import functions as F

from tidemark.llm import language_id


def test_bound_and_scripts_look_at_every_row(spark):
    scored = spark.range(20000).select(F.lit("en").alias("lang"), F.when(F.col("id") >= 19900, 0.95).otherwise(0.1).alias("reject"))
    assert language_id.reject_bound(scored, F.lit(True)) == 0.95 and language_id.reject_bound(scored, F.lit(False)) == language_id.REJECT_FROM
    texts = spark.range(5000).select(F.when(F.col("id") == 4321, "long words, then Широкая").otherwise("words").alias("text"))
    assert language_id.unseen_scripts(texts) == [s for s in language_id.SCRIPTS if s[0] != 0x410]
