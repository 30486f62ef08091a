"""A synthetic corpus: runs of words w0, w1, ... with Zipf frequencies, made from hashes, so any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenweave.operators.sampling import roll


def corpus(spark: SparkSession, sentences: int, vocabulary: int, min_words: int, max_words: int, seed: int = 42) -> DataFrame:
    """(run, pos, word): each run has min_words to max_words words; word i has weight 1 / (i + 1)."""
    if not 0 < min_words <= max_words or vocabulary < 1:
        raise ValueError("0 < min_words <= max_words and vocabulary >= 1 are needed")
    words = spark.range(vocabulary).select(F.col("id").alias("i"), (F.lit(1.0) / (F.col("id") + 1)).alias("w"))
    table = words.select("i", F.sum("w").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("hi"))  # the vocabulary only
    total = 0.0
    for i in range(vocabulary):
        total += 1.0 / (i + 1)
    n = F.lit(min_words) + F.floor(roll(seed, F.lit("n"), F.col("id")) * (max_words - min_words + 1)).cast("int")
    runs = spark.range(sentences).select(F.col("id").alias("run"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    # Ranges of the cumulative weights meet the rolls by an equal number of the integer part, then the exact range.
    span = table.select("i", "hi", F.coalesce(F.lag("hi").over(Window.orderBy("i")), F.lit(0.0)).alias("lo"))
    span = span.select("i", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * 16), F.floor(F.col("hi") * 16))).alias("b"))
    rolled = runs.withColumn("x", roll(seed, F.col("run"), F.col("pos")) * F.lit(total))
    got = rolled.withColumn("b", F.floor(F.col("x") * 16)).join(F.broadcast(span), "b").where("x >= lo and x < hi")
    return got.select("run", "pos", F.concat(F.lit("w"), F.col("i")).alias("word"))
