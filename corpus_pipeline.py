"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that the one before kept.

All stages but the last return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and
reads it again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.llm import decontam, linededup, neardup, quality, unigram
from tokenweave.llm.common import table, written
from tokenweave.llm.queries import tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.5); it learns from the labels that are not held out."""
    model = quality.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~quality.held_out("i"))
    return quality.score(docs, model, out="__score").where("__score >= 0.5").drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose key is in at least 10 of them; n_chars follows the text."""
    return linededup.line_dedup(docs, min_docs=10, min_chars=1, keep="none").withColumn("n_chars", F.length("text").cast("bigint"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return neardup.keep_one(docs, n_words=5, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark text."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and the digest of the text that the ids decode to; columns of these names are replaced."""
    model = tokenizer_file(spark, "piece_bpe_32k.model")
    out = unigram.decode(unigram.encode(docs, model), model, out="__decoded")
    return out.withColumns({"n_pieces": F.size("ids").cast("bigint"), "decoded_sha256": F.sha2(F.col("__decoded").cast("binary"), 256)}).drop("__decoded")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
