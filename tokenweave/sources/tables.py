"""Models as sorted Parquet tables: the native form for models of any size, looked up by row-group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.functions.tokenize import PROSE, Tokenizer
from tokenweave.operators import generate
from tokenweave.operators.chain import BEGIN, key_words, state_key
from tokenweave.operators.sampling import check_temperature
from tokenweave.operators.stored import Stored, files_of, readable, stored_walk, write_sorted
from tokenweave.operators.walk import paged_walk
from tokenweave.plans.model import MarkovModel

#: 3: a row has its state as key only, and the start index holds the states with sentinels only; others are found by their key. 2: both had all.
VERSION, KNOWN = 3, (2, 3)


def save(model: MarkovModel, path: str, partitions: int | None = None) -> None:
    """transitions sorted by state (column key), the start index sorted by what the states say, and the meta data, under path.

    The model is computed and moved once: the start index is made of the rows that were written, and only of states with sentinels.
    """
    write_sorted(model.transitions.select(state_key(F.col("state")).alias("key"), "follow", F.col("n").cast("bigint").alias("n")), f"{path}/transitions", partitions)
    begun = _rows(model.spark, path).where(F.contains("key", F.lit(BEGIN)) & F.array_contains("state", BEGIN))
    generate.start_index(begun).repartitionByRange("said").sortWithinPartitions("said").write.mode("overwrite").parquet(f"{path}/starts")
    meta = model.spark.createDataFrame([(VERSION, model.state_size, float(model.temperature))], "version int, state_size int, temperature double")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if model.source is not None:
        model.source.select("source").write.mode("overwrite").parquet(f"{path}/source")


def load(spark: SparkSession, path: str, with_source: bool = False) -> MarkovModel:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.version not in KNOWN:
        raise ValueError(f"version {meta.version} of the model tables is not known")
    rows = _rows(spark, path).select("state", "follow", "n")
    return MarkovModel(rows, meta.state_size, meta.temperature, spark.read.parquet(f"{path}/source") if with_source else None)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(key, follow, n, state) of the saved rows."""
    rows = spark.read.parquet(f"{path}/transitions")
    return rows if "state" in rows.columns else rows.withColumn("state", key_words(F.col("key")))


def lookup(spark: SparkSession, path: str, state: list[str]) -> DataFrame:
    """The followers of one state: the filter on the sorted key reaches the scan."""
    return _rows(spark, path).where(F.col("key") == state_key(F.array(*map(F.lit, state)))).select("state", "follow", "n")


#: Keys that a lookup names in its filter; more are joined.
NAMED_KEYS = 1000


def lookup_all(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """The rows of the given states (column state), from the tables."""
    rows = _rows(spark, path)
    keys = states.select(state_key(F.col("state")).alias("key")).distinct()
    some = [r.key for r in keys.limit(NAMED_KEYS + 1).collect()]
    found = rows.where(F.col("key").isin(some)) if len(some) <= NAMED_KEYS else rows.join(keys, "key", "left_semi")
    return found.select("state", "follow", "n")


def _meta(spark: SparkSession, path: str, temperature: float | None):
    """(state_size, temperature): the stored temperature unless another is given."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if temperature is not None:
        check_temperature(temperature)
    return meta.state_size, meta.temperature if temperature is None else temperature


def walk(spark: SparkSession, path: str, requests: DataFrame, seed: int = 0, max_steps: int = 1000, temperature: float | None = None) -> DataFrame:
    """Walks through the tables of a model, which is not loaded: the walking tasks look up the states that they meet, or, where they can't open the tables, a round does for all walks."""
    k, t = _meta(spark, path, temperature)
    files = files_of(spark.read.parquet(f"{path}/transitions"))
    if readable(files):
        return stored_walk(requests, Stored(files, k, t), seed, max_steps)
    return paged_walk(requests, lambda states: lookup_all(spark, path, states), k, t, seed, max_steps)


def make_sentences(spark: SparkSession, path: str, n: int = 1, seed: int = 0, limits: generate.Limits = generate.Limits(), tokenizer: Tokenizer = PROSE, max_steps: int = 1000, temperature: float | None = None) -> DataFrame:
    """walk_id, sentence of n requests, generated from the tables; overlap is tested against the saved source, if there is one."""
    requests = spark.range(n).select(F.col("id").alias("walk_id"), F.lit(None).cast("array<string>").alias("init"))
    source = load(spark, path, True).source if limits.test_output else None
    return generate.make_sentences(requests, None, 0, source, tokenizer.join, limits, seed=seed, walker=lambda tried: walk(spark, path, tried, seed, max_steps, temperature))


def _start_index(spark: SparkSession, path: str) -> DataFrame:
    """(said, state) of all states: what a state without sentinels says is its key, by which the rows are sorted."""
    plain = _rows(spark, path).where(~F.array_contains("state", BEGIN)).select(F.col("key").alias("said"), "state")
    return spark.read.parquet(f"{path}/starts").select("said", "state").unionByName(plain).distinct()


def starts(spark: SparkSession, path: str, beginning: list[str], strict: bool = True, seed: int = 0) -> DataFrame:
    """(state, rank): the states with this beginning, read from one range of the start index."""
    k, _ = _meta(spark, path, None)
    return generate.start_states(_rows(spark, path), k, beginning, strict, seed, _start_index(spark, path))


def make_sentence_with_start(spark: SparkSession, path: str, beginning: list[str], strict: bool = True, seed: int = 0, limits: generate.Limits = generate.Limits(), tokenizer: Tokenizer = PROSE, max_steps: int = 1000, temperature: float | None = None) -> DataFrame:
    """One row: a sentence with this beginning, from the tables: the start states are one range of the index, and walks look states up."""
    k, t = _meta(spark, path, temperature)
    source = load(spark, path, True).source if limits.test_output else None
    walker = lambda tried: walk(spark, path, tried, seed, max_steps, t)
    rows = _rows(spark, path)
    return generate.sentence_with_start(rows, k, beginning, source, tokenizer.join, strict, limits, t, seed, max_steps, starts=_start_index(spark, path), walker=walker)
