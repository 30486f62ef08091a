"""Models as JSON: ``{"state_size": k, "temperature": t, "chain": [[[word, ...], {follower: count, ...}], ...]}``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.operators import chain
from tokenweave.plans.model import MarkovModel


def to_rows(model: DataFrame) -> DataFrame:
    """(state, json): one element of the chain array for each state, ``[[word, ...], {follower: count, ...}]``."""
    nested = chain.follower_map(model)
    return nested.select("state", F.concat(F.lit("["), F.to_json("state"), F.lit(","), F.to_json("followers"), F.lit("]")).alias("json"))


#: An element of the chain array: its list of words, whose strings may hold brackets and escapes, and its object.
ELEMENT = r'^\s*\[\s*(\[(?:[^"\[\]]*+"(?:[^"\\]++|\\.)*+")*+[^"\[\]]*+\])\s*,\s*(?=\{)(.*)\]\s*$'


def _pair(element: Column) -> Column:
    """struct<s, m>: the state and the followers of an element, parsed at once; an element of another shape is null."""
    return F.from_json(F.regexp_replace(element, "(?s)" + ELEMENT, '{"s":$1,"m":$2}'), "s array<string>, m map<string,bigint>")


def from_rows(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """The model of rows that are elements of the chain array."""
    return rows.select(_pair(F.col(json_col)).alias("p")).select(F.col("p.s").alias("state"), F.explode("p.m").alias("follow", "n"))


def model_json(model: MarkovModel) -> DataFrame:
    """One row, ``json``: the whole model as one document (for models that fit one string)."""
    body = to_rows(model.transitions).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_join("state", " ").alias("k"), "json"))), lambda x: x["json"]), ",").alias("c"))
    head = json.dumps({"state_size": model.state_size, "temperature": model.temperature})[:-1]
    return body.select(F.concat(F.lit(head + ', "chain": ['), "c", F.lit("]}")).alias("json"))


def parse_json(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """(state_size, temperature, state, follow, n): documents' transitions; state_size is the first state's length and a
    missing temperature is 1."""
    doc = docs.select(F.from_json(json_col, "temperature double, chain array<string>").alias("d"))
    first = F.size(_pair(F.get("d.chain", F.lit(0)))["s"])
    flat = doc.select(first.alias("state_size"), F.coalesce("d.temperature", F.lit(1.0)).alias("temperature"), F.explode("d.chain").alias("c"))
    pair = flat.select("state_size", "temperature", _pair(F.col("c")).alias("p"))
    return pair.select("state_size", "temperature", F.col("p.s").alias("state"), F.explode("p.m").alias("follow", "n"))


def save(model: MarkovModel, path: str) -> None:
    """The document as a text file under path (one part), overwriting."""
    model_json(model).coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> MarkovModel:
    """A saved document; an empty chain raises ValueError."""
    rows = parse_json(spark.read.text(path, wholetext=True).toDF("json"))
    first = rows.select("state_size", "temperature").first()
    if first is None:
        raise ValueError("the chain has no states")
    return MarkovModel(rows.select("state", "follow", "n"), first.state_size, first.temperature)


def save_rows(model: MarkovModel, path: str) -> None:
    """The model as JSON lines, one state a line, in parallel; the meta data beside them under path_meta."""
    to_rows(model.transitions).select("json").write.mode("overwrite").text(path)
    model.spark.createDataFrame([(model.state_size, float(model.temperature))], "state_size int, temperature double").coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_meta")


def load_rows(spark: SparkSession, path: str) -> MarkovModel:
    meta = spark.read.json(path.rstrip("/") + "_meta").first()
    return MarkovModel(from_rows(spark.read.text(path).toDF("json")), int(meta.state_size), float(meta.temperature))
