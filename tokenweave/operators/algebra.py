"""Model algebra: weighted combination and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(models: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Sum of the models, each count first scaled by its model's weight and rounded half to even; counts <= 0 go."""
    if not models:
        raise ValueError("at least one model is needed")
    weights = [1.0] * len(models) if weights is None else list(weights)
    if len(weights) != len(models):
        raise ValueError("there must be as many weights as models")
    scaled = [m.select("state", "follow", F.bround(F.col("n") * F.lit(float(w))).cast("bigint").alias("n")).where("n > 0") for m, w in zip(models, weights)]
    return reduce(DataFrame.unionByName, scaled).groupBy("state", "follow").agg(F.sum("n").alias("n"))


def prune(model: DataFrame, min_count: int = 2) -> DataFrame:
    """Transitions seen at least min_count times; a state without any is gone with them."""
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    return model.where(F.col("n") >= min_count)


def removed(model: DataFrame, min_count: int = 2) -> DataFrame:
    """n_removed: how many transitions prune takes away."""
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    return model.agg(F.count_if(F.col("n") < min_count).alias("n_removed"))
