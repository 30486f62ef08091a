"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, after each node has tied its larger neighbours to its least one, or to itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()  # m <= the old v < u


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, after each node has tied itself and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node that has a smaller neighbour has only that one neighbour: then the steps change nothing more."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable by edges, for every id that has an edge to another; nulls have none.

    Every step writes its edges to the shared folder, so a lost executor costs a step at most and the driver plans one
    step at a time. It ends when the edges are stars, the only edges that the steps leave as they are. Only edges move;
    hubs are summed before the shuffle and their joins can be split.
    """
    now = C.written(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(now):
        now = C.written(_small_star(C.written(_large_star(now), "edges")), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
