"""Sampling tables: tempered weights, cumulative weights, one move by a given roll."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.operators.chain import joined, split_state
from tokenweave.sources.shared import written

#: Followers of a state beyond which its running sums are spread over partitions; and rows that may be broadcast to join them.
HOT_FOLLOWERS = 500_000
BROADCAST_ROWS = 100_000
#: Followers of a segment.
SEGMENT = 4096


def check_temperature(t: float) -> None:
    if t <= 0:
        raise ValueError("temperature must be greater than 0")


def weight(n: Column, temperature: float) -> Column:
    """n at temperature 1, else n ** (1 / temperature)."""
    check_temperature(temperature)
    return n.cast("double") if temperature == 1.0 else F.pow(n, F.lit(1.0 / temperature))


def _joined(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


#: One in so many followers, by a hash, tells which states are hot.
HOT_SAMPLE = 64


def hot_states(rows: DataFrame, key: str) -> DataFrame:
    """(key) of the states with about HOT_FOLLOWERS followers or more, counted on those followers that a hash picks, so little of the model moves.

    Which states are hot decides where rows go, never what comes out.
    """
    some = rows if HOT_FOLLOWERS < 16 * HOT_SAMPLE else rows.where(F.pmod(F.xxhash64("follow"), F.lit(HOT_SAMPLE)) == 0)
    least = HOT_FOLLOWERS if HOT_FOLLOWERS < 16 * HOT_SAMPLE else HOT_FOLLOWERS // HOT_SAMPLE
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > least).select(key)


@dataclass(frozen=True)
class Hot:
    """What tells which states of a model are hot, and has their rows, without a pass over the whole model: sample, the model of one in HOT_SAMPLE of
    the texts, has at least about that share of a state's followers; part gives the rows of the model of some states (column state)."""

    sample: DataFrame
    part: Callable[[DataFrame], DataFrame]

    def states(self) -> DataFrame:
        key = _key(self.sample)
        return self.sample.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > max(1, HOT_FOLLOWERS // HOT_SAMPLE)).select("key")

    def rows(self, hot: DataFrame) -> DataFrame:
        named = dict(self.sample.dtypes)["follow"] == "string"
        part = self.part(hot.select((split_state(F.col("key")) if named else F.col("key")).alias("state")))
        return part.select(_key(part).alias("key"), "follow", "n")


def _key(model: DataFrame) -> Column:
    """What the rows of a state move by: the key that the model has, or one text made of a state of words."""
    if "key" in model.columns:
        return F.col("key")
    return joined(F.col("state")) if dict(model.dtypes)["follow"] == "string" else F.col("state")


def _summed(rows: DataFrame, keys: list[str], whole: bool, **more: Column) -> DataFrame:
    """rows with lo, hi: running sums of w in order of follow, r, the row's number, within keys, and more. Whole numbers need no second window for lo: hi - w is exact."""
    by = Window.partitionBy(*keys).orderBy("follow")
    out = rows.withColumns({"hi": F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "r": F.row_number().over(by), **more})
    return out.withColumn("lo", F.col("hi") - F.col("w") if whole else F.coalesce(F.lag("hi").over(by), F.lit(0.0)))


def _numbered_cdf(model: DataFrame, temperature: float, told: Hot | None = None) -> DataFrame:
    """key, state, follow, n, w, lo, hi, total, p, r: cdf, the text by which the rows of a state have moved, the part of its state that a row was summed in, and the row's number within its state, from 1.

    A state with more than about HOT_FOLLOWERS followers is no single task: its rows are ranged by follower, summed within each
    partition, and the sums and numbers of the partitions before are carried into it. Rows move by the state's key, a text, and get
    the state back after it. Which states these are is told, if it isn't to be found in the model, which is written then.
    """
    check_temperature(temperature)
    exact = temperature == 1.0
    named = dict(model.dtypes)["follow"] == "string"
    w = lambda some: some.withColumn("w", weight(F.col("n"), temperature))
    rows = model.select(_key(model).alias("key"), "follow", "n")
    whole = lambda keys: Window.partitionBy(*keys).orderBy("follow").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def plain(some: DataFrame) -> DataFrame:
        if exact:
            return _summed(w(some), ["key"], exact, total=F.sum("w").over(whole(["key"])), p=F.lit(0))
        return _summed(w(some), ["key"], exact, p=F.lit(0)).withColumn("total", F.last("hi").over(whole(["key"])))

    columns = ["key", (split_state(F.col("key")) if named else F.col("key")).alias("state"), "follow", "n", "w", "lo", "hi", "total", "p", "r"]
    hot = written(hot_states(rows, "key") if told is None else told.states(), "hot-states")
    if hot.isEmpty():
        return plain(rows).select(*columns)
    rows = rows if told else written(rows, "weights")
    some = told.rows(hot) if told else _joined(rows, hot, ["key"], "left_semi")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = written(w(some).repartitionByRange(cores, "key", "follow").withColumn("p", F.spark_partition_id()), "hot-rows")
    local = _summed(parts, ["key", "p"], exact)
    sums = local.groupBy("key", "p").agg(F.max("hi").alias("s"), F.max("r").alias("m"))  # the last of the running sums, so parts join without a gap
    before = Window.partitionBy("key").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumns({"before": F.coalesce(F.sum("s").over(before), F.lit(0.0)), "above": F.coalesce(F.sum("m").over(before), F.lit(0))})
    carry = written(carry.withColumn("total", F.max(F.col("before") + F.col("s")).over(Window.partitionBy("key"))).drop("s", "m"), "hot-sums")
    spread = _joined(local, carry, ["key", "p"], "inner").withColumns({"lo": F.col("lo") + F.col("before"), "hi": F.col("hi") + F.col("before"), "r": F.col("r") + F.col("above")})
    return plain(_joined(rows, hot, ["key"], "left_anti")).select(*columns).unionByName(spread.select(*columns))


def cdf(model: DataFrame, temperature: float = 1.0, told: Hot | None = None) -> DataFrame:
    """state, follow, n, w, lo, hi, total: half-open ranges [lo, hi) of each follower, in order of follow."""
    return _numbered_cdf(model, temperature, told).drop("key", "p", "r")


def segments(model: DataFrame, temperature: float = 1.0) -> DataFrame:
    """state, lo, hi, total, degree, follows, his: the cdf in rows of at most SEGMENT followers, so that a row is bounded whatever its state; degree: followers of the row."""
    rows = _numbered_cdf(model, temperature).withColumn("b", F.floor((F.col("r") - 1) / SEGMENT))
    entry = F.array_sort(F.collect_list(F.struct("hi", "follow")))  # his ascend, and follows break no ties: weights are positive
    out = rows.groupBy("key", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("total").alias("total"), entry.alias("e"))
    state = (split_state(F.col("key")) if dict(model.dtypes)["follow"] == "string" else F.col("key")).alias("state")
    return out.select(state, "lo", "hi", "total", F.size("e").alias("degree"), F.transform("e", lambda x: x["follow"]).alias("follows"), F.transform("e", lambda x: x["hi"]).alias("his"))


def roll(seed: Column | int, *parts: Column) -> Column:
    """A uniform number in [0, 1) from a seed and the parts of a key: the same wherever it is computed."""
    key = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in (seed, *parts)])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def move(rolls: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rolls (state, u in [0, 1)) with the follower that each roll picks; how="left" keeps unknown states with null."""
    t = table.select(F.col("state").alias("__s"), "follow", "lo", "hi", "total")
    x = F.col("u") * F.col("total")
    return rolls.join(t, (F.col("state") == F.col("__s")) & (x >= F.col("lo")) & (x < F.col("hi")), how).drop("__s", "lo", "hi", "total")


def move_all(model: DataFrame, rolls: list[float], temperature: float = 1.0, told: Hot | None = None) -> DataFrame:
    """(state, u, follow): what each of some fixed rolls picks in every state; a row of the cdf tells by itself which rolls pick it, so nothing is grouped or joined."""
    picks = [F.when((F.lit(float(u)) * F.col("total") >= F.col("lo")) & (F.lit(float(u)) * F.col("total") < F.col("hi")), F.lit(float(u))) for u in rolls]
    met = _numbered_cdf(model, temperature, told).select("state", F.explode(F.array(*picks)).alias("u"), "follow")
    return met.where("u is not null")
