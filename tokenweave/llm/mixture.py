"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among the sources in proportion to their weights. A source whose share is more than
``max_epochs`` times its size is clamped there, and the excess is shared again among the others until none is above its
cap. Every document is then repeated ``floor(target / source size)`` times, and a seeded choice of documents once more, so
that a source's words come near its target without being above it.

The seeded choice: documents in the order of a hash of (seed, id) are taken as long as their running sum of words fits what
is left; then, ``rounds`` times in all, the same with the documents not taken yet. A round takes documents of at most a quarter of what is
left, the last two any that fit, so that what a source lacks shrinks fourfold a round while it has small enough documents. At last
the one document that brings the sum nearest to the target is taken too, if it does not go beyond by as much as was lacking.

At scale: sizes are computed once and kept without the texts. Running sums go over at most ``buckets`` sums a source, and
only the documents of the one bucket in which a source's sum crosses what is left are ordered one by one, so a source with
a third of all rows is no task of its own. The water level takes a few aggregates over the table of sources, whatever their
number. That table is joined to the documents by broadcast if it is small (counted), else by salted keys.

Defined results: a null text has no words; a null source is a source, after all others; a null id counts as an empty one; rows
of one id and size are taken together or not at all (so the choice does not depend on their order); documents without words
get the whole repetitions only; a source without words has target 0; an empty table stays empty. Other columns stay; columns
with the names of the new ones are replaced. Reruns, on any partitioning, agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenweave.llm.common import written
from tokenweave.operators.chain import ranked

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose table may be broadcast.
BROADCAST_SOURCES = 100_000
#: Salts of the join with more sources than that.
SALTS = 64
#: Of what a source lacks, the most that one document may be in a round before the last two.
QUARTER = 0.25
NEW = ("size", "source_size", "target", "repeats")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the sources of a table (distinct, column source) by code point, null last, with the weights of cycle in turn."""
    named = sources.where("source is not null")
    last = sources.where("source is null").withColumn("__rank", F.lit(named.count()))
    all_ranks = ranked(named, "source", "__rank").unionByName(last)
    return all_ranks.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("__rank") % len(cycle) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (source_size, weight) with target: weight x level, at most max_epochs x source_size; the level is raised until it holds.

    Sources that are clamped at one level are clamped at every higher one, so two sums a round say all.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        row = sources.where("weight > 0").agg(F.count_if(above).alias("k"), F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if row.k == clamped:
            break
        clamped = row.k
        if not row.free:
            level = math.inf
            break
        level = (budget - (row.full or 0.0)) / row.free
    share = cap if level == math.inf else F.least(F.col("weight") * F.lit(level), cap)
    return sources.withColumn("target", F.when(F.col("weight") > 0, share).otherwise(F.lit(0.0)))


def _with_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """rows (column __s) joined to one row a source; null is a source."""
    right = sources.withColumnRenamed("source", "__source")
    if small:
        return rows.join(F.broadcast(right), F.col("__s").eqNullSafe(F.col("__source"))).drop("__source")
    left = rows.withColumn("__salt", F.pmod("__h", F.lit(SALTS)))
    right = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right, F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salt2"))).drop("__source", "__salt", "__salt2")


def _place() -> Column:
    return F.struct(F.col("__h").alias("h"), F.col("__tie").alias("tie"), F.col("__size").alias("size"))


def _taken(cuts: Column) -> Column:
    """Whether a row is in the part that one of the rounds took."""
    return F.exists(cuts, lambda c: (F.col("__size") <= c["most"]) & (_place() <= c["upto"]))


def _round(narrow: DataFrame, state: DataFrame, small: bool, shift: int, portion: float) -> DataFrame:
    """state (source, need, cuts, ...) after one more round of the seeded choice, of documents of at most this portion of what is left."""
    most = F.col("need") * F.lit(portion)
    open_ = _with_sources(narrow, state.select("source", "need", "cuts"), small).where((F.col("__size") > 0) & (F.col("__size") <= most) & ~_taken(F.col("cuts")))
    open_ = open_.withColumn("__b", F.shiftright("__h", shift))
    sums = open_.groupBy("__s", "__b", "need").agg(F.sum("__size").alias("n"))
    upto = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = sums.withColumn("run", F.sum("n").over(upto)).groupBy("__s").agg(
        F.min(F.when(F.col("run") > F.col("need"), F.struct("__b", (F.col("run") - F.col("n")).alias("before")))).alias("x"), F.max("run").alias("all"))
    crossing = written(crossing.select(F.col("__s").alias("source"), F.col("x.__b").alias("cut"), F.coalesce("x.before", "all").alias("before")), "mix-crossing")
    near = _with_sources(open_.drop("need", "cuts"), crossing.join(state.select(F.col("source").alias("__t"), "need"), F.col("source").eqNullSafe(F.col("__t"))).drop("__t"), small).where("__b = cut")
    run = F.sum("__size").over(Window.partitionBy("__s").orderBy("__h", "__tie", "__size"))  # rows of equal place together
    inside = near.withColumn("run", run).where("before + run <= need").groupBy("__s").agg(F.max(F.struct("run", _place().alias("upto"))).alias("y"))
    found = crossing.join(inside.select(F.col("__s").alias("__t"), "y"), F.col("source").eqNullSafe(F.col("__t")), "left").drop("__t")
    bucket_start = F.struct(F.shiftleft("cut", shift).alias("h"), F.lit("").alias("tie"), F.lit(0).cast("bigint").alias("size"))
    everything = F.struct(F.lit((1 << 62)).cast("bigint").alias("h"), F.lit("").alias("tie"), F.lit(0).cast("bigint").alias("size"))
    upto = F.coalesce(F.col("y.upto"), F.when(F.col("cut").isNotNull(), bucket_start), everything)
    found = found.select(F.col("source").alias("__t"), upto.alias("upto"), (F.col("before") + F.coalesce("y.run", F.lit(0))).alias("got"))
    out = state.join(found, F.col("source").eqNullSafe(F.col("__t")), "left")
    cuts = F.when(F.col("upto").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.struct(most.alias("most"), "upto")))
    return written(out.withColumns({"cuts": cuts, "need": F.col("need") - F.coalesce("got", F.lit(0))}).drop("__t", "upto", "got"), "mix-state")


def _last(narrow: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """state with last, the place of the rows that bring a source's sum nearest to its target (null: none does)."""
    open_ = _with_sources(narrow, state.select("source", "need", "cuts"), small).where((F.col("__size") > 0) & (F.col("__size") < 2 * F.col("need")) & ~_taken(F.col("cuts")))
    rows = open_.groupBy("__s", "__h", "__tie", "__size", "need").agg(F.sum("__size").alias("n")).where(F.col("n") < 2 * F.col("need"))
    best = rows.groupBy(F.col("__s").alias("__t")).agg(F.min(F.struct(F.abs(F.col("n") - F.col("need")).alias("off"), _place().alias("at"))).alias("y"))
    out = state.join(best, F.col("source").eqNullSafe(F.col("__t")), "left")
    return written(out.withColumn("last", F.col("y.at")).drop("__t", "y"), "mix-state")


CUTS = "array<struct<most: double, upto: struct<h: bigint, tie: string, size: bigint>>>"


def plan(docs: DataFrame, size: Column, *, source_col: str = "source", id_col: str = "doc_id", weights=cycled_weights, share: float = 1.0, max_epochs: float = 3.0, seed: int = 0, rounds: int = 5) -> DataFrame:
    """docs with size, source_size, target (words of the document's source in the mix) and repeats (times the document is taken).

    size: the words of a row; weights: a function from the table of distinct sources (source) to (source, weight), or such a
    table, whose missing sources weigh nothing; share: the mix's words in parts of all words.
    """
    if not max_epochs > 0 or share < 0 or rounds < 1:
        raise ValueError("max_epochs is above 0, share is not negative, and there is at least one round")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 15), 16, 10).cast("bigint")
    drop = [c for c in NEW if c not in (source_col, id_col)]
    full = docs.withColumns({"__size": F.coalesce(size, F.lit(0)).cast("bigint"), "__h": hashed, "__tie": key, "__s": F.col(source_col)})
    narrow = written(full.select("__size", "__h", "__tie", "__s"), "mix-sizes")
    sources = written(narrow.groupBy(F.col("__s").alias("source")).agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__rows")), "mix-sources")
    weighed = weights(sources.select("source")) if callable(weights) else weights
    weighed = sources.join(weighed.select(F.col("source").alias("__t"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("__t")), "left").drop("__t")
    weighed = written(weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0))), "mix-weights")
    n_sources, n_rows, total = weighed.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    small = n_sources <= BROADCAST_SOURCES
    shift = 60 - min(20, max(10, math.ceil(math.log2(max(1, n_rows / 50_000)))))  # buckets of a source: some 50,000 rows each at most
    state = water_fill(weighed, total * share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    state = state.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("cuts", F.array().cast(CUTS))
    state = written(state.select("source", "source_size", "target", "whole", "need", "cuts"), "mix-state")
    for k in range(rounds):
        state = _round(narrow, state, small, shift, QUARTER if k < rounds - 2 else 1.0)
    state = _last(narrow, state, small)
    out = _with_sources(full.drop(*drop), state.select("source", "source_size", "target", F.col("whole").alias("__whole"), F.col("cuts").alias("__cuts"), F.col("last").alias("__last")), small)
    extra = ((F.col("__size") > 0) & (_taken(F.col("__cuts")) | _place().eqNullSafe(F.col("__last")))).cast("bigint")
    return out.withColumns({"size": F.col("__size"), "repeats": F.col("__whole") + extra}).drop("__size", "__h", "__tie", "__s", "__whole", "__cuts", "__last")


def mixed(planned: DataFrame) -> DataFrame:
    """One row for each repetition of the documents of a plan, with epoch (0, 1, ...)."""
    return planned.where("repeats > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("repeats") - 1)))
