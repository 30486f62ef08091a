"""Constrained generation: attempts, bounds, overlap with the source, first success.

Attempts walk in waves: those of a wave all at once, and only requests that are still open go on to the next. A request's result
is the first of its attempts that is accepted, or null if an attempt before it ended in a state that the model lacks, or if none is accepted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.operators.chain import BEGIN, escaped, ranked, state_key
from tokenweave.operators.overlap import rejected
from tokenweave.operators.walk import walker as walk_again
from tokenweave.sources.shared import written


#: Start states that are tried at first; each further group is eight times as large.
FIRST_STARTS = 64


@dataclass(frozen=True)
class Limits:
    """Defaults of a generated sentence's constraints; None is no limit."""

    tries: int = 10
    test_output: bool = True
    max_overlap_total: int = 15
    max_overlap_ratio: float = 0.7
    max_words: int | None = None
    min_words: int | None = None
    max_chars: int | None = None
    min_chars: int = 0


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def candidates(requests: DataFrame, walker, join, first: int, last: int) -> DataFrame:
    """walk_id, attempt, words (with the initial state's), status, sentence of the attempts first to last of requests (walk_id, init)."""
    got = walker(requests.select("walk_id", "init", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("attempt")))
    prefix = F.filter(F.coalesce("init", F.array().cast("array<string>")), lambda w: w != BEGIN)
    out = got.join(requests.select("walk_id", prefix.alias("prefix")), "walk_id").withColumn("words", F.concat("prefix", "words")).drop("prefix")
    return out.withColumn("sentence", join(F.col("words")))


def judge(tried: DataFrame, source: DataFrame | None, limits: Limits) -> DataFrame:
    """tried with column accepted."""
    n = F.size("words")
    ok = F.col("status") == "end"
    if limits.max_words is not None:
        ok &= n <= limits.max_words
    if limits.min_words is not None:
        ok &= n >= limits.min_words
    if limits.max_chars is not None:
        ok &= utf16_length(F.col("sentence")).between(limits.min_chars, limits.max_chars)
    tried = tried.withColumn("accepted", ok)
    if source is None or not limits.test_output:
        return tried
    bad = rejected(tried.where("accepted"), source, ["walk_id", "attempt"], limits.max_overlap_total, limits.max_overlap_ratio)
    return tried.join(bad.withColumn("bad", F.lit(True)), ["walk_id", "attempt"], "left").withColumn("accepted", F.col("accepted") & F.col("bad").isNull()).drop("bad")


def settled(judged: DataFrame, dead_ends: bool = True) -> DataFrame:
    """(walk_id, attempt, sentence) of the requests that an attempt ends: its first accepted one, or a dead one (null) if dead_ends."""
    stop = F.col("accepted") | (F.col("status") == "dead") if dead_ends else F.col("accepted")
    best = judged.where(stop).groupBy("walk_id").agg(F.min_by(F.struct("attempt", "accepted", "sentence"), "attempt").alias("b"))
    return best.select("walk_id", "b.attempt", F.when(F.col("b.accepted"), F.col("b.sentence")).alias("sentence"))


#: Attempts that are walked in one wave whatever comes of them, and attempts a request of the first wave if there are more.
AT_ONCE, FIRST_WAVE = 20_000, 2


def make_sentences(requests: DataFrame, model: DataFrame, k: int, source: DataFrame | None, join, limits: Limits = Limits(), temperature: float = 1.0, seed: int = 0, max_steps: int = 1000, strategy: str = "auto", walker=None, waves: list | None = None) -> DataFrame:
    """walk_id, sentence (null: none acceptable) of requests (walk_id, init); walker: another way to walk than through model.

    Of few attempts all walk at once. Of more, the first wave has FIRST_WAVE attempts a request, the next as many as the share
    of requests settled so far says will settle most of what is open. waves, if given, gets (requests, attempts walked) of each.
    """
    if limits.tries < 1:
        return requests.select("walk_id", F.lit(None).cast("string").alias("sentence"))
    walker = walker or walk_again(model, k, temperature, seed, max_steps, strategy)
    n, done, first, dead_ends = requests.count(), None, 0, limits.max_chars is None
    size = limits.tries if n * limits.tries <= AT_ONCE else FIRST_WAVE
    open_ = requests.select("walk_id", "init")
    while True:
        last = min(first + size, limits.tries) - 1
        tried = written(candidates(open_, walker, join, first, last), "attempts")
        ended = settled(judge(tried, source, limits), dead_ends)
        if waves is not None:
            waves.append((n, n * (last - first + 1)))
        if last == limits.tries - 1:
            done = ended if done is None else done.unionByName(ended)
            break
        ended = written(ended, "settled")
        done, won = ended if done is None else done.unionByName(ended), ended.count()
        first, size = last + 1, max(1, 2 * size if not won else math.ceil(2 * size * n / won))
        open_, n = written(open_.join(ended.select("walk_id"), "walk_id", "left_anti"), "requests"), n - won
        if not n:
            break
    return requests.select("walk_id").join(done.select("walk_id", "sentence"), "walk_id", "left")


def start_index(model: DataFrame) -> DataFrame:
    """(said, state): the states by the key of their words without sentinels; sorted by said, a beginning is one range of it."""
    return model.select(state_key(F.filter("state", lambda w: w != BEGIN)).alias("said"), "state").distinct()


def _begins(beginning: list[str]) -> Column:
    """The range of said that begins with these words: the words themselves, or they and a space."""
    key = " ".join(map(escaped, beginning))
    return (F.col("said") == key) | ((F.col("said") >= key + " ") & (F.col("said") < key + "!"))  # "!" comes after the space


def start_states(model: DataFrame, k: int, beginning: list[str], strict: bool = True, seed: int = 0, starts: DataFrame | None = None) -> DataFrame:
    """(state, rank): the states from which a sentence with this beginning starts, in the order in which they are tried.

    starts: the model's start index, if there is one; without it all states are read.
    """
    m = len(beginning)
    if not 1 <= m <= k:
        raise ValueError(f"the beginning must have between 1 and {k} words; it has {m}")
    if m == k or strict:
        words = [BEGIN] * (k - m) + beginning
        return model.sparkSession.range(1).select(F.array(*map(F.lit, words)).alias("state"), F.lit(0).cast("bigint").alias("rank"))
    if starts is not None:
        found = starts.where(_begins(beginning)).select("state")
    else:
        said = F.slice(F.filter("state", lambda w: w != BEGIN), 1, m)
        found = model.where(said == F.array(*map(F.lit, beginning))).select("state").distinct()
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.array_join("state", " ")))
    return ranked(found.select("state", F.struct(key.alias("key"), "state").alias("order")), "order", "rank").select("state", F.col("rank").cast("bigint").alias("rank"))


def sentence_with_start(model: DataFrame, k: int, beginning: list[str], source: DataFrame | None, join, strict: bool = True, limits: Limits = Limits(), temperature: float = 1.0, seed: int = 0, max_steps: int = 1000, strategy: str = "auto", starts: DataFrame | None = None, walker=None) -> DataFrame:
    """One row: the sentence of the first start state, in their order, that gives an acceptable one; else null.

    The states are tried in groups of growing size, and none after the group with the first success.
    """
    tried = written(start_states(model, k, beginning, strict, seed, starts).select(F.col("rank").alias("walk_id"), F.col("state").alias("init")), "starts")
    walker = walker or walk_again(model, k, temperature, seed, max_steps, strategy)
    n, lo, size = tried.count(), 0, FIRST_STARTS
    while True:
        some = tried.where(F.col("walk_id").between(lo, lo + size - 1))
        got = make_sentences(some, model, k, source, join, limits, temperature, seed, max_steps, strategy, walker)
        best = got.where("sentence is not null").agg(F.min_by("sentence", "walk_id").alias("sentence"))
        lo, size = lo + size, size * 8
        if lo >= n:
            return best
        best = written(best, "sentence")
        if best.first().sentence is not None:
            return best
