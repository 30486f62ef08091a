"""Walks through a model: by broadcast of a small model, or by joins.

A request table has ``walk_id, attempt, init`` (init: a state, or null for the beginning). Steps draw
``roll(seed, walk_id, attempt, step)``, so all ways give the same walks on any partitioning. Results have
``walk_id, attempt, words, status``: status is ``end``, ``dead`` (a state that the model lacks) or ``cut`` (after
``max_steps`` words). words are those drawn, without the initial state's. Words may be ids instead of strings.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.operators import coded
from tokenweave.operators.chain import BEGIN, END, PACKED_BITS, id_bits, key_words, packed, shift, state_key
from tokenweave.operators.frozen import Frozen, halves, row_order
from tokenweave.operators.sampling import cdf, move, roll
from tokenweave.operators.stored import LOOKED_UP, Stored, StoredIds, StoredRows, files_of, readable, rows_of, stored_walk
from tokenweave.operators.travel import ranges, travel_walk
from tokenweave.sources.shared import written

#: Bytes of a frozen model that may be broadcast; a larger model stays in its partitions.
BROADCAST_BYTES = 192 << 20
#: Bytes of a transition in it: an entry (16), and a row (24) if each state has one follower.
ENTRY_BYTES = 40
#: Live walks that are broadcast to a larger model's rows.
BROADCAST_WALKS = 100_000
#: Digits of an id where ids are texts: as many as a bigint may have.
ID_DIGITS = 19
SCHEMA = "walk_id bigint, attempt int, words array<{}>, status string"


def word_type(model: DataFrame) -> str:
    return dict(model.dtypes)["follow"]


def schema(model: DataFrame) -> str:
    return SCHEMA.format(word_type(model))


def payload_bytes(model: DataFrame) -> int:
    """A bound of the bytes of the frozen model, from one aggregate: its transitions, and all its followers' texts as if each were new."""
    words = F.octet_length("follow") if word_type(model) == "string" else F.lit(4)
    row = model.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(words), F.lit(0)).alias("w")).first()
    return ENTRY_BYTES * row.n + row.w


def digest(state: Column) -> Column:
    """16 bytes by which a state is known in a frozen model (frozen.halves)."""
    return F.unhex(F.md5(state_key(state)))


def freeze(model: DataFrame, k: int, temperature: float = 1.0, end: str = END) -> Frozen:
    """The payload of a model of words, whose size is to be checked before; states are known by their digests."""
    state, after = F.col("state"), shift(F.col("state"), F.col("follow"), k)
    rows = model.select(digest(state).alias("d"), "follow", F.col("n").cast("bigint").alias("n"), digest(after).alias("next")).toArrow()
    if not rows.num_rows:
        none = np.zeros(0, np.int64)
        return Frozen(none, none, np.zeros(1, np.int64), none, np.zeros(0), none, pa.array([], pa.string()))
    coded = rows.column("follow").combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()  # by bytes, as Spark orders strings
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words = coded.dictionary.take(pa.array(order))
    at = pc.index(words, end).as_py()
    return Frozen.build(*halves(rows.column("d")), rank[np.asarray(coded.indices)], rows.column("n").to_numpy(), *halves(rows.column("next")), at, 1.0 / temperature, words)


def freeze_ids(encoded: DataFrame, k: int, bits: int, end_id: int, temperature: float = 1.0) -> Frozen:
    """The payload of a model of word ids (key, follow_id, n), whose states are packed into integers."""
    rows = packed(encoded, k, bits).select("hi", "lo", "follow_id", F.col("n").cast("bigint").alias("n"), "next_hi", "next_lo").toArrow()
    return Frozen.build(*(rows.column(c).to_numpy() for c in ("hi", "lo", "follow_id", "n", "next_hi", "next_lo")), end_id, 1.0 / temperature)


def frozen_walk(requests: DataFrame, frozen: Frozen | Broadcast, seed: int, max_steps: int, keys: list[Column], words: str = "string") -> DataFrame:
    """Walks of requests through a broadcast frozen model; keys: the digest of a request's first state, or the two integers of a packed one."""
    sent = frozen if isinstance(frozen, Broadcast) else requests.sparkSession.sparkContext.broadcast(frozen)

    def go(batches):
        table = sent.value
        for b in batches:
            ids, attempt = np.asarray(b.column(0)), np.asarray(b.column(1))
            hi, lo = halves(b.column(2)) if b.num_columns == 3 else (np.asarray(b.column(2)), np.asarray(b.column(3)))
            yield table.walk(seed, ids, attempt, table.rows(hi, lo), max_steps)

    return requests.select("walk_id", "attempt", *keys).mapInArrow(go, SCHEMA.format(words))


def broadcast_walk(requests: DataFrame, model: DataFrame, k: int, temperature: float, seed: int, max_steps: int, begin=BEGIN, end=END) -> DataFrame:
    first = F.coalesce("init", F.array_repeat(F.lit(begin), k))
    if word_type(model) == "string":
        return frozen_walk(requests, freeze(model, k, temperature, end), seed, max_steps, [digest(first)])
    bits = id_bits(model.agg(F.max(F.greatest("follow", F.array_max("state")))).first()[0] or 0)
    if k * bits > PACKED_BITS:
        raise ValueError(f"{k} ids of {bits} bits don't fit into two integers")
    frozen = freeze_ids(model.select(F.col("state").alias("key"), F.col("follow").alias("follow_id"), "n"), k, bits, end, temperature)
    asked = packed(requests.select("walk_id", "attempt", first.alias("key")), k, bits)
    return frozen_walk(asked, frozen, seed, max_steps, [F.col("hi"), F.col("lo")], word_type(model))


def csr_walk(requests: DataFrame, rows: DataFrame, k: int, begin_id: int, end_id: int, seed: int = 0, max_steps: int = 1000, temperature: float | None = None, bits: int | None = None) -> DataFrame:
    """Walks from the beginning through compressed sparse rows with sums (chain.csr with a weight): words is array<bigint>.

    Rows that are too large for a broadcast are walked in their ranges, for which the temperature of their sums must be given;
    rows with one (coded.csr), whose ids have so many bits, are looked up where they were written.
    """
    if bits and "one" in rows.columns:
        entries = rows.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
        files = files_of(rows) if entries * ENTRY_BYTES > BROADCAST_BYTES else []
        if files and readable(files):
            return stored_walk(requests, StoredRows(files, k, bits, temperature or 1.0, begin_id, end_id), seed, max_steps)
    entries = rows.select("key", "state_id", F.explode("followers").alias("f")).select("key", "state_id", "f.follow_id", "f.n", "f.cum")
    size = entries.agg(F.max(F.greatest("follow_id", F.array_max("key"))).alias("largest"), F.count(F.lit(1)).alias("n")).first()
    if size.n * ENTRY_BYTES > BROADCAST_BYTES:
        if temperature is None:
            raise ValueError("rows of this size can't be broadcast; give their temperature, or walk the model itself")
        return id_walk(requests, entries.select("key", "follow_id", "n"), k, begin_id, end_id, temperature, seed, max_steps, "travel")
    bits = id_bits(size.largest or 0)
    got = packed(entries, k, bits).select("state_id", "hi", "lo", "follow_id", "cum", "next_hi", "next_lo").toArrow()
    get = {c: got.column(c).to_numpy() for c in got.column_names}
    frozen = Frozen.build(get["hi"], get["lo"], get["follow_id"], np.ones(len(get["hi"])), get["next_hi"], get["next_lo"], end_id, 1.0)
    order = row_order(get["hi"], get["lo"], get["follow_id"])
    frozen.cum = get["cum"][order]  # as the rows have them
    asked = packed(requests.select("walk_id", "attempt", F.array_repeat(F.lit(begin_id).cast("bigint"), k).alias("key")), k, bits)
    return frozen_walk(asked, frozen, seed, max_steps, [F.col("hi"), F.col("lo")], "bigint")


def register(spark, name: str, model: DataFrame, k: int, temperature: float = 1.0, max_steps: int = 1000) -> None:
    """Register the table function name(first bigint, n bigint, seed bigint) for SQL; the model is broadcast, so its size is checked."""
    if payload_bytes(model) > BROADCAST_BYTES:
        raise ValueError(f"a model of more than {BROADCAST_BYTES} bytes can't be broadcast")
    sent = spark.sparkContext.broadcast(freeze(model, k, temperature))
    begin = halves(spark.range(1).select(digest(F.array_repeat(F.lit(BEGIN), k)).alias("d")).toArrow().column("d"))

    class Walks:
        def eval(self, first: int, n: int, seed: int):
            table = sent.value
            row = table.rows(*begin)
            for i in range(first, first + n, 1024):
                ids = np.arange(i, min(i + 1024, first + n))
                got = table.walk(seed, ids, np.zeros(len(ids), np.int32), np.repeat(row, len(ids)), max_steps)
                yield from zip(*(got.column(c).to_pylist() for c in (0, 2, 3)))

    spark.udtf.register(name, F.udtf(Walks, returnType="walk_id bigint, words array<string>, status string"))


def superstep_walk(requests: DataFrame, model: DataFrame, k: int, temperature: float, seed: int, max_steps: int, begin=BEGIN, end=END) -> DataFrame:
    """One equi-join on the state a step for all live walks; each step is written, so lineage stays short.

    As long as at most BROADCAST_WALKS walks are live they go to the model's rows, which then don't move.
    """
    table = written(cdf(model, temperature).select("state", "follow", "lo", "hi", "total"), "cdf")
    live = requests.select("walk_id", "attempt", F.coalesce("init", F.array_repeat(F.lit(begin), k)).alias("state"), F.array().cast(f"array<{word_type(model)}>").alias("words"))
    live = written(live, "walk-step")
    done = None
    for step in range(max_steps + 1):
        rolled = live.withColumn("u", roll(seed, F.col("walk_id"), F.col("attempt"), F.lit(step)))
        if live.limit(BROADCAST_WALKS + 1).count() <= BROADCAST_WALKS:
            rolled = F.broadcast(rolled)
        moved = move(rolled, table)
        status = F.when(F.col("follow") == end, "end").when(F.lit(step == max_steps), "cut")
        moved = written(moved.withColumn("status", status), "walk-step")
        dead = live.join(moved.select("walk_id", "attempt"), ["walk_id", "attempt"], "left_anti").select("walk_id", "attempt", "words", F.lit("dead").alias("status"))
        ended = moved.where("status is not null").select("walk_id", "attempt", "words", "status").unionByName(dead)
        done = ended if done is None else done.unionByName(ended)
        live = moved.where("status is null").select("walk_id", "attempt", shift(F.col("state"), F.col("follow"), k).alias("state"), F.array_append("words", F.col("follow")).alias("words"))
        if live.isEmpty():
            break
    return done


class Unknown(Exception):
    """A state whose rows are not at hand."""


class Pages:
    """The rows of the states met so far, of a model that stays in its tables."""

    def __init__(self, k: int, temperature: float, begin: str = BEGIN, end: str = END):
        self.k, self.begin, self.end, self.power, self.rows, self.opened = k, begin, end, 1.0 / temperature, {}, {}

    def followers(self, state: tuple[str, ...]):
        """(words in their order, cumulative weights) of a state, or None; summed once for each state that is met."""
        if state not in self.opened:
            if state not in self.rows:
                raise Unknown
            got = self.rows[state]
            if got is not None:
                words, n = got
                order = sorted(range(len(words)), key=words.__getitem__)
                n = n[order].astype(np.float64)
                got = [words[i] for i in order], np.cumsum(n if self.power == 1.0 else n**self.power)
            self.opened[state] = got
        return self.opened[state]

    def walk(self, seed: int, walk_id, attempt: int, init, max_steps: int, out: list[str] | None = None) -> tuple[list[str], str]:
        """The words drawn, after those of out, and the status; "open" if a state is not at hand."""
        out = list(out) if out else []
        state = ((*init,) if init is not None else (self.begin,) * self.k) + tuple(out)
        state = state[len(state) - self.k :]
        for step in range(len(out), max_steps + 1):
            try:
                got = self.followers(state)
            except Unknown:
                return out, "open"
            if got is None:
                return out, "dead"
            words, hi = got
            word = words[0]
            if len(words) > 1:  # of one, any roll picks it
                u = int(hashlib.md5(f"{seed}:{walk_id}:{attempt}:{step}".encode()).hexdigest()[:13], 16) / 4503599627370496
                word = words[min(int(np.searchsorted(hi, u * hi[-1], "right")), len(words) - 1)]
            if word == self.end:
                return out, "end"
            if step == max_steps:
                break
            out.append(word)
            state = (*state[1:], word)
        return out, "cut"


def paged_walk(requests: DataFrame, look_up, k: int, temperature: float, seed: int, max_steps: int, begin: str = BEGIN, end: str = END) -> DataFrame:
    """Walks through a model that is never loaded: in rounds, each walk goes on until it meets a state not looked up yet.

    look_up(states DataFrame (state)) gives the rows (state, follow, n) of these states. What is broadcast are the rows
    of the states that the walks of these requests have met.
    """
    spark, pages, done, schema = requests.sparkSession, Pages(k, temperature, begin, end), None, SCHEMA.format("string") + ", init array<string>"
    live = requests.select("walk_id", F.col("attempt").cast("int").alias("attempt"), F.array().cast("array<string>").alias("words"), F.lit("open").alias("status"), F.col("init").cast("array<string>").alias("init"))
    while True:
        whole = F.concat(F.coalesce("init", F.array_repeat(F.lit(begin), k)), "words")
        states = live.select(F.slice(whole, F.size(whole) - k + 1, k).alias("state")).distinct()
        wanted = [tuple(r.state) for r in states.toLocalIterator()]  # one a live walk at most
        found: dict = {}
        for r in look_up(spark.createDataFrame([(list(w),) for w in wanted], "state array<string>")).toLocalIterator():
            found.setdefault(tuple(r.state), ([], []))
            found[tuple(r.state)][0].append(r.follow)
            found[tuple(r.state)][1].append(r.n)
        pages.rows |= {w: (found[w][0], np.array(found[w][1])) if w in found else None for w in wanted}
        sent = spark.sparkContext.broadcast(pages)

        def go(frames, sent=sent):
            table = sent.value
            for f in frames:
                got = [table.walk(seed, w, int(a), i, max_steps, list(o)) for w, a, i, o in zip(f["walk_id"], f["attempt"], f["init"], f["words"])]
                yield pd.DataFrame({"walk_id": f["walk_id"], "attempt": f["attempt"].astype("int32"), "words": [g[0] for g in got], "status": [g[1] for g in got], "init": f["init"]})

        moved = written(live.mapInPandas(go, schema), "walk-round")
        sent.destroy()
        ended = moved.where("status <> 'open'").select("walk_id", "attempt", "words", "status")
        done = ended if done is None else done.unionByName(ended)
        live = moved.where("status = 'open'")
        if live.isEmpty():
            return done


def id_walk(requests: DataFrame, encoded: DataFrame, k: int, begin_id: int, end_id: int, temperature: float = 1.0, seed: int = 0, max_steps: int = 1000, strategy: str = "auto") -> DataFrame:
    """Walks over word ids: encoded (key, follow_id, n) as chain.encode gives it; words is array<bigint>, init an array of ids.

    Ids that are ranks of the words give the walks that the words' own model gives.
    """
    model = encoded.select(F.col("key").alias("state"), F.col("follow_id").alias("follow"), "n")
    asked = requests.withColumn("init", F.col("init").cast("array<bigint>"))
    if strategy == "auto":
        strategy = "broadcast" if payload_bytes(model) <= BROADCAST_BYTES else "travel"
    if strategy == "travel":  # ids as texts of one length have the order of the ids
        text = lambda i: F.lpad(i.cast("string"), ID_DIGITS, "0")
        model = model.select(F.transform("state", text).alias("state"), text(F.col("follow")).alias("follow"), "n")
        asked = asked.withColumn("init", F.transform("init", text))
        got = travel_walk(asked, model, k, temperature, seed, max_steps, begin=str(begin_id).zfill(ID_DIGITS), end=str(end_id).zfill(ID_DIGITS))
        return got.select("walk_id", "attempt", F.col("words").cast("array<bigint>").alias("words"), "status")
    return walk(asked, model, k, temperature, seed, max_steps, strategy, begin=begin_id, end=end_id)


def coded_walk(requests: DataFrame, rows: DataFrame, k: int, bits: int, begin_id: int, end_id: int, temperature: float = 1.0, seed: int = 0, max_steps: int = 1000) -> DataFrame:
    """id_walk of rows that coded.train gives: they are written once, in their ranges, where a large model's states are looked up."""
    if k * bits > 63:
        enc = written(rows.select(coded.key_of(k).alias("key"), "follow_id", "n"), "model")
        return id_walk(requests, enc, k, begin_id, end_id, temperature, seed, max_steps)
    table = coded.in_files(rows, k, bits, **LOOKED_UP)
    files = files_of(table)
    if payload_bytes(table) > BROADCAST_BYTES and readable(files):
        return stored_walk(requests, StoredIds(files, k, bits, temperature, begin_id, end_id), seed, max_steps)
    ids = [F.shiftright("key", bits * j).bitwiseAND(F.lit((1 << bits) - 1)) for j in range(k - 1, -1, -1)]
    return id_walk(requests, table.select(F.array(*ids).alias("key"), F.col("follow").alias("follow_id"), "n"), k, begin_id, end_id, temperature, seed, max_steps)


def walk(requests: DataFrame, model: DataFrame, k: int, temperature: float = 1.0, seed: int = 0, max_steps: int = 1000, strategy: str = "auto", **ends) -> DataFrame:
    """Walks of all requests; strategy: "broadcast", "travel", "superstep", or by the counted size of the model; ends: other sentinels."""
    if strategy == "auto":
        strategy = "broadcast" if payload_bytes(model) <= BROADCAST_BYTES else "travel" if word_type(model) == "string" else "superstep"
    if strategy == "broadcast":
        return broadcast_walk(requests, model, k, temperature, seed, max_steps, **ends)
    if strategy == "superstep":
        return superstep_walk(requests, model, k, temperature, seed, max_steps, **ends)
    if strategy == "travel":
        return travel_walk(requests, model, k, temperature, seed, max_steps, **ends)
    raise ValueError("strategy is 'auto', 'broadcast', 'travel' or 'superstep'")


def ranged_walk(requests: DataFrame, model: DataFrame | Stored, k: int, temperature: float = 1.0, seed: int = 0, max_steps: int = 1000) -> DataFrame:
    """What walk gives, of a model that is not written yet: it is written once, as its ranges (or they are given), which are counted, and frozen if they are small."""
    table = model if isinstance(model, Stored) else ranges(model, k, temperature)
    rows = rows_of(requests.sparkSession, table).select(key_words(F.col("key")).alias("state"), "follow", "n")
    if payload_bytes(rows) <= BROADCAST_BYTES:
        return broadcast_walk(requests, rows, k, temperature, seed, max_steps)
    return travel_walk(requests, table, k, temperature, seed, max_steps)


def recursive_sql(model_view: str, requests_view: str, seed: int, max_steps: int) -> str:
    """Walks as one recursive query over two views: a sampling table (sampling.cdf) and requests (walk_id, attempt, state).

    A step is the equi-join of the walks' states with the table; its places in line are bounded by max_steps, and so is the recursion.
    """
    u = f"(cast(conv(substring(md5(concat_ws(':', '{int(seed)}', cast(w.walk_id as string), cast(w.attempt as string), cast(w.step as string))), 1, 13), 16, 10) as double) / 4503599627370496D)"
    return f"""
WITH RECURSIVE walks(walk_id, attempt, step, state, words, status) MAX RECURSION LEVEL {int(max_steps) + 2} AS (
  SELECT walk_id, attempt, 0, state, cast(array() AS array<string>), cast(NULL AS string) FROM {requests_view}
  UNION ALL
  SELECT w.walk_id, w.attempt, w.step + 1,
         CASE WHEN c.follow IS NULL THEN w.state ELSE array_append(slice(w.state, 2, size(w.state)), c.follow) END,
         CASE WHEN c.follow IS NULL OR c.follow = '{END}' OR w.step = {int(max_steps)} THEN w.words ELSE array_append(w.words, c.follow) END,
         CASE WHEN c.follow IS NULL THEN 'dead' WHEN c.follow = '{END}' THEN 'end' WHEN w.step = {int(max_steps)} THEN 'cut' END
  FROM walks w LEFT JOIN {model_view} c ON w.state = c.state AND {u} * c.total >= c.lo AND {u} * c.total < c.hi
  WHERE w.status IS NULL
)
SELECT walk_id, attempt, words, status FROM walks WHERE status IS NOT NULL"""


def sql_walk(asked: DataFrame, model: DataFrame, k: int, temperature: float = 1.0, seed: int = 0, max_steps: int = 1000) -> DataFrame:
    """Walks by recursive_sql, for models and requests that are small: each step is planned and run by itself."""
    spark, tag = asked.sparkSession, uuid.uuid4().hex
    written(cdf(model, temperature).select("state", "follow", "lo", "hi", "total"), "cdf").createOrReplaceTempView(f"cdf_{tag}")
    asked.select("walk_id", F.col("attempt").cast("int").alias("attempt"), F.coalesce("init", F.array_repeat(F.lit(BEGIN), k)).alias("state")).createOrReplaceTempView(f"asked_{tag}")
    return spark.sql(recursive_sql(f"cdf_{tag}", f"asked_{tag}", seed, max_steps))


def walker(model: DataFrame, k: int, temperature: float = 1.0, seed: int = 0, max_steps: int = 1000, strategy: str = "auto"):
    """A function from requests to walks for several calls: the model's size is counted, and the model frozen or ranged, once."""
    ready: dict = {}

    def again(asked: DataFrame) -> DataFrame:
        if "way" not in ready:
            ready["way"] = strategy if strategy != "auto" else "broadcast" if payload_bytes(model) <= BROADCAST_BYTES else "travel"
        if ready["way"] == "broadcast":
            if "frozen" not in ready:
                ready["frozen"] = model.sparkSession.sparkContext.broadcast(freeze(model, k, temperature))
            return frozen_walk(asked, ready["frozen"], seed, max_steps, [digest(F.coalesce("init", F.array_repeat(F.lit(BEGIN), k)))])
        if ready["way"] == "travel":
            if "ranges" not in ready:
                ready["ranges"] = ranges(model, k, temperature)
            return travel_walk(asked, ready["ranges"], k, temperature, seed, max_steps)
        return walk(asked, model, k, temperature, seed, max_steps, ready["way"])

    return again


def requests(spark, n: int, tries: int = 1) -> DataFrame:
    """n walks from the beginning, with attempts 0 to tries - 1 each."""
    ids = spark.range(n).select(F.col("id").alias("walk_id"))
    return ids.select("walk_id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"), F.lit(None).cast("array<string>").alias("init"))
