"""All ways to walk give the same walks; running sums of hot states; packed states."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenweave.operators import chain, frozen, sampling, travel, walk


def model_rows(seed, k, n=150, words=12):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)] + ["a b", "a", "b", "\\", "\\s", " ", "é😀"]
    runs = [[r.choice(vocab) for _ in range(r.randrange(0, 12))] for _ in range(n)] + [["x1", "x2", "x3", "x4", "x5", "x6", "x7"]] * 3
    out = {}
    for run in runs:
        items = [chain.BEGIN] * k + run + [chain.END]
        for i in range(len(run) + 1):
            key = (tuple(items[i : i + k]), items[i + k])
            out[key] = out.get(key, 0) + 1
    return [(list(s), f, n) for (s, f), n in out.items()]


def walk_by_force(rows, k, temperature, seed, walk_id, attempt, init, max_steps):
    model = {}
    for s, f, n in rows:
        model.setdefault(tuple(s), {})[f] = n
    state, out = tuple(init or [chain.BEGIN] * k), []
    for step in range(max_steps + 1):
        if state not in model:
            return out, "dead"
        total, sums, follow = 0.0, [], sorted(model[state], key=str.encode)
        for f in follow:
            total += float(model[state][f]) ** (1 / temperature)
            sums.append(total)
        u = int(hashlib.md5(f"{seed}:{walk_id}:{attempt}:{step}".encode()).hexdigest()[:13], 16) / 2**52
        word = next(f for f, x in zip(follow, sums) if x > u * total)
        if word == chain.END:
            return out, "end"
        if step == max_steps:
            return out, "cut"
        out.append(word)
        state = (*state[1:], word)


@pytest.mark.parametrize("k, temperature, max_steps", [(1, 1.0, 30), (2, 1.5, 1000), (3, 0.5, 4)])
def test_all_ways_walk_alike(spark, monkeypatch, k, temperature, max_steps):
    monkeypatch.setattr(travel, "RANGE_ROWS", 60)
    monkeypatch.setattr(travel, "HOT_STATES", 4)
    monkeypatch.setattr(sampling, "SEGMENT", 3)
    monkeypatch.setattr(sampling, "HOT_FOLLOWERS", 5)
    rows = model_rows(k, k)
    model = spark.createDataFrame(rows, "state array<string>, follow string, n bigint").repartition(3)
    asked = [(i, i % 3, None if i % 4 else rows[(7 * i) % len(rows)][0]) for i in range(60)] + [(99, 0, ["no"] * k)]
    req = spark.createDataFrame(asked, "walk_id bigint, attempt int, init array<string>")
    want = {i: walk_by_force(rows, k, temperature, 5, i, a, init, max_steps) for i, a, init in asked}
    assert {"end", "dead"} <= {s for _, s in want.values()}
    for way in ("broadcast", "travel", "superstep"):
        if way == "superstep" and max_steps > 100:
            continue
        got = {r.walk_id: (r.words, r.status) for r in walk.walk(req, model, k, temperature, 5, max_steps, way).collect()}
        assert got == want, way


def test_travelling_walks_need_fewer_rounds_than_steps(spark, monkeypatch):
    monkeypatch.setattr(travel, "HOT_STATES", 3)
    monkeypatch.setattr(travel, "RANGE_ROWS", 10)
    runs = [([f"{c}{i}" for i in range(40)],) for c in "abcdef"] * 2
    model = chain.count(chain.transitions(spark.createDataFrame(runs, "words array<string>"), 2))
    rounds = []
    got = travel.travel_walk(walk.requests(spark, 30), model, 2, 1.0, 1, 1000, rounds=rounds).collect()
    assert {tuple(r.words) for r in got} <= {tuple(w) for (w,) in runs} and {r.status for r in got} == {"end"}
    assert len(rounds) <= 5  # of 41 steps, 16 forced words at once
    table = travel.ranges(model, 2)
    assert len(table.parts) > 10 and max(n for _, n in rounds) < len(table.parts)


def test_a_larger_model_travels(spark, monkeypatch):
    monkeypatch.setattr(walk, "BROADCAST_BYTES", 100)
    rows = model_rows(3, 1)
    model = spark.createDataFrame(rows, "state array<string>, follow string, n bigint")
    got = {r.walk_id: (r.words, r.status) for r in walk.walk(walk.requests(spark, 20), model, 1, 1.0, 2).collect()}
    assert got == {i: walk_by_force(rows, 1, 1.0, 2, i, 0, None, 1000) for i in range(20)}
    with pytest.raises(ValueError):
        walk.register(spark, "too_large", model, 1)


@pytest.mark.parametrize("temperature", [1.0, 2.0])
def test_sums_of_a_hot_state_are_spread(spark, monkeypatch, temperature):
    rows = [(["hot"], f"f{i:05d}", i % 9 + 1) for i in range(3000)] + [([f"s{i}"], f"f{j}", j + 1) for i in range(50) for j in range(3)]
    model = spark.createDataFrame(rows, "state array<string>, follow string, n bigint").repartition(4)
    one = {(r.state[0], r.follow): (r.w, r.lo, r.hi, r.total) for r in sampling.cdf(model, temperature).collect()}
    monkeypatch.setattr(sampling, "HOT_FOLLOWERS", 100)
    monkeypatch.setattr(sampling, "SEGMENT", 64)
    for few in (100_000, 0):
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", few)
        numbered = sampling._numbered_cdf(model, temperature)
        parts = {r.p for r in numbered.where("state[0] = 'hot'").select("p").distinct().collect()}
        assert len(parts) > 1
        two = {(r.state[0], r.follow): (r.w, r.lo, r.hi, r.total) for r in numbered.collect()}
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], rtol=1e-12, atol=0 if temperature == 1.0 else 1e-9) for k in one)
        if temperature == 1.0:
            assert one == two
        ordered = sorted(v for (s, _), v in two.items() if s == "hot" for v in [(v[1], v[2])])
        assert ordered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ordered, ordered[1:]))  # no gap where parts meet
    segs = sampling.segments(model, temperature).collect()
    assert sum(s.degree for s in segs) == len(rows) and max(s.degree for s in segs) <= 64
    assert all(s.hi == s.his[-1] and s.his == sorted(s.his) and s.follows == sorted(s.follows) for s in segs)


def test_row_sums_equal_each_rows_own_sum():
    r = np.random.default_rng(2)
    degree = np.concatenate((r.integers(1, 6, 300), [0, 900, 0], r.integers(1, 3, 20)))
    start = np.concatenate(([0], np.cumsum(degree)))
    w = r.random(start[-1])
    got = frozen.row_sums(w, start)
    for a, z in zip(start[:-1], start[1:]):
        assert (got[a:z] == np.cumsum(w[a:z])).all()
    at = frozen.bisect(got, start[:-1], start[1:], np.full(len(degree), 0.7), True)
    assert [int(np.searchsorted(got[a:z], 0.7, "right")) for a, z in zip(start[:-1], start[1:])] == (at - start[:-1]).tolist()


@pytest.mark.parametrize("k, bits", [(1, 7), (2, 31), (3, 21), (2, 33), (3, 40), (2, 63), (4, 31)])
def test_packed_states(spark, k, bits):
    r = random.Random(k * bits)
    rows = [([r.randrange(1 << bits) for _ in range(k)], r.randrange(1 << bits), 1) for _ in range(50)] + [([(1 << bits) - 1] * k, 0, 1), ([0] * k, (1 << bits) - 1, 1)]
    df = spark.createDataFrame(rows, "key array<bigint>, follow_id bigint, n bigint")
    value = lambda ids: sum(i << (bits * (k - 1 - j)) for j, i in enumerate(ids))
    split = lambda v: (v >> 63, v & ((1 << 63) - 1))
    got = [(r.hi, r.lo, r.next_hi, r.next_lo) for r in chain.packed(df, k, bits).collect()]
    assert got == [(*split(value(s)), *split(value([*s[1:], f]))) for s, f, _ in rows]
    assert [tuple(x[:2]) for x in sorted(got)] == [split(value(s)) for s in sorted(s for s, _, _ in rows)]


def test_packed_states_that_do_not_fit(spark):
    df = spark.createDataFrame([([1, 2, 3], 4, 1)], "key array<bigint>, follow_id bigint, n bigint")
    with pytest.raises(ValueError):
        chain.packed(df, 3, 43)
    assert chain.id_bits(0) == 1 and chain.id_bits(255) == 8 and chain.id_bits(256) == 9


def test_state_keys_differ(spark):
    states = [["a b", "c"], ["a", "b c"], ["a\\", "sb c"], ["a\\s", "b"], ["a ", "b"], ["a", " b"], ["a\\sb", "c"]]
    df = spark.createDataFrame([(s,) for s in states], "state array<string>")
    keys = [r.k for r in df.select(chain.state_key(F.col("state")).alias("k")).collect()]
    assert len(set(keys)) == len(states) and keys == [" ".join(map(chain.escaped, s)) for s in states]
