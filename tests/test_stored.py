"""Walks that look states up in sorted files, and what saved tables hold."""

import glob

import pytest
from pyspark.sql import functions as F

from tests.test_walks import model_rows, walk_by_force
from tokenweave import MarkovModel
from tokenweave.operators import chain, stored, travel, walk
from tokenweave.sources import tables

ROWS = "state array<string>, follow string, n bigint"


def test_a_large_model_is_written_once_and_walked_in_one_round(spark, monkeypatch):
    """Nothing is made of the model but its sorted rows, and forced words need no tables of their own."""
    made = []
    monkeypatch.setattr(stored, "written", lambda df, name: made.append(name) or df.localCheckpoint())
    runs = [([f"{c}{i}" for i in range(40)],) for c in "abcdef"] * 2
    model = chain.count(chain.transitions(spark.createDataFrame(runs, "words array<string>"), 2)).localCheckpoint()
    rounds = []
    got = travel.travel_walk(walk.requests(spark, 30), model, 2, 1.0, 1, 1000, rounds=rounds).collect()
    assert {tuple(r.words) for r in got} <= {tuple(w) for (w,) in runs} and made == ["stored-walk"] and len(rounds) == 1
    table = travel.ranges(model, 2)
    assert spark.read.parquet(*table.parts).columns == ["key", "follow", "n"] and spark.read.parquet(*table.parts).count() == model.count()
    monkeypatch.setattr(stored, "STRIDE", 7)
    assert {tuple(r.words) for r in travel.travel_walk(walk.requests(spark, 30), table, 2, 1.0, 1, 1000).collect()} == {tuple(r.words) for r in got}


@pytest.mark.parametrize("k, temperature", [(1, 1.5), (2, 1.0)])
def test_states_cross_files_and_row_groups(spark, monkeypatch, k, temperature):
    for name, value in (("GROUP_ROWS", 3), ("GROUPS", 2), ("HOT_ENTRIES", 9)):
        monkeypatch.setattr(stored, name, value)
    monkeypatch.setattr(travel, "RANGE_ROWS", 7)
    rows = model_rows(11, k) + [(["z" * 5000] * k, f"f{j:02d}", j + 1) for j in range(40)]
    table = travel.ranges(spark.createDataFrame(rows, ROWS), k, temperature)
    want = {}
    for s, f, n in rows:
        want.setdefault(tuple(s), {})[f] = n
    for s, followers in want.items():
        got = table.rows(" ".join(map(chain.escaped, s)))
        assert list(zip(got.column("follow").to_pylist(), got.column("n").to_pylist())) == sorted(followers.items(), key=lambda x: x[0].encode())
    assert table.rows("no such") is None and table.rows("") is None and table.rows("￿") is None
    asked = [(i, 0, rows[(7 * i) % len(rows)][0]) for i in range(20)]
    got = {r.walk_id: (r.words, r.status) for r in travel.travel_walk(spark.createDataFrame(asked, "walk_id bigint, attempt int, init array<string>"), table, k, temperature, 3, 50).collect()}
    assert got == {i: walk_by_force(rows, k, temperature, 3, i, 0, s, 50) for i, _, s in asked}


def test_folders_that_tasks_cannot_open(spark, monkeypatch):
    assert not stored.readable(["store://x/part-00000.parquet"]) and stored.readable(["file:///x/part-00000.parquet"])
    monkeypatch.setattr(travel, "readable", lambda files: False)
    rows = model_rows(5, 2)
    got = {r.walk_id: (r.words, r.status) for r in travel.travel_walk(walk.requests(spark, 20), spark.createDataFrame(rows, ROWS), 2, 1.5, 3, 5).collect()}
    assert got == {i: walk_by_force(rows, 2, 1.5, 3, i, 0, None, 5) for i in range(20)}


def test_tables_are_walked_without_rounds_of_lookups(spark, monkeypatch, tmp_path):
    """No job a step, and no rows of a state through the driver."""
    rows, path = model_rows(4, 1), f"file://{tmp_path}/m"
    tables.save(MarkovModel(spark.createDataFrame(rows, ROWS), 1, 1.5), path)
    slow = {r.walk_id: (r.words, r.status) for r in tables.paged_walk(walk.requests(spark, 5), lambda s: tables.lookup_all(spark, path, s), 1, 1.5, 3, 4).collect()}
    monkeypatch.setattr(tables, "paged_walk", None)
    want = {i: walk_by_force(rows, 1, 1.5, 3, i, 0, None, 30) for i in range(20)}
    assert {r.walk_id: (r.words, r.status) for r in tables.walk(spark, path, walk.requests(spark, 20), 3, 30).collect()} == want
    assert slow == {i: walk_by_force(rows, 1, 1.5, 3, i, 0, None, 4) for i in range(5)}


def test_saved_rows_hold_a_state_once(spark, tmp_path):
    """the start index is of states with sentinels; tables of version 2, which had all states, give the same."""
    new, old = f"file://{tmp_path}/new", f"file://{tmp_path}/old"
    model = spark.createDataFrame([(s, f, n) for s, f, n in model_rows(6, 2)] + [(["w1", "\\s \\"], "x", 2)], ROWS)
    m = MarkovModel(model, 2, 1.5)
    tables.save(m, new)
    assert spark.read.parquet(f"{new}/transitions").columns == ["key", "follow", "n"]
    assert spark.read.parquet(f"{new}/starts").where(~F.array_contains("state", chain.BEGIN)).isEmpty()
    model.withColumn("key", chain.state_key(F.col("state"))).repartitionByRange("key").sortWithinPartitions("key", "follow").write.parquet(f"{old}/transitions")
    tables.generate.start_index(model).write.parquet(f"{old}/starts")
    spark.createDataFrame([(2, 2, 1.5)], "version int, state_size int, temperature double").write.parquet(f"{old}/meta")
    get = lambda df: sorted(map(str, df.collect()))
    for path in (new, old):
        assert get(tables.load(spark, path).transitions) == get(model)
        assert get(tables.starts(spark, path, ["w1"], False, 5)) == get(tables.generate.start_states(model, 2, ["w1"], False, 5))
        assert get(tables.lookup(spark, path, ["w1", "\\s \\"])) == get(model.where(F.col("follow") == "x").where("n = 2 and state[0] = 'w1'"))
        assert get(tables.walk(spark, path, walk.requests(spark, 9), 3)) == get(walk.walk(walk.requests(spark, 9), model, 2, 1.5, 3))
    assert glob.glob(f"{tmp_path}/new/transitions/*.parquet")


def test_common_words_keep_transitions_in_place(spark, monkeypatch):
    """With a vocabulary above the bound, ids are the same; only rows with rare words are joined by a shuffle."""
    model = spark.createDataFrame(model_rows(8, 2, 300, 60), ROWS)
    vocab = chain.vocabulary(model).localCheckpoint()
    want = sorted(map(str, chain.encode(model, vocab, 2).collect()))
    monkeypatch.setattr(chain, "BROADCAST_WORDS", 20)
    monkeypatch.setattr(chain, "COMMON_SAMPLE", 2)
    out = chain.encode(model, vocab, 2)
    assert sorted(map(str, out.collect())) == want and len(want) == model.count()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    few = chain.encode(model, vocab.where("word <> 'w1'"), 2)  # words that the vocabulary lacks end a transition
    assert few.count() == model.where("not array_contains(state, 'w1') and follow <> 'w1'").count()


def test_rows_are_ranged_once(spark):
    """Places of sparse rows need one shuffle of the rows, ranks one of the words."""
    encoded = spark.createDataFrame([([i % 37, i % 5], i % 11, 1 + i % 3) for i in range(400)], "key array<bigint>, follow_id bigint, n bigint").groupBy("key", "follow_id").agg(F.sum("n").alias("n"))
    rows = chain.csr(encoded, lambda n: n).orderBy("state_id").collect()
    assert [tuple(r.key) for r in rows] == sorted({tuple(r.key) for r in encoded.collect()}) and [r.state_id for r in rows] == list(range(len(rows)))
    start = 0
    for r in rows:
        assert r.row_start == start and r.degree == len(r.followers) and [f.follow_id for f in r.followers] == sorted(f.follow_id for f in r.followers)
        assert [f.cum for f in r.followers] == [float(sum(g.n for g in r.followers[: i + 1])) for i in range(r.degree)]
        start += r.degree
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(chain.csr(encoded)) == 1  # over one row a partition
    ranked = chain.ranked(spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("w")), "w", "r")
    assert [r.r for r in ranked.orderBy("w").collect()] == list(range(1000)) and windows(ranked) == 1


def test_vocabulary_without_training(spark):
    """the words of the runs are those of their model."""
    runs = spark.createDataFrame([(["b", "a", "c"],), (["a", chain.END],), ([],), (None,)], "words array<string>")
    get = lambda df: sorted((r.word, r.word_id) for r in df.collect())
    assert get(chain.vocabulary_of_runs(runs)) == get(chain.vocabulary(chain.train(runs, 2)))
    assert get(chain.vocabulary_of_runs(runs.where("false"))) == []


def test_records_are_written_where_they_lie(spark, tmp_path):
    """F16: records go into the file from the tables of their ranks, without another shuffle; a batch may hold several ranges."""
    import pyarrow as pa

    from tokenweave.sources import mapped

    batch = pa.record_batch([pa.array([4, 5, 9, 0, 1, 2], pa.int64()), pa.array([[i] for i in range(6)])], ["rank", "x"])
    got = [(b.column(0).to_pylist(), b.column(1).flatten().to_pylist()) for b in mapped._follow_on([batch.slice(0, 0), batch])]
    assert got == [([4, 5], [0, 1]), ([9], [2]), ([0, 1, 2], [3, 4, 5])]
    model = spark.createDataFrame([(s, f, n) for s, f, n in model_rows(9, 2) if s[0] and f], ROWS)
    mapped.save(MarkovModel(model, 2, 1.5), f"{tmp_path}/m")
    assert sorted(map(str, mapped.load(spark, f"{tmp_path}/m", 7).transitions.collect())) == sorted(map(str, model.collect()))
