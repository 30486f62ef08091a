"""Training by one text a window, and running sums by one text a state."""

from collections import Counter

from pyspark.sql import functions as F

from tokenweave.operators import chain, sampling

ODD = [["a b", "c"], ["a", "b c"], ["a", "b", "c"], ["\\s", "\\", " ", "\\b", "\\n", ""], [None, "n"], ["", ""], [], ["x\\", "s"], ["x", "\\s"], [chain.BEGIN, chain.END]]


def expected(runs, k):
    out = Counter()
    for r in runs:
        items = [chain.BEGIN] * k + r + [chain.END]
        out.update((tuple(items[i : i + k]), items[i + k]) for i in range(len(r) + 1))
    return out


def test_words_with_separators_and_nulls(spark):
    """Words that hold the separator or the escape, empty and null words keep their windows apart."""
    runs = spark.createDataFrame([(x,) for x in ODD * 2], "words array<string>")
    for k in (1, 2, 3):
        got = chain.train(runs, k).collect()
        assert {(tuple(r.state), r.follow): r.n for r in got} == expected(ODD * 2, k)
        assert len(got) == len(expected(ODD, k))


def test_one_text_is_shuffled_for_a_window(spark):
    """The shuffle of training has the key and the count, not a column a word."""
    runs = spark.createDataFrame([(["a", "b"],)], "words array<string>")
    plan = chain.train(runs, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "__w" not in plan.split("Exchange hashpartitioning")[1].split(",")[0]


def test_segments_of_a_hot_state_are_numbered_through(spark, monkeypatch):
    """A state summed in several parts has the segments that one part would have: full ones up to the last."""
    monkeypatch.setattr(sampling, "SEGMENT", 64)
    rows = [(["hot"], f"w{i:04d}", 1 + i % 3) for i in range(1000)] + [([f"s{i % 50}"], f"w{i:04d}", 2) for i in range(200)] + [(["odd \\ one"], "x", 1)]
    model = spark.createDataFrame(rows, "state array<string>, follow string, n bigint")
    get = lambda: {(tuple(r.state), round(r.lo, 6), round(r.hi, 6), round(r.total, 6), r.degree, r.follows[0]) for r in sampling.segments(model, 1.5).collect()}
    want = get()
    monkeypatch.setattr(sampling, "HOT_FOLLOWERS", 100)
    assert sampling._numbered_cdf(model, 1.5).where("state[0] = 'hot'").select("p").distinct().count() > 1
    got = get()
    assert got == want
    assert sorted(r[4] for r in got if r[0] == ("hot",)) == [1000 % 64] + [64] * (1000 // 64)


def test_hot_states_by_a_sample(spark, monkeypatch):
    """Sampled followers find the states that are far above the bound, and none far below."""
    monkeypatch.setattr(sampling, "HOT_FOLLOWERS", 2048)
    rows = spark.range(9000).select(F.when(F.col("id") < 8000, "hot").otherwise("cold").alias("key"), F.concat(F.lit("w"), "id").alias("follow"))
    assert [r.key for r in sampling.hot_states(rows, "key").collect()] == ["hot"]


def test_large_rows_of_ids_are_walked_in_ranges(spark, monkeypatch):
    """Sparse rows and coded models that are too large for a broadcast give the walks of the broadcast ones."""
    from tokenweave.operators import travel, walk

    monkeypatch.setattr(travel, "HOT_STATES", 3)
    runs = [([f"w{(i * i + j * 7 + i * j) % 11}" for j in range(4 + i % 5)],) for i in range(60)]
    model = chain.train(spark.createDataFrame(runs, "words array<string>"), 2).localCheckpoint()
    vocab = chain.vocabulary(model).localCheckpoint()
    ends = {r.word: r.word_id for r in vocab.collect()}
    enc = chain.encode(model, vocab, 2).localCheckpoint()
    begin, end = ends[chain.BEGIN], ends[chain.END]
    rows = chain.csr(enc, lambda n: sampling.weight(n, 1.5)).localCheckpoint()
    get = lambda df: {(r.walk_id, r.status, tuple(r.words)) for r in df.collect()}
    asked = walk.requests(spark, 30)
    want = get(walk.csr_walk(asked, rows, 2, begin, end, 7))
    monkeypatch.setattr(walk, "BROADCAST_BYTES", 1000)
    assert get(walk.csr_walk(asked, rows, 2, begin, end, 7, temperature=1.5)) == want
    assert get(walk.id_walk(asked, enc, 2, begin, end, 1.5, 7)) == want


def test_totals_make_no_row_twice(spark):
    model = spark.createDataFrame([(["a", "b"], "x", 2), (["a", "b"], "y", 3), (["a b", ""], "x", 1)], "state array<string>, follow string, n bigint")
    got = chain.totals(model)
    assert got.first() == (2, 3, 6) and "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert chain.totals(model.where("n > 9")).first() == (0, 0, None)
