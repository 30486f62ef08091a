"""Chunks, positions, start index, waves, and saved models."""

import random

import pytest
from pyspark.sql import functions as F

from tokenweave import MarkovModel
from tokenweave.operators import chain, generate, overlap
from tokenweave.operators.generate import Limits
from tokenweave.sources import tables


def texts(seed, n=12):
    r = random.Random(seed)
    vocab = ["a", "b", "ab", "ba", "cat", "catalog", "log", "é😀", "o", "the", "then"]
    return [[[r.choice(vocab) for _ in range(r.randrange(1, 9))] for _ in range(r.randrange(0, 6))] for _ in range(n)]


def runs_of(spark, docs):
    rows = [(i, j, w) for i, d in enumerate(docs) for j, w in enumerate(d)]
    return spark.createDataFrame(rows, "doc_id bigint, pos int, words array<string>").repartition(3)


def cut_grams(seed, docs, n=300):
    """Substrings of the texts and of words put together at random, as grams of one to six words."""
    r = random.Random(seed)
    flat = [" ".join(w for s in d for w in s) for d in docs if d]
    words = [w for d in docs for s in d for w in s]
    out = {"", "a", "at", "og a", "z", "zz zz", "a zz b"}
    for _ in range(n):
        t = r.choice(flat) if r.random() < 0.7 else " ".join(r.choice(words) for _ in range(6))
        a = r.randrange(len(t))
        g = t[a : a + r.randrange(1, 30)].strip(" ")
        out.add(g)
    return sorted(out)


@pytest.mark.parametrize("size, carry", [(1, 0), (7, 3), (64, 29), (64, 500), (1 << 20, 10)])
def test_chunks(spark, size, carry):
    docs = texts(1)
    whole = "".join(" ".join(w) + " " for d in docs for w in d)
    got = {r.chunk: r.source for r in overlap.chunks(runs_of(spark, docs), size, carry).collect()}
    assert got == {c: whole[max(0, c * size - carry) : (c + 1) * size] for c in range(-(-len(whole) // size))}


def test_chunks_of_nothing_and_bad_sizes(spark):
    assert overlap.chunks(runs_of(spark, []), 10, 3).count() == 0
    for bad in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            overlap.chunks(runs_of(spark, texts(1)), *bad)


def test_overlap_with_the_corpus_does_not_depend_on_the_chunks(spark):
    docs = texts(2, 30)
    whole = "".join(" ".join(w) + " " for d in docs for w in d)
    r = random.Random(4)
    flat = whole.split()
    cands = [(i, flat[a : a + n] if i % 3 else [r.choice(flat) for _ in range(n)]) for i in range(60) for a, n in [(r.randrange(len(flat) - 9), r.randrange(1, 9))]] + [(90, []), (91, ["zz"])]
    df = spark.createDataFrame(cands, "walk_id int, words array<string>")

    def bad(w):
        over = min(15, int(len(w) * 0.7 + 0.5))
        return any(" ".join(w[i : i + over + 1]) in whole for i in range(max(len(w) - over, 1)))

    want = {i for i, w in cands if bad(w)}
    for size in (64, 1 << 20):
        assert {x.walk_id for x in overlap.rejected_in_corpus(df, runs_of(spark, docs), ["walk_id"], size=size).collect()} == want
    assert 90 in want and 91 not in want


@pytest.mark.parametrize("seed", [5, 6])
def test_positions_find_what_contains_finds(spark, seed):
    docs = texts(seed, 15)
    grams = cut_grams(seed, docs)
    flat = [" ".join(w for s in d for w in s) + " " for d in docs if any(d)]
    df = spark.createDataFrame([(g,) for g in grams], "gram string")
    got = {r.gram for r in overlap.found_by_positions(df, overlap.positions(runs_of(spark, docs))).collect()}
    want = {g for g in grams if any(g in t for t in flat)}
    assert got == want and 20 < len(want) < len(grams)
    assert not overlap.found_by_positions(df, overlap.positions(runs_of(spark, []))).count()
    assert not overlap.found_by_positions(df.limit(0), overlap.positions(runs_of(spark, docs))).count()


def test_positions_reject_what_scans_reject(spark):
    docs = texts(7, 20)
    runs = runs_of(spark, docs)
    r = random.Random(8)
    flat = [w for d in docs for s in d for w in s]
    cands = spark.createDataFrame([(i, [r.choice(flat) for _ in range(r.randrange(0, 6))]) for i in range(80)], "walk_id int, words array<string>")
    scans = {x.walk_id for x in overlap.rejected(cands, overlap.rejoined(runs), ["walk_id"]).collect()}
    assert {x.walk_id for x in overlap.rejected_by_positions(cands, overlap.positions(runs), ["walk_id"]).collect()} == scans and 0 < len(scans) < 80


SAID = ["the cat sat", "the catalog sat", "the", "then the cat", "the!x y", "a b\\ c", "the cat ran away", "a b c"]


def test_start_index_is_one_range(spark, tmp_path):
    model = MarkovModel.from_sentences(spark.createDataFrame([(s.split(" "),) for s in SAID] + [(["the cat", "x"],)], "words array<string>"), 2)
    path = str(tmp_path / "model")
    tables.save(model, path, 4)
    for beginning in (["the"], ["the", "cat"], ["a"], ["b\\"], ["the cat"], ["nothing"]):
        want = [(r.rank, r.state) for r in generate.start_states(model.transitions, 2, beginning, False, 3).orderBy("rank").collect()] if len(beginning) == 1 else None
        got = [(r.rank, r.state) for r in tables.starts(spark, path, beginning, False, 3).orderBy("rank").collect()]
        assert want is None or got == want
        if len(beginning) == 1:
            assert [s for _, s in got if [w for w in s if w != chain.BEGIN][:1] != beginning] == []
    assert len(tables.starts(spark, path, ["the"], False).collect()) == 3
    index = spark.read.parquet(f"{path}/starts").where(generate._begins(["the"]))
    plan = index._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(said,the )" in pushed and "LessThan(said,the!)" in pushed and "EqualTo(said,the)" in pushed


def test_sentence_with_start_from_tables(spark, tmp_path):
    model = MarkovModel.from_sentences(spark.createDataFrame([(s.split(" "),) for s in SAID], "words array<string>"), 2)
    path = str(tmp_path / "model")
    tables.save(model, path)
    limits = Limits(tries=3, test_output=False)
    for beginning, strict in (("the", False), ("the", True), ("the cat", True), ("then", False), ("no", False)):
        want = model.make_sentence_with_start(beginning, strict, 4, limits).first().sentence
        assert tables.make_sentence_with_start(spark, path, beginning.split(" "), strict, 4, limits).first().sentence == want


def test_waves_give_what_all_attempts_give(spark, monkeypatch):
    r = random.Random(1)
    runs = [[r.choice("abcdef") for _ in range(r.randrange(1, 9))] for _ in range(200)]
    model = MarkovModel.from_sentences(spark.createDataFrame([(w,) for w in runs], "words array<string>"), 1)
    req = spark.range(300).select(F.col("id").alias("walk_id"), F.lit(None).cast("array<string>").alias("init"))
    for limits in (Limits(tries=8, test_output=False, min_words=3), Limits(tries=8, test_output=False, min_words=9, max_chars=40), Limits(tries=3, test_output=False, max_words=0)):
        run = lambda waves: {x.walk_id: x.sentence for x in generate.make_sentences(req, model.transitions, 1, None, lambda w: F.array_join(w, " "), limits, seed=2, waves=waves).collect()}
        monkeypatch.setattr(generate, "AT_ONCE", 10_000)
        whole = run(all_ := [])
        monkeypatch.setattr(generate, "AT_ONCE", 0)
        assert run(waves := []) == whole and len(all_) == 1 and all_[0] == (300, 300 * limits.tries)
        if limits.min_words == 3:
            assert sum(w for _, w in waves) < 300 * limits.tries / 2 and [n for n, _ in waves] == sorted((n for n, _ in waves), reverse=True)
        assert sum(w for _, w in waves) <= 300 * limits.tries


def test_temperature_of_a_saved_model(spark, tmp_path):
    r = random.Random(2)
    model = MarkovModel.from_sentences(spark.createDataFrame([([r.choice("aaaabc") for _ in range(6)],) for _ in range(60)], "words array<string>"), 1, temperature=2.0)
    path = str(tmp_path / "model")
    tables.save(model, path)
    req = spark.range(30).select(F.col("id").alias("walk_id"), F.lit(0).alias("attempt"), F.lit(None).cast("array<string>").alias("init"))
    say = lambda df: {x.walk_id: x.words for x in df.collect()}
    stored, hot = say(tables.walk(spark, path, req, 1)), say(tables.walk(spark, path, req, 1, temperature=9.0))
    assert stored == say(model.walk(30, 1)) and hot == say(model.with_temperature(9.0).walk(30, 1)) and hot != stored
    for bad in (0, -1.0):
        with pytest.raises(ValueError):
            tables.walk(spark, path, req, 1, temperature=bad)
    limits = Limits(test_output=False)
    got = {x.walk_id: x.sentence for x in tables.make_sentences(spark, path, 10, 3, limits, temperature=0.5).collect()}
    assert got == {x.walk_id: x.sentence for x in model.with_temperature(0.5).make_sentences(10, 3, limits=limits).collect()}


def test_saved_states_with_spaces_are_told_apart(spark, tmp_path):
    model = MarkovModel.from_sentences(spark.createDataFrame([(["a b", "c", "x"],), (["a", "b c", "y"],)], "words array<string>"), 2)
    path = str(tmp_path / "model")
    tables.save(model, path)
    assert [r.follow for r in tables.lookup(spark, path, ["a b", "c"]).collect()] == ["x"]
    assert [r.follow for r in tables.lookup(spark, path, ["a", "b c"]).collect()] == ["y"]


def test_parsed_sentences_of_a_combination(spark):
    make = lambda rows: MarkovModel.from_text(spark.createDataFrame(rows, "doc_id bigint, text string"), 1)
    a, b = make([(1, "One two. Three four.")]), make([(1, "Five."), (2, "Six seven.")])
    both = MarkovModel.combine([a, b])
    assert sorted((r.part, r.key, r.pos, r.words) for r in both.parsed_sentences.collect()) == [("0", "1", 0, ["One", "two."]), ("0", "1", 1, ["Three", "four."]), ("1", "1", 0, ["Five."]), ("1", "2", 0, ["Six", "seven."])]
    three = MarkovModel.combine([both, a])
    assert sorted({r.part for r in three.parsed_sentences.collect()}) == ["0.0", "0.1", "1"]
    bare = MarkovModel.from_sentences(spark.createDataFrame([(["x"],)], "words array<string>"), 1)
    assert MarkovModel.combine([a, bare]).parsed_sentences is None
