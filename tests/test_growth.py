"""Steps that grew faster than their input: what is written and moved, with the same results."""

from pyspark.sql import functions as F

from tokenweave.functions import tokenize as T
from tokenweave.operators import overlap, walk
from tokenweave.plans import queries

TEXTS = ["The cat sat. The dog ran off. Yes", "A cat ran. The cat sat on it. Oh yes", None, "", "   ", "The cat sat on the mat! The end. No", "Concat sat. Oh no"]


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def names_written(monkeypatch, *modules):
    names = []
    for m in modules:
        real = m.written
        monkeypatch.setattr(m, "written", lambda df, name, real=real: names.append(name) or real(df, name))
    return names


def test_positions_of_documents_write_their_words_once(spark, tmp_path, monkeypatch):
    """no rejoined source, no sentences and no second copy of the model are written, and the answer is that of the scan."""
    docs_of(spark, TEXTS * 3).withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    want = {tuple(r) for r in queries.overlap_reject(spark, str(tmp_path), "documents").collect()}
    names = names_written(monkeypatch, queries)
    assert {tuple(r) for r in queries.overlap_positions_documents(spark, str(tmp_path)).collect()} == want and len(want) == queries.WALKS
    assert sorted(names) == ["candidates", "texts"]


def test_words_of_texts_without_a_shuffle(spark):
    docs = docs_of(spark)
    got = T.texts(docs).where(F.size("words") > 0)
    assert {r.doc_id: r.words for r in got.collect()} == {r.doc_id: r.words for r in overlap.positions(T.runs(docs)).collect()}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_short_grams_are_found_inside_words_and_across_them(spark, monkeypatch):
    """Whole words need no parts of words; pairs are those that begin with a word that ends with the gram's first."""
    docs = docs_of(spark)
    grams = ["cat", "oncat", "nca", "at sat", "cat s", "dog sat", "t sat.", "", "zz", "The cat", "Yes A"]
    flat = [" ".join(r.words) + " " for r in T.texts(docs).where(F.size("words") > 0).collect()]
    df = spark.createDataFrame([(g,) for g in grams], "gram string")
    assert {r.gram for r in overlap.found_by_positions(df, T.texts(docs)).collect()} == {g for g in grams if any(g in t for t in flat)}


def test_a_model_is_walked_from_its_ranges(spark):
    from tokenweave.operators import chain

    model = chain.train(T.runs(docs_of(spark)), 1)
    asked = walk.requests(spark, 40)
    want = {r.walk_id: r.words for r in walk.walk(asked, model, 1, 1.0, 7).collect()}
    assert {r.walk_id: r.words for r in walk.ranged_walk(asked, model, 1, 1.0, 7).collect()} == want
    assert not walk.ranged_walk(asked, model.limit(0), 1, 1.0, 7).where("status != 'dead'").count()


def test_only_the_windows_of_wanted_states_are_counted(spark):
    """the states that are looked up decide which windows are counted, before the shuffle; odd words and nulls keep their states."""
    from tokenweave.operators import chain

    runs = spark.createDataFrame([(w,) for w in [["a b", "c"], ["a", "b c"], ["\\s", "\\", " "], [None, "n"], ["a", "b", "c"], ["a", "b", "d"]] * 2], "words array<string>")
    asked = [["a", "b"], ["a b", "c"], [None, "n"], ["no", "such"], [chain.BEGIN, chain.BEGIN], ["a"], ["\\s", "\\"]]
    states = spark.createDataFrame([(s,) for s in asked], "state array<string>")
    rows = lambda m: {(tuple(r.state), r.follow): r.n for r in m.collect()}
    got = chain.train(runs, 2, states=states)
    assert rows(got) == {x: n for x, n in rows(chain.train(runs, 2)).items() if list(x[0]) in asked} and rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Exchange hashpartitioning(key") :]


def test_a_missing_state_moves_to_null(spark, tmp_path, monkeypatch):
    docs_of(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("1", "The cat sat. Nobody knew why"), ("2", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = names_written(monkeypatch, queries)
    got = {r.state: r.follow for r in queries.move_missing(spark, str(tmp_path)).collect()}
    assert names == ["rolls", "met"]
    assert got["Nobody knew"] is None and got["The cat"] == "sat" and len(got) == 7


def test_rolls_pick_from_the_rows_of_the_cdf(spark, monkeypatch):
    """one window and no groups of rows; at all temperatures, and with hot states, the follower is the one that the running sums tell."""
    from tokenweave.operators import sampling

    model = spark.createDataFrame([([s], f, n) for s, fs in {"x": "abcdefg", "y": "q", "z": "uv"}.items() for n, f in enumerate(fs, 1)], "state array<string>, follow string, n bigint")
    rolls = [0.0, 0.25, 0.5, 0.75, 0.999]
    tell = lambda m: sampling.Hot(m, lambda states: m.join(states, "state", "left_semi"))

    def expected(t):
        out = []
        for s, fs in {"x": "abcdefg", "y": "q", "z": "uv"}.items():
            sums = [sum(i ** (1 / t) for i in range(1, j + 1)) for j in range(1, len(fs) + 1)]
            out += [(s, u, next(f for f, c in zip(fs, sums) if u * sums[-1] < c)) for u in rolls]
        return sorted(out)

    plan = sampling.move_all(model, rolls, told=tell(model))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" not in plan
    for hot in (sampling.HOT_FOLLOWERS, 2):
        monkeypatch.setattr(sampling, "HOT_FOLLOWERS", hot)
        for told in (None, tell(model)):
            for t in (1.0, 2.0):
                assert sorted((r.state[0], r.u, r.follow) for r in sampling.move_all(model, rolls, t, told).collect()) == expected(t)


def test_training_counts_bounded_pieces(spark, tmp_path, monkeypatch):
    """a large file's windows are not counted by as few tasks as it has splits; the results are the same."""
    docs_of(spark, TEXTS * 20).withColumn("doc_id", F.monotonically_increasing_id()).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    answers = lambda: [sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (queries.prune_2, queries.prune_removed)]
    want = answers()
    size = 20 * sum(len(t) for t in TEXTS if t)
    monkeypatch.setattr(queries, "PIECE_BYTES", 100)
    assert queries.training_documents(spark, str(tmp_path)).rdd.getNumPartitions() == -(-size // 100) > spark.sparkContext.defaultParallelism
    assert answers() == want and want[0] and want[1][0][0] == sum(r.n == 1 for r in queries.model(spark, str(tmp_path), 2).collect())
