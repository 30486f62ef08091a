import pytest
from pyspark.sql import functions as F

from tokenweave import MarkovModel
from tokenweave.functions.tokenize import Tokenizer
from tokenweave.operators import algebra, chain, generate, sampling, walk

B, E = chain.BEGIN, chain.END


def model_of(spark, sentences, k, **options):
    df = spark.createDataFrame([(s.split(),) for s in sentences], "words array<string>")
    return MarkovModel.from_sentences(df, k, **options)


def as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r.state), {})[r.follow] = r.n
    return out


def test_counts_of_two_runs(spark):
    got = as_dict(model_of(spark, ["red fish swims", "red fish sleeps"], 1).transitions)
    assert got == {(B,): {"red": 2}, ("red",): {"fish": 2}, ("fish",): {"swims": 1, "sleeps": 1}, ("swims",): {E: 1}, ("sleeps",): {E: 1}}


def test_padding_at_order_two(spark):
    got = as_dict(model_of(spark, ["x y"], 2).transitions)
    assert got == {(B, B): {"x": 1}, (B, "x"): {"y": 1}, ("x", "y"): {E: 1}}


def test_state_size_below_one(spark):
    with pytest.raises(ValueError):
        model_of(spark, ["x"], 0)


def test_empty_runs(spark):
    df = spark.createDataFrame([(["u", "v", "w"],), ([],), (["v", "w", "u"],), (None,)], "words array<string>")
    assert as_dict(MarkovModel.from_sentences(df, 1).transitions)[(B,)] == {"u": 1, "v": 1}
    assert as_dict(MarkovModel.from_sentences(df, 1, keep_empty=True).transitions)[(B,)] == {"u": 1, "v": 1, E: 1}


def test_begin_state_shift_and_text(spark):
    r = spark.range(1).select(chain.begin_state(3).alias("b"), chain.shift(F.array(F.lit("p"), F.lit("q")), F.lit("r"), 2).alias("s"), chain.shift(F.array(F.lit("p")), F.lit("r"), 1).alias("t"), chain.state_text(F.array(F.lit("p"), F.lit("q"))).alias("x")).first()
    assert r.b == [B] * 3 and r.s == ["q", "r"] and r.t == ["r"] and r.x == "(p, q)"


def test_states_of_different_length_or_order_differ(spark):
    df = spark.createDataFrame([(["p", "q"],), (["q", "p"],), (["p"],), (["p", "q"],)], "s array<string>")
    assert df.distinct().count() == 3


def test_lookup(spark):
    m = model_of(spark, ["n o", "n p", "n p"], 1).transitions
    assert {r.follow: r.n for r in chain.lookup(m, ["n"]).collect()} == {"o": 1, "p": 2}
    assert chain.lookup(m, ["n"], "p").first().n == 2
    assert chain.lookup(m, ["zz"]).count() == 0
    assert chain.follower_map(m).where(F.col("state") == F.array(F.lit("n"))).first().followers == {"o": 1, "p": 2}


def test_weighting_of_moves(spark):
    m = model_of(spark, ["s hot"] * 9 + ["s cold"], 1)
    rolls = spark.range(1000).select(F.array(F.lit("s")).alias("state"), sampling.roll(3, F.col("id")).alias("u"))
    hot = sampling.move(rolls, m.cdf()).where("follow = 'hot'").count()
    assert 820 <= hot <= 960


def test_unknown_state_in_move(spark):
    m = model_of(spark, ["s t"], 1)
    rolls = spark.createDataFrame([(["zz"], 0.5), (["s"], 0.5)], "state array<string>, u double")
    assert sampling.move(rolls, m.cdf()).count() == 1
    assert {r.state[0]: r.follow for r in sampling.move(rolls, m.cdf(), "left").collect()} == {"zz": None, "s": "t"}


def test_cdf_ranges_meet_and_end_at_the_total(spark):
    m = model_of(spark, ["a b", "a c", "a c", "a d"], 1)
    for t in (0.5, 1.0, 2.0, float("inf")):
        rows = m.with_temperature(t).cdf().where(F.col("state") == F.array(F.lit("a"))).orderBy("follow").collect()
        assert rows[0].lo == 0 and all(x.hi == y.lo for x, y in zip(rows, rows[1:])) and rows[-1].hi == rows[-1].total
        if t == float("inf"):
            assert [r.w for r in rows] == [1, 1, 1]
        if t == 0.5:
            assert [r.w for r in rows] == [1, 4, 1]


def test_temperature_must_be_positive(spark):
    m = model_of(spark, ["a b"], 1)
    for t in (0, -1.0):
        with pytest.raises(ValueError):
            m.with_temperature(t)


def test_temperature_flattens_and_sharpens(spark):
    m = model_of(spark, ["s hot"] * 9 + ["s cold"], 1)
    rolls = spark.range(2000).select(F.array(F.lit("s")).alias("state"), sampling.roll(5, F.col("id")).alias("u"))
    cold = {t: sampling.move(rolls, m.with_temperature(t).cdf()).where("follow = 'cold'").count() for t in (0.5, 1.0, 3.0)}
    assert cold[0.5] < cold[1.0] < cold[3.0]


def test_single_path_walk_by_both_strategies(spark):
    m = model_of(spark, ["one two three four"], 2)
    for s in ("broadcast", "superstep"):
        assert [(r.words, r.status) for r in m.walk(3, strategy=s).collect()] == [(["one", "two", "three", "four"], "end")] * 3


def test_strategies_and_seeds(spark):
    m = model_of(spark, ["a b c", "a c b", "b a c", "c b a b c", "b c a a"], 1)
    got = {s: {r.walk_id: (r.words, r.status) for r in m.walk(40, seed=9, strategy=s, max_steps=6).collect()} for s in ("broadcast", "superstep")}
    assert got["broadcast"] == got["superstep"] and {v[1] for v in got["broadcast"].values()} == {"end", "cut"}
    assert got["broadcast"] == {r.walk_id: (r.words, r.status) for r in m.walk(40, seed=9, max_steps=6).collect()}
    assert got["broadcast"] != {r.walk_id: (r.words, r.status) for r in m.walk(40, seed=10, max_steps=6).collect()}
    with pytest.raises(ValueError):
        m.walk(1, strategy="other")


def test_walks_stay_inside_the_model(spark):
    m = model_of(spark, ["a b c", "a c b", "b a c"], 1)
    known = as_dict(m.transitions)
    for r in m.walk(30, seed=2).collect():
        path = [B, *r.words, E]
        assert all(y in known[(x,)] for x, y in zip(path, path[1:]))


def test_walk_from_a_state_and_from_an_unknown_one(spark):
    m = model_of(spark, ["a b c d"], 2)
    req = spark.createDataFrame([(0, 0, ["b", "c"]), (1, 0, ["zz", "c"])], "walk_id bigint, attempt int, init array<string>")
    for s in ("broadcast", "superstep"):
        assert {r.walk_id: (r.words, r.status) for r in m.walk_from(req, strategy=s).collect()} == {0: (["d"], "end"), 1: ([], "dead")}


def test_sentinel_in_the_corpus_stops_a_walk(spark):
    m = model_of(spark, [f"a {E} b"], 1)
    assert m.walk(1).first().words == ["a"]


def test_combine_weights(spark):
    m = model_of(spark, ["p q"], 1)
    got = as_dict(MarkovModel.combine([m, m], [1.0, 2.0]).transitions)
    assert got[("p",)] == {"q": 3}
    assert as_dict(MarkovModel.combine([m, m]).transitions)[("p",)] == {"q": 2}


def test_combine_rounds_half_to_even_before_summing(spark):
    m = model_of(spark, ["p q"] * 3 + ["p r"], 1)  # 3 * 0.5 = 1.5 -> 2, 1 * 0.5 = 0.5 -> 0
    assert as_dict(MarkovModel.combine([m, m], [0.5, 0.5]).transitions)[("p",)] == {"q": 4}
    assert as_dict(MarkovModel.combine([m, m], [1.0, 0.0]).transitions) == as_dict(m.transitions)
    assert as_dict(MarkovModel.combine([m, m], [1.0, -1.0]).transitions) == as_dict(m.transitions)


def test_combine_of_disjoint_models_is_the_union(spark):
    a, b = model_of(spark, ["k l m n o"], 1), model_of(spark, ["v w x y z"], 1)
    both = model_of(spark, ["k l m n o", "v w x y z"], 1)
    assert as_dict(MarkovModel.combine([a, b]).transitions) == as_dict(both.transitions)


def test_combine_errors(spark):
    a, b = model_of(spark, ["k l"], 1), model_of(spark, ["k l"], 2)
    with pytest.raises(ValueError):
        MarkovModel.combine([])
    with pytest.raises(ValueError):
        MarkovModel.combine([a, b])
    with pytest.raises(ValueError):
        MarkovModel.combine([a, a], [1.0])


def test_combined_temperature_and_source(spark):
    docs = spark.createDataFrame([(1, "A b c.")], "doc_id bigint, text string")
    with_source = MarkovModel.from_text(docs, 1, temperature=2.0)
    both = MarkovModel.combine([with_source, with_source])
    assert both.temperature == 1.0 and [r.source for r in both.source.collect()] == ["A b c. "] * 2
    assert MarkovModel.combine([with_source, model_of(spark, ["a b"], 1)]).source is None


def test_prune(spark):
    m = model_of(spark, ["a b", "a b", "a c", "c d"], 1)
    small, gone = m.prune(2)
    assert as_dict(small.transitions) == {(B,): {"a": 3}, ("a",): {"b": 2}, ("b",): {E: 2}}
    assert gone.first().n_removed == 5
    assert as_dict(m.prune(1)[0].transitions) == as_dict(m.transitions)
    for f in (algebra.prune, algebra.removed):
        with pytest.raises(ValueError):
            f(m.transitions, 0)


def test_pruned_walk_may_be_dead(spark):
    m = model_of(spark, ["a b c", "a b d"], 1).prune(2)[0]
    assert [(r.words, r.status) for r in m.walk(1).collect()] == [(["a", "b"], "dead")]


def test_totals_agree_between_forms(spark):
    for k in (1, 2, 3):
        m = model_of(spark, ["a b c a b", "b c a", "c"], k).transitions
        t = chain.totals(m).first()
        assert t.n_transitions == 6 + 4 + 2
        vocab = chain.vocabulary(m)
        enc = chain.encode(m, vocab, k)
        assert enc.agg(F.sum("n")).first()[0] == t.n_transitions
        rows = chain.csr(enc).orderBy("state_id").collect()
        assert len(rows) == t.n_states and [r.row_start for r in rows] == [sum(x.degree for x in rows[:i]) for i in range(len(rows))]
        assert [r.word_id for r in vocab.orderBy("word").collect()] == list(range(vocab.count()))


def test_keyed_rows_equal_runs(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b")], "k int, t int, tok string")
    for k in (1, 2):
        by_rows = as_dict(chain.count(chain.keyed_transitions(rows, k, "k", ["t"], "tok")))
        assert by_rows == as_dict(model_of(spark, ["a b a", "b"], k).transitions)


def test_requests(spark):
    assert walk.requests(spark, 3, 2).count() == 6


def test_sparse_rows_hold_cumulative_weights_and_ids_walk_as_words(spark):
    runs = spark.createDataFrame([("a b c".split(),), ("a b d".split(),), ("a c d b".split(),), ("a b c".split(),)], "words array<string>")
    m = chain.count(chain.transitions(runs, 1))
    vocab = chain.vocabulary(m)
    rows = chain.csr(chain.encode(m, vocab, 1), lambda n: sampling.weight(n, 2.0)).collect()
    for r in rows:
        total = 0.0
        for f in r.followers:
            total += f.n**0.5
            assert abs(f.cum - total) < 1e-12
    ids = {r.word: r.word_id for r in vocab.collect()}
    words = {i: w for w, i in ids.items()}
    req = walk.requests(spark, 30)
    want = {r.walk_id: (r.words, r.status) for r in walk.walk(req, m, 1, 1.5, 3).collect()}
    for strategy in ("broadcast", "superstep"):
        got = walk.id_walk(req, chain.encode(m, vocab, 1), 1, ids[chain.BEGIN], ids[chain.END], 1.5, 3, strategy=strategy).collect()
        assert {r.walk_id: ([words[i] for i in r.words], r.status) for r in got} == want


def test_own_tokenizer_in_training_and_generation(spark):
    own = Tokenizer(lambda text: F.split(text, ";"), lambda unit: F.filter(F.split(unit, "-"), lambda w: w != ""), lambda words: F.array_join(words, "-"))
    docs = spark.createDataFrame([(1, "a-b-c;a-b-d")], "doc_id bigint, text string")
    m = MarkovModel.from_text(docs, 1, tokenizer=own)
    assert {(r.state[0], r.follow): r.n for r in m.transitions.collect()} == {(chain.BEGIN, "a"): 2, ("a", "b"): 2, ("b", "c"): 1, ("b", "d"): 1, ("c", chain.END): 1, ("d", chain.END): 1}
    said = {r.sentence for r in m.make_sentences(5, limits=generate.Limits(test_output=False)).collect()}
    assert said <= {"a-b-c", "a-b-d"} and said


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_train_counts_what_transitions_list(spark, k):
    import random

    rnd = random.Random(k)
    rows = [(d, p, [rnd.choice(["a", "b", "c d", "", None]) for _ in range(rnd.choice([0, 1, 2, 5, 9]))]) for d in range(12) for p in range(3)]
    runs = spark.createDataFrame([*rows, (99, 0, None), (98, 0, ["x"] * 3000)], "n long, i2 int, words array<string>")
    want = {}
    for d, p, words in sorted([*rows, (98, 0, ["x"] * 3000)], key=lambda r: r[:2]):
        items = [B] * k + words + [E]
        for i in range(len(words) + 1):
            key = (tuple(items[i : i + k]), items[i + k])
            n, first = want.get(key, (0, (d, p, i)))
            want[key] = (n + 1, first)
    listed = {(tuple(r.state), r.follow): r.n for r in chain.count(chain.transitions(runs.select("words"), k)).collect()}
    assert listed == {key: n for key, (n, _) in want.items()}
    trained = {(tuple(r.state), r.follow): (r.n, tuple(r.first)) for r in chain.train(runs, k, first=("n", "i2")).collect()}
    assert trained == want
    assert chain.train(runs.where("false"), k).collect() == []


def test_training_has_no_lambda_and_one_shuffle(spark):
    runs = spark.createDataFrame([(["a", "b"],)], "words array<string>")
    plan = chain.train(runs, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "lambda" not in plan
