import bisect
import collections
import hashlib
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tests.test_walks import walk_by_force
from tokenweave import MarkovModel
from tokenweave.operators import chain, generate, overlap
from tokenweave.operators.generate import Limits
from tokenweave.plans import queries

PROSE = "The cat saw the dog. The dog saw the bird. The bird saw the cat. A cat ran home. A dog ran away. The bird flew home."


def text_model(spark, text, k=2, **options):
    return MarkovModel.from_text(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), k, **options)


def test_generation_uses_the_corpus(spark):
    m = text_model(spark, PROSE, retain=False)
    vocabulary = set(PROSE.replace(".", " .").replace(" .", ".").split())
    got = [r.sentence for r in m.make_sentences(10, seed=4).collect()]
    assert all(s and set(s.split()) <= vocabulary for s in got)
    assert got == [r.sentence for r in m.make_sentences(10, seed=4).collect()]


def test_only_path_is_verbatim_and_rejected(spark):
    m = text_model(spark, "This is the only sentence here.")
    assert m.make_sentences(1).first().sentence is None
    assert m.make_sentences(1, limits=Limits(test_output=False)).first().sentence == "This is the only sentence here."


def test_unretained_source_is_not_tested(spark):
    assert text_model(spark, "This is the only sentence here.", retain=False).make_sentences(1).first().sentence is not None


def test_word_and_character_bounds(spark):
    m = text_model(spark, PROSE, retain=False)
    for r in m.make_sentences(20, seed=1, limits=Limits(min_words=4, max_words=4)).collect():
        assert r.sentence is None or len(r.sentence.split()) == 4
    for r in m.make_short_sentences(20, max_chars=14, min_chars=10).collect():
        assert r.sentence is None or 10 <= len(r.sentence) <= 14


def test_characters_are_utf16_units(spark):
    m = text_model(spark, "A \U0001f600", 1, retain=False)
    assert m.make_short_sentences(1, max_chars=3).first().sentence is None
    assert m.make_short_sentences(1, max_chars=4).first().sentence == "A \U0001f600"


def test_starts(spark):
    m = text_model(spark, PROSE, retain=False)
    assert m.make_sentence_with_start("A cat").first().sentence.startswith("A cat")
    assert m.make_sentence_with_start("The").first().sentence.startswith("The ")
    assert m.make_sentence_with_start("saw", strict=False).first().sentence.startswith("saw ")
    assert m.make_sentence_with_start("zebra").first().sentence is None
    for bad in ("", "one two three"):
        with pytest.raises(ValueError):
            m.make_sentence_with_start(bad)


def test_loose_candidates_are_whole_words(spark):
    m = text_model(spark, PROSE)
    states = {tuple(r.state) for r in generate.start_states(m.transitions, 2, ["the"], strict=False).collect()}
    assert states == {("the", "dog."), ("the", "bird."), ("the", "cat.")}


def test_init_words_count_toward_bounds(spark):
    m = text_model(spark, PROSE, retain=False)
    assert m.make_sentences(1, init=["A", "cat"], limits=Limits(max_words=3, tries=3)).first().sentence is None
    assert m.make_sentences(1, init=["A", "cat"], limits=Limits(max_words=4)).first().sentence in ("A cat ran home.", "A cat ran away.")


def test_dead_end_gives_null(spark):
    m = text_model(spark, "a b c", 1, retain=False)
    pruned = MarkovModel(m.transitions.where("follow <> '___END__'"), 1)
    assert pruned.make_sentences(1).first().sentence is None
    assert text_model(spark, PROSE).make_sentences(1, init=["no", "state"]).first().sentence is None


def grams(spark, words, total=15, ratio=0.7):
    return spark.createDataFrame([(words,)], "w array<string>").select(overlap.grams(F.col("w"), total, ratio).alias("g")).first().g


def test_gram_windows(spark):
    assert grams(spark, []) == [""]
    assert grams(spark, ["a"]) == ["a"]
    assert grams(spark, ["a", "b"]) == ["a b"]
    assert grams(spark, list("abcde")) == ["a b c d e"]  # 3.5 rounds away from zero
    assert grams(spark, list("abcd"), total=1) == ["a b", "b c", "c d"]
    assert grams(spark, list("ab"), total=-1) == ["", "", ""]
    with pytest.raises(ValueError):
        grams(spark, ["a"], total=-2)


def test_overlap_is_by_characters_and_crosses_sentences(spark):
    source = spark.createDataFrame([("one two. Three four. ",)], "source string")
    cands = spark.createDataFrame([(0, ["two.", "Three"]), (1, ["wo.", "Thr"]), (2, ["four.", "one"]), (3, ["two.", "three"])], "walk_id int, words array<string>")
    assert {r.walk_id for r in overlap.rejected(cands, source, ["walk_id"]).collect()} == {0, 1}
    nothing = spark.createDataFrame([], "source string")
    assert overlap.rejected(cands, nothing, ["walk_id"]).count() == 0


def test_overlap_scan_equals_contains(spark):
    source = spark.createDataFrame([("abc abd ",), (None,), ("",), ("xyz ",)], "source string")
    g = spark.createDataFrame([(x,) for x in ("bc ab", "z", "", "abx", "d ", "yz x")], "gram string")
    assert {r.gram for r in overlap.found(g, source).collect()} == {"bc ab", "z", "", "d "}


def test_rejoined_source(spark):
    docs = spark.createDataFrame([(i, " ".join(f"Num {i} is {j}." for j in range(30))) for i in range(3)], "doc_id bigint, text string")
    m = MarkovModel.from_text(docs, 2)
    assert all(r.source.endswith("29. ") and r.source.count(". ") == 30 for r in m.source.collect())


def test_zero_tries(spark):
    assert text_model(spark, PROSE).make_sentences(2, limits=Limits(tries=0)).where("sentence is null").count() == 2


def test_queries_over_documents(spark, tmp_path):
    """The corpus is model and source; another table's words do not come in."""
    r = random.Random(3)
    texts = [" ".join(f"{r.choice(['The', 'A'])} {' '.join(r.choice('abcdefgh') for _ in range(r.randrange(3, 9)))} end." for _ in range(4)) + " The the a." for _ in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Other words.")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    runs = [s.split() for t in texts for s in t.replace("end. ", "end.|").replace("a. ", "a.|").split("|")]
    model = collections.defaultdict(collections.Counter)
    for w in runs:
        for a, b in zip(["", *w], [*w, "\0"]):
            model[a][b] += 1

    def walk(walk_id, attempt):
        state, out = "", []
        while True:
            follow = sorted(model[state], key=lambda w: "___END__" if w == "\0" else w)
            sums = list(accumulate(model[state][w] for w in follow))
            u = int(hashlib.md5(f"{queries.SEED}:{walk_id}:{attempt}:{len(out)}".encode()).hexdigest()[:13], 16) / 2**52
            state = follow[bisect.bisect_right(sums, u * sums[-1])]
            if state == "\0":
                return out
            out.append(state)

    def bad(words):
        over = min(15, int(len(words) * 0.7 + 0.5))
        return any(" ".join(words[i : i + over + 1]) in t + " " for i in range(max(len(words) - over, 1)) for t in texts)

    got = {x.walk_id: x.rejected for x in queries.QUERIES["overlap_reject_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: bad(walk(i, 0)) for i in range(queries.WALKS)} and len(set(got.values())) == 2
    tried = {i: [walk(i, a) for a in range(10)] for i in range(50)}
    first = lambda i, ok: next((" ".join(w) for w in tried[i] if ok(w)), None)
    made = lambda name: {x.walk_id: x.sentence for x in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert made("make_sentence_documents") == {i: first(i, lambda w: not bad(w)) for i in range(50)}
    assert made("make_short_mapped_documents") == {i: first(i, lambda w: 30 <= len(" ".join(w)) <= 80) for i in range(50)}
    bounded = {i: [walk(i, a) for a in range(5)] for i in range(50)}
    assert made("make_sentence_bounded_documents") == {i: next((" ".join(w) for w in bounded[i] if 8 <= len(w) <= 16 and not bad(w)), None) for i in range(50)}
    assert made("make_short_sentence_documents") == {i: first(i, lambda w: 20 <= len(" ".join(w)) <= 60 and not bad(w)) for i in range(50)}
    assert made("make_sentence_mapped_documents") == {i: first(i, lambda w: len(w) <= 12) for i in range(50)}
    grams = {(x.walk_id, x.i): x.gram for x in queries.QUERIES["overlap_grams_documents"](spark, str(tmp_path)).collect()}
    over = lambda w: min(15, int(len(w) * 0.7 + 0.5))
    assert grams == {(n, i): " ".join(w[i : i + over(w) + 1]) for n in range(queries.WALKS) for w in [walk(n, 0)] for i in range(max(len(w) - over(w), 1))}
    assert {x.walk_id: x.rejected for x in queries.QUERIES["overlap_positions_documents"](spark, str(tmp_path)).collect()} == got
    rows1 = [([chain.BEGIN if s == "" else s], chain.END if f == "\0" else f, n) for s, fs in model.items() for f, n in fs.items()]
    said = {x.walk_id: (x.sentence, x.status) for x in queries.QUERIES["walk_mapped_documents"](spark, str(tmp_path)).collect()}
    assert said == {i: (" ".join(w), s) for i in range(queries.WALKS) for w, s in [walk_by_force(rows1, 1, queries.TEMPERATURE, queries.SEED, i, 0, None, 1000)]}
    pairs = collections.Counter((tuple(it[i : i + 2]), it[i + 2]) for w in runs for it in [[chain.BEGIN] * 2 + w + [chain.END]] for i in range(len(w) + 1))
    rows2 = [(list(s), f, n) for (s, f), n in pairs.items()]
    tried = lambda i, a, init: walk_by_force(rows2, 2, 1.0, queries.SEED, i, a, init, 1000)
    strict = next((" ".join(["The", *w]) for w, s in (tried(0, a, [chain.BEGIN, "The"]) for a in range(10)) if s == "end"), None)
    assert queries.QUERIES["start_strict_documents"](spark, str(tmp_path)).first().sentence == strict is not None
    order = sorted({s for s, _, _ in map(lambda r: (tuple(r[0]), r[1], r[2]), rows2) if [x for x in s if x != chain.BEGIN][:1] == ["the"]}, key=lambda s: hashlib.md5(f"{queries.SEED}:{' '.join(s)}".encode()).hexdigest())
    loose = None
    for i, state in enumerate(order):
        prefix = [x for x in state if x != chain.BEGIN]
        loose = loose or next((" ".join(prefix + w) for w, s in (tried(i, a, list(state)) for a in range(3)) if s == "end" and len(prefix + w) <= 12), None)
    assert queries.QUERIES["start_loose_documents"](spark, str(tmp_path)).first().sentence == loose is not None
    ranks = {x.state: x.rank for x in queries.QUERIES["start_candidates_documents"](spark, str(tmp_path)).collect()}
    states = sorted({f"the {w[i + 1]}" for w in runs for i in range(len(w) - 1) if w[i] == "the"} | {"___BEGIN__ the" for w in runs if w[0] == "the"}, key=lambda s: hashlib.md5(f"{queries.SEED}:{s}".encode()).hexdigest())
    assert ranks == {s: k for k, s in enumerate(states)}


def test_start_states_are_tried_in_growing_groups(spark, monkeypatch):
    monkeypatch.setattr(generate, "FIRST_STARTS", 1)
    words = [("a", x, "z") if x == "k" else ("a", x, *["y"] * 9) for x in "bcdefghijk"]
    m = MarkovModel.from_sentences(spark.createDataFrame([(["s", *w],) for w in words], "words array<string>"), 2)
    limits = generate.Limits(tries=2, test_output=False, max_words=3)
    assert m.make_sentence_with_start("a", False, 5, limits).collect()[0].sentence == "a k z"
    assert m.make_sentence_with_start("a", False, 5, generate.Limits(tries=1, test_output=False, max_words=1)).collect()[0].sentence is None


def test_table_function_and_parsed_sentences(spark):
    docs = spark.createDataFrame([(1, "One two three. Two three four!"), (2, "One three.")], "doc_id bigint, text string")
    m = MarkovModel.from_text(docs, 1, temperature=1.5)
    m.register("own_walks")
    got = {r.walk_id: (r.words, r.status) for r in spark.sql("select * from own_walks(5, 20, 3)").collect()}
    want = {r.walk_id: (r.words, r.status) for r in m.walk(25, 3).where("walk_id >= 5").collect()}
    assert got == want
    assert sorted((r.doc_id, r.pos, r.words) for r in m.parsed_sentences.collect()) == [(1, 0, ["One", "two", "three."]), (1, 1, ["Two", "three", "four!"]), (2, 0, ["One", "three."])]
    assert MarkovModel.from_text(docs, 1, retain=False).parsed_sentences is None
