"""Streams whose batches count once, order of first sight, and walks in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tokenweave.functions import tokenize as T
from tokenweave.operators import chain, walk
from tokenweave.streaming import train


def as_rows(df):
    return sorted((tuple(r.state), r.follow, r.n) for r in df.collect())


@pytest.fixture
def texts(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(f"{r.choice(['Red', 'Blue'])} {r.choice('abc')} {r.choice('xyz')}." for _ in range(3))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream, as_rows(chain.count(chain.transitions(T.runs(df).select("words"), 1))), tmp_path


@pytest.mark.parametrize("compact", [0, 2])
def test_durable_training_equals_batch(spark, texts, compact):
    stream, want, folder = texts
    path, mark = str(folder / "model"), str(folder / "mark")
    train.train_durably(stream, path, 1, mark, compact_every=compact).awaitTermination()
    to = train.Trained(spark, path)
    assert as_rows(to.model()) == want
    assert to.ledger() == ((-1, [0, 1, 2, 3, 4]) if not compact else (3, [4]))
    train.train_durably(stream, path, 1, mark, compact_every=compact).awaitTermination()  # nothing new
    assert as_rows(to.model()) == want
    to.compact()
    assert to.ledger() == (4, []) and as_rows(to.model()) == want
    to.compact()
    assert as_rows(to.model()) == want


@pytest.mark.parametrize("after_entry", [False, True])
def test_a_restart_between_write_and_commit_adds_nothing(spark, texts, monkeypatch, after_entry):
    stream, want, folder = texts
    path, mark = str(folder / "model"), str(folder / "mark")
    enter, broken = train.Trained.enter, []

    def fails(self, batch, base):
        if batch == 2 and not broken:
            broken.append(batch)
            if after_entry:
                enter(self, batch, base)
            raise RuntimeError("lost")
        enter(self, batch, base)

    monkeypatch.setattr(train.Trained, "enter", fails)
    with pytest.raises(Exception, match="lost"):
        train.train_durably(stream, path, 1, mark).awaitTermination()
    assert broken == [2] and as_rows(train.Trained(spark, path).model()) != want
    train.train_durably(stream, path, 1, mark).awaitTermination()
    assert as_rows(train.Trained(spark, path).model()) == want


def test_a_replayed_batch_is_left_out(spark, tmp_path):
    to = train.Trained(spark, str(tmp_path / "m"))
    assert to.model().count() == 0 and to.ledger() == (-1, [])
    to.compact()
    counts = spark.createDataFrame([(["a"], "b", 2)], train.MODEL)
    for batch in (0, 0, 1, 0):
        to.add(counts, batch)
    assert as_rows(to.model()) == [(("a",), "b", 4)]
    to.compact()
    to.add(counts, 1)
    assert as_rows(to.model()) == [(("a",), "b", 4)] and to.ledger() == (1, [])


def test_order_of_first_sight(spark):
    r = random.Random(3)
    runs = [(d, p, [r.choice([chain.END, *"zyxwvuéa"]) for _ in range(r.randrange(1, 7))]) for d in range(9) for p in range(r.randrange(3))]
    df = spark.createDataFrame(runs, "doc_id bigint, pos int, words array<string>").repartition(4)
    ids = {chain.BEGIN: 0, chain.END: 1}
    model = {}
    for _, _, words in sorted(runs):
        items = [chain.BEGIN, *words, chain.END]
        for w in words:
            ids.setdefault(w, len(ids))
        for a, b in zip(items, items[1:]):
            of = model.setdefault((a,), {})
            of[b] = of.get(b, 0) + 1
    assert {x.word: x.word_id for x in chain.vocabulary_by_sight(df).collect()} == ids
    got = chain.followers_by_sight(chain.count_first(chain.transitions(df, 1))).orderBy("first").collect()
    assert [(tuple(x.state), [(f.follow, f.n) for f in x.followers]) for x in got] == [(s, list(of.items())) for s, of in model.items()]


def test_walks_in_sql(spark):
    r = random.Random(4)
    runs = spark.createDataFrame([([r.choice("abcd") for _ in range(r.randrange(1, 5))],) for _ in range(30)], "words array<string>")
    model = chain.count(chain.transitions(runs, 2)).where("n > 1 or follow = 'a'")
    req = walk.requests(spark, 12).unionAll(spark.createDataFrame([(50, 0, ["a", "b"]), (51, 0, ["no", "no"])], "walk_id bigint, attempt int, init array<string>"))
    rows = lambda df: {x.walk_id: (x.words, x.status) for x in df.collect()}
    for steps in (2, 30):
        assert rows(walk.sql_walk(req, model, 2, 1.5, 6, steps)) == rows(walk.walk(req, model, 2, 1.5, 6, steps))
