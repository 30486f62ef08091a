"""Models that are trained on word ids, and walked where they are written."""

import random

import pytest
from pyspark.sql import functions as F

from tokenweave.functions import tokenize as T
from tokenweave.operators import chain, coded, sampling, stored, walk
from tokenweave.plans import queries
from tests.test_growth import TEXTS, docs_of
from tests.test_totals_upto import ODD


def runs_of(spark):
    r = random.Random(5)
    runs = [w for w in ODD if w] + [[f"w{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(1, 9))] for _ in range(300)]
    return spark.createDataFrame([(i % 11, w) for i, w in enumerate(runs)], "doc_id bigint, words array<string>")


@pytest.mark.parametrize("k", [1, 2, 3])
def test_models_of_ids_are_the_models_of_words(spark, k):
    """each transition met the vocabulary in k + 1 joins."""
    runs = runs_of(spark)
    model = chain.train(runs, k)
    rows, vocab, ends = coded.train(runs, k, "doc_id", 5, 4)
    want = sorted(map(str, chain.encode(model, chain.vocabulary(model), k).collect()))
    assert sorted(map(str, rows.select(coded.key_of(k).alias("key"), "follow_id", "n").collect())) == want
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, chain.vocabulary(model).collect()))
    assert ends == {r.word: r.word_id for r in vocab.collect() if r.word in (chain.BEGIN, chain.END)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(i0" not in plan


def test_counts_of_long_keys():
    import numpy as np

    r = np.random.default_rng(1)
    columns = [r.integers(0, 3, 200).astype(np.int32) for _ in range(3)]
    short, long = coded.counted(columns, 2), coded.counted(columns, 31)
    assert all((a == b).all() for a, b in zip((*short[0], short[1]), (*long[0], long[1]))) and short[1].sum() == 200


def test_sparse_rows_are_walked_where_they_are_written(spark, monkeypatch):
    """rows that were too large for a broadcast were taken apart and written as another model, in texts of ids."""
    runs = runs_of(spark)
    model = chain.train(runs, 2)
    rows, vocab, ends = coded.train(runs, 2, "doc_id", 5, 6)
    bits = chain.id_bits(vocab.agg(F.max("word_id")).first()[0])
    csr = coded.csr(rows, 2, lambda n: sampling.weight(n, 1.5), bits, **stored.LOOKED_UP)
    want = chain.csr(chain.encode(model, vocab, 2), lambda n: sampling.weight(n, 1.5))
    assert sorted(map(str, csr.drop("one").collect())) == sorted(map(str, want.select(*csr.drop("one").columns).collect()))
    assert csr._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(i0") == 0
    asked = walk.requests(spark, 80)
    got = lambda df: {r.walk_id: (r.words, r.status) for r in df.collect()}
    rounds = got(walk.csr_walk(asked, csr, 2, ends[chain.BEGIN], ends[chain.END], 7, temperature=1.5, bits=bits))
    monkeypatch.setattr(walk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(walk, "id_walk", lambda *a, **b: pytest.fail("another model was written"))
    assert got(walk.csr_walk(asked, csr, 2, ends[chain.BEGIN], ends[chain.END], 7, temperature=1.5, bits=bits)) == rounds
    assert got(walk.coded_walk(asked, rows, 2, bits, ends[chain.BEGIN], ends[chain.END], 1.5, 7)) == rounds
    ids = {r.word: r.word_id for r in vocab.collect()}
    words = got(walk.walk(asked, model, 2, 1.5, 7))
    assert {w: ([ids[x] for x in s], status) for w, (s, status) in words.items()} == rounds


def test_queries_of_ids_are_walk_begin(spark, tmp_path, monkeypatch):
    docs_of(spark, TEXTS * 3).withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    got = lambda q: sorted(tuple(r) for r in q(spark, str(tmp_path)).collect())
    want = got(queries.walk_begin)
    for size in (walk.BROADCAST_BYTES, 0):
        monkeypatch.setattr(walk, "BROADCAST_BYTES", size)
        assert got(queries.walk_int_ids) == got(queries.walk_csr) == want
