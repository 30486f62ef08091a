"""Followers in the order of sight, with one shuffle."""

from pyspark.sql import functions as F

from tokenweave.operators import chain
from tokenweave.plans import queries
from tests.test_growth import TEXTS, docs_of
from tests.test_totals_upto import ODD


def test_windows_move_once_to_their_state(spark, tmp_path):
    """windows moved, and then the states with all their followers; places were sorted, not hashed."""
    runs = spark.createDataFrame([(d, p, w) for d in (3, 1, 1 << 40, 0) for p, w in enumerate(ODD)], "doc_id bigint, pos int, words array<string>")
    for k in (1, 2, 3):
        want = sorted(map(str, chain.followers_by_sight(chain.train(runs, k, first=("doc_id", "pos"))).collect()))
        assert len(want) > 4
        for bits in (None, (11, 11)):
            got = chain.runs_by_sight(runs, k, 3, bits=bits)
            assert sorted(map(str, got.collect())) == want
    docs_of(spark).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.followers_by_sight(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key#" in plan and "SortAggregate" not in plan


def test_places_that_fit_into_an_integer(spark):
    docs = docs_of(spark, TEXTS)
    each = max(len(t.encode()) for t in TEXTS if t).bit_length()
    assert chain.sight_bits(docs) == (each, each)
    assert chain.sight_bits(docs.withColumn("doc_id", F.col("doc_id") - 1)) is None
    assert chain.sight_bits(docs.withColumn("doc_id", F.col("doc_id").cast("string"))) is None
    assert chain.sight_bits(docs.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))) is None
    assert chain.sight_bits(docs.withColumn("doc_id", F.col("doc_id") + (1 << 60))) is None
    assert chain.sight_bits(docs.limit(0)) == (0, 0)
