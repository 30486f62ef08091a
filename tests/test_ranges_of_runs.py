"""Models that are counted in the ranges where they are walked."""

from pyspark.sql import functions as F

from tokenweave.operators import chain, stored, travel, walk
from tokenweave.plans import queries
from tests.test_growth import TEXTS, docs_of, names_written
from tests.test_totals_upto import ODD, runs_of


def test_heaviest_states_from_files_without_moving_them(spark, tmp_path, monkeypatch):
    """the model was written twice, and all its states moved for the greatest twenty."""
    runs = runs_of(spark, [[f"w{i % 7}", f"w{i % 5}", f"w{i % 3}"] for i in range(300)] + ODD)
    model = chain.train(runs, 2)
    want = {tuple(r.state): r.t for r in model.groupBy("state").agg(F.sum("n").alias("t")).collect() if chain.BEGIN not in r.state}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for size in (3, 10, 1000):
            path = str(tmp_path / f"ranges-{size}")
            stored.write_sorted(model.select(chain.state_key(F.col("state")).alias("key"), "follow", "n"), path, 3, size)
            rows = stored.rows_of(spark, stored.Stored(stored.files_of(spark.read.parquet(path)), 2))
            got = {tuple(r.state): r.t for r in stored.heaviest(rows, 5).select(chain.key_words(F.col("key")).alias("state"), "t").collect()}
            assert got.items() <= want.items()
            assert sorted(got.values())[-5:] == sorted(want.values())[-5:]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs_of(spark, TEXTS * 3).withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    names = names_written(monkeypatch, queries)
    assert queries.walk_from_state(spark, str(tmp_path)).count() == 16
    assert "model" not in names


def test_ranges_of_runs_are_those_of_the_model(spark):
    """windows move once; a state whose rows lie in several ranges is walked all the same."""
    runs = runs_of(spark, ODD + [[f"x{i:03}", "y"] for i in range(200)])
    model, table = chain.train(runs, 2), travel.ranges_of_runs(runs, 2, 9, 1.5)
    got = stored.rows_of(spark, table).select(chain.key_words(F.col("key")).alias("state"), "follow", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, model.select("state", "follow", "n").collect()))
    asked = walk.requests(spark, 60)
    want = {r.walk_id: (r.words, r.status) for r in walk.walk(asked, model, 2, 1.5, 7).collect()}
    assert {r.walk_id: (r.words, r.status) for r in walk.travel_walk(asked, table, 2, 1.5, 7, 1000).collect()} == want
    assert {r.walk_id: (r.words, r.status) for r in walk.ranged_walk(asked, table, 2, 1.5, 7).collect()} == want
