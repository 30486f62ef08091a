"""Totals of several orders with one shuffle of windows."""

from tokenweave.operators import chain
from tokenweave.plans import queries
from tests.test_growth import docs_of

ODD = [["a", "b", "a"], ["a b", "\\", "b"], [chain.END, "a"], [chain.BEGIN, chain.BEGIN, "a"], ["a", chain.END], ["b"], ["a", "b", "a"], ["a", "b\\s", "a b"], None]


def runs_of(spark, runs):
    return spark.createDataFrame([(w,) for w in runs], "words array<string>")


def test_totals_of_all_orders_with_one_shuffle_of_windows(spark, tmp_path):
    """three models were counted, and their states again; words that equal sentinels are no states or pairs more."""
    runs = runs_of(spark, ODD)
    for k in (1, 2, 3, 4):
        got = sorted(tuple(r) for r in chain.totals_upto(runs, k, 3).collect())
        assert got == [(j, *chain.totals(chain.train(runs, j)).first()) for j in range(1, k + 1)]
    assert [tuple(r) for r in chain.totals_upto(runs.limit(0), 2, 3).collect()] == [(1, 0, 0, None), (2, 0, 0, None)]
    docs_of(spark).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.model_totals(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("arrays_zip") == 1
