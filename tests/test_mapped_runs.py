"""The random-access file of a corpus, made of word ids."""

from pyspark.sql import functions as F

from tokenweave.operators import chain, coded
from tokenweave.plans import queries
from tokenweave.plans.model import MarkovModel
from tokenweave.sources import mapped
from tests.test_coded import runs_of
from tests.test_growth import TEXTS, docs_of, names_written


def test_a_file_of_runs_is_that_of_their_model(spark, tmp_path, monkeypatch):
    """the model was written in words, and each transition met the vocabulary three times."""
    runs = runs_of(spark).unionByName(spark.createDataFrame([(77, ["￮", "\U0001f600", "é", "z"])], "doc_id bigint, words array<string>"))
    for k in (1, 2):
        model = chain.train(runs, k)
        a, b = str(tmp_path / f"a{k}"), str(tmp_path / f"b{k}")
        assert mapped.save(MarkovModel(model, k, 1.5), a) == mapped.save_runs(runs, k, b, "doc_id", 5, 4, 1.5)
        assert open(a, "rb").read() == open(b, "rb").read()
        for states in (3, 10_000):
            assert sorted(map(str, mapped.transitions(spark, b, states).collect())) == sorted(map(str, model.select("state", "follow", "n").collect()))
    docs_of(spark, TEXTS * 3).withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "documents.parquet"))
    names = names_written(monkeypatch, chain, coded, mapped)
    assert queries.mapped_file_documents(spark, str(tmp_path)).count() > 30
    assert "model" not in names
