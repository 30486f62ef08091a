import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are absent")


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["state", "follow", "n"]


@needs_data
@pytest.mark.parametrize("name", ["split_sentences", "model_k2", "combine_fractional", "walk_begin", "make_sentence", "start_loose", "overlap_reject", "model_int_ids", "walk_int_ids", "csr_rows", "walk_mapped", "make_sentence_mapped", "make_short_mapped", "stream_equals_batch"])
def test_query_equals_sql(spark, name):
    import __spark_entry__ as e

    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "events", "orders"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(e.oracle_sql()[name])
    cols = sorted(want.columns)
    got = e.queries()[name](spark, SF).select(*cols).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))
