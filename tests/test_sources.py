import random
import struct

import pytest

from tokenweave import MarkovModel
from tokenweave.operators import chain
from tokenweave.sources import files, json_model, tables, zipf
from tokenweave.streaming import train


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(1, "The fox ran. The fox sat été \U0001f600. A \"dog\" ran."), (2, None)], "doc_id bigint, text string")
    return MarkovModel.from_text(docs, 2, temperature=1.5)


def rows(df):
    return sorted((tuple(r.state), r.follow, r.n) for r in df.collect())


def test_json_document(model, spark, tmp_path):
    json_model.save(model, str(tmp_path / "m"))
    back = json_model.load(spark, str(tmp_path / "m"))
    assert rows(back.transitions) == rows(model.transitions) and (back.state_size, back.temperature) == (2, 1.5)
    json_model.save(model, str(tmp_path / "m"))  # overwrites


def test_json_lines(model, spark, tmp_path):
    json_model.save_rows(model, str(tmp_path / "l"))
    back = json_model.load_rows(spark, str(tmp_path / "l"))
    assert rows(back.transitions) == rows(model.transitions) and (back.state_size, back.temperature) == (2, 1.5)


def test_json_without_temperature_and_empty_chain(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"state_size": 9, "chain": [[["x"], {"y": 2}]]}')
    m = json_model.load(spark, str(tmp_path / "a.json"))
    assert (m.state_size, m.temperature, rows(m.transitions)) == (1, 1.0, [(("x",), "y", 2)])
    (tmp_path / "b.json").write_text('{"state_size": 2, "chain": []}')
    with pytest.raises(ValueError):
        json_model.load(spark, str(tmp_path / "b.json"))


@pytest.mark.parametrize("mapped", [False, True])
def test_binary_files(model, spark, tmp_path, mapped):
    path = str(tmp_path / "m.bin")
    files.save(model, path, mapped)
    back = files.load(spark, path)
    assert rows(back.transitions) == rows(model.transitions) and (back.state_size, back.temperature) == (2, 1.5)
    files.register(spark)
    assert rows(spark.read.format("tokenweave_model").load(path)) == rows(model.transitions)


def test_empty_chain_is_legal_in_binary():
    k, t, got = files.decode_stream(files.encode_stream([], 3, 0.5))
    assert (k, t, list(got)) == (3, 0.5, [])


def test_corrupt_files():
    for raw in (b"\0" * 128, b"abcde", b""):
        with pytest.raises(ValueError):
            files.decode_stream(raw)
        with pytest.raises(ValueError):
            files.MappedFile(raw)
    with pytest.raises(ValueError):
        files.decode_stream(files.STREAM_MAGIC + b"\x07" + b"\0" * 20)
    with pytest.raises(ValueError):
        files.MappedFile(files.MAPPED_MAGIC + struct.pack("<i", 9) + b"\0" * 80)


def test_mapped_lookup(model):
    m = files.MappedFile(files.encode_mapped(files.states_of(model.transitions), 2, 1.5))
    assert m.lookup([chain.BEGIN, "The"]) == [("fox", 2)]
    assert m.lookup(["no", "state"]) is None and m.lookup([chain.BEGIN, "ran."]) is None
    assert m.word(m.word_id("\U0001f600.")) == "\U0001f600."


def test_varints():
    import io

    for n in (0, 1, 127, 128, 300, 2**31 - 1):
        assert files.read_varint(io.BytesIO(files.varint(n))) == n


def test_tables(model, spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save(model, path, 3)
    back = tables.load(spark, path, with_source=True)
    assert rows(back.transitions) == rows(model.transitions) and (back.state_size, back.temperature, back.source.count()) == (2, 1.5, 1)
    assert rows(tables.lookup(spark, path, [chain.BEGIN, "The"])) == [((chain.BEGIN, "The"), "fox", 2)]
    assert [r.words for r in back.walk(5, 3).orderBy("walk_id").collect()] == [r.words for r in model.walk(5, 3).orderBy("walk_id").collect()]


def test_zipf(spark):
    got = zipf.corpus(spark, 300, 50, 6, 16)
    n = got.groupBy("run").count().agg({"count": "min", "run": "count"}).first()
    assert n["min(count)"] >= 6 and n["count(run)"] == 300
    top = got.groupBy("word").count().orderBy("count", ascending=False).first()
    assert top.word == "w0"
    with pytest.raises(ValueError):
        zipf.corpus(spark, 1, 0, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Run {i % 3} goes on. Run again {i}!") for i in range(12)], "doc_id bigint, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = train.stream_counts(src, 2).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert rows(spark.table("counts")) == rows(MarkovModel.from_text(docs, 2).transitions)


def test_merge_of_batches(spark):
    df = [spark.createDataFrame([(s.split(),)], "words array<string>") for s in ("a b", "a c")]
    merged = train.merge_batch(train.merge_batch(None, train.sentence_counts(df[0], 1)), train.sentence_counts(df[1], 1))
    assert rows(merged) == rows(train.sentence_counts(df[0].union(df[1]), 1))


def test_json_elements_are_told_apart_by_their_strings(spark):
    rows = [(["a],{", "b"], "x", 1), (["\\", '"],{"'], '"}', 2), (["[", "]"], "[]{}", 3), (["", "\n\u2028"], ",{", 4), (["é😀\\\"", "{"], "y", 5)]
    df = spark.createDataFrame(rows, "state array<string>, follow string, n bigint")
    back = json_model.from_rows(json_model.to_rows(df))
    assert sorted((r.state, r.follow, r.n) for r in back.collect()) == sorted(rows)
    loose = spark.createDataFrame([(' [ [ "p" , "q]" ] , { "r" : 7 , "s" : 8 } ] ',)], "json string")
    assert sorted((r.state, r.follow, r.n) for r in json_model.from_rows(loose).collect()) == [(["p", "q]"], "r", 7), (["p", "q]"], "s", 8)]


def test_mapped_file_in_parallel_is_byte_equal(spark, tmp_path):
    from tokenweave.sources import mapped

    r = random.Random(9)
    words = ["a", "b c", "é", "\uffee", "😀", "zz", "", "\ue000x"]
    runs = [([r.choice(words) for _ in range(r.randrange(0, 9))],) for _ in range(300)]
    m = MarkovModel.from_sentences(spark.createDataFrame(runs, "words array<string>").repartition(5), 2, temperature=1.5)
    path = str(tmp_path / "m.bin")
    size = mapped.save(m, "file://" + path)
    raw = open(path, "rb").read()
    assert len(raw) == size and raw == files.encode_mapped(files.states_of(m.transitions), 2, 1.5)
    want = sorted((x.state, x.follow, x.n) for x in m.transitions.collect())
    for states in (7, 10_000):
        back = mapped.load(spark, path, states)
        assert (back.state_size, back.temperature) == (2, 1.5)
        assert sorted((x.state, x.follow, x.n) for x in back.transitions.collect()) == want
    assert back.transitions.rdd.getNumPartitions() == 1 and mapped.load(spark, path, 7).transitions.rdd.getNumPartitions() > 5
    mapped.save(MarkovModel(m.transitions.limit(0), 3), path)
    assert open(path, "rb").read() == files.encode_mapped([], 3, 1.0) and mapped.load(spark, path).transitions.count() == 0
    with pytest.raises(ValueError):
        mapped.save(m, "s3://bucket/x")
