"""The registered queries of the engine's own operators, each over its whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.functions import tokenize as T
from tokenweave.operators import algebra, chain, coded, generate, overlap, sampling, stored, travel, walk
from tokenweave.plans.model import MarkovModel
from tokenweave.sources import files, json_model, mapped, tables, zipf
from tokenweave.sources.shared import new_path, written
from tokenweave.streaming import train

#: Sizes that are part of a query: walks, tries and bounds. Their SQL uses the same.
WALKS, SEED, TEMPERATURE = 200, 7, 1.5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir, spread: bool = True) -> DataFrame:
    """doc_id and text, spread over the cores when a small file would be one task."""
    df = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n, "doc_id") if spread and df.rdd.getNumPartitions() < n else df


#: Bytes of text whose windows a task counts before the shuffle: their distinct windows take about 30 times that in memory, and more would be sorted on disk.
PIECE_BYTES = 32 << 20


def training_documents(spark, sf_dir) -> DataFrame:
    """documents, in so many partitions that each has about PIECE_BYTES of text at most."""
    return _in_pieces(spark, sf_dir)[0]


def _in_pieces(spark, sf_dir) -> tuple[DataFrame, int]:
    """training_documents, and the number of their pieces."""
    docs = documents(spark, sf_dir, spread=False)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, has = max(spark.sparkContext.defaultParallelism, -(-size // PIECE_BYTES)), docs.rdd.getNumPartitions()
    return (docs.repartition(n, "doc_id"), n) if has < n else (docs, has)


#: Partitions for each piece where windows move uncounted: as many windows as 8 MB of text has are counted in one.
SHARES = PIECE_BYTES // (8 << 20)


def doc_runs(spark, sf_dir, tok=T.PROSE) -> DataFrame:
    return T.runs(documents(spark, sf_dir), tok)


def model(spark, sf_dir, k: int, tok=T.PROSE, **options) -> DataFrame:
    return chain.train(T.runs(training_documents(spark, sf_dir), tok), k, **options)


def told(spark, sf_dir, k: int) -> sampling.Hot:
    """The hot states of the documents' model, by one in HOT_SAMPLE documents."""
    some = documents(spark, sf_dir).where(F.pmod(F.xxhash64("doc_id"), F.lit(sampling.HOT_SAMPLE)) == 0)
    return sampling.Hot(chain.train(T.runs(some), k, keyed=True), lambda states: chain.train(doc_runs(spark, sf_dir), k, states=states, keyed=True))


def long(*names: str) -> list:
    """Columns as bigint."""
    return [F.col(n).cast("bigint").alias(n) for n in names]


def flat(m: DataFrame, *more: str) -> DataFrame:
    """A model with its states as texts."""
    return m.select(F.array_join("state", " ").alias("state"), "follow", "n", *more)


def benchmark_model(spark, sf_dir, k: int) -> DataFrame:
    return chain.train(T.runs(read(spark, sf_dir, "benchmark"), T.PROSE, "text", ("item_id",)), k)


# ---- tokenizers


def split_sentences(spark, sf_dir):
    return T.units(documents(spark, sf_dir), "text", T.sentence_array, ["doc_id"]).select("doc_id", *long("pos"), F.col("s").alias("sentence"))


def split_lines(spark, sf_dir):
    return T.units(documents(spark, sf_dir), "text", T.line_array, ["doc_id"]).select("doc_id", *long("pos"), F.col("s").alias("line"))


def split_words(spark, sf_dir):
    return doc_runs(spark, sf_dir).select("doc_id", *long("pos"), F.size("words").cast("bigint").alias("n_words"), F.array_join("words", "|").alias("words"))


def split_words_normalized(spark, sf_dir):
    return doc_runs(spark, sf_dir, T.PROSE_NORMALIZED).select("doc_id", *long("pos"), F.size("words").cast("bigint").alias("n_words"), F.array_join("words", "|").alias("words"))


def rejoin_sentences(spark, sf_dir):
    return doc_runs(spark, sf_dir).select("doc_id", *long("pos"), T.PROSE.join(F.col("words")).alias("sentence"))


# ---- training


def transitions_k(k: int, spark, sf_dir):
    out = chain.transitions(doc_runs(spark, sf_dir), k)
    return out.select("doc_id", *long("pos", "i"), F.array_join("state", " ").alias("state"), "follow")


def model_k(k: int, spark, sf_dir):
    return flat(model(spark, sf_dir, k))


def model_normalized_k2(spark, sf_dir):
    return flat(model(spark, sf_dir, 2, T.PROSE_NORMALIZED))


def train_text_k2(spark, sf_dir):
    m = MarkovModel.from_text(read(spark, sf_dir, "benchmark"), 2, key="item_id")
    return flat(m.transitions)


def train_newline_k1(spark, sf_dir):
    chats = read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    return flat(MarkovModel.from_lines(chats, 1).transitions)


def train_from_sentences(spark, sf_dir):
    chats = read(spark, sf_dir, "conversations").where("role = 'user'").select(T.word_array(F.col("text")).alias("words"))
    return flat(MarkovModel.from_sentences(chats, 2).transitions)


def chain_events_k1(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return flat(chain.count(chain.keyed_transitions(rows, 1, "user_id", ["ts", "event_id"], "event_type")))


def chain_orders_k2(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.concat("o_orderstatus", F.lit("/"), F.replace("o_orderpriority", F.lit(" "), F.lit("_"))).alias("token"))
    return flat(chain.count(chain.keyed_transitions(rows, 2, "o_custkey", ["o_orderdate", "o_orderkey"], "token")))


def followers_nested(spark, sf_dir):
    out = chain.nested(model(spark, sf_dir, 2))
    return out.select(F.array_join("state", " ").alias("state"), F.size("followers").cast("bigint").alias("degree"), "total", F.array_join(F.transform("followers", lambda x: F.concat(x["follow"], F.lit("="), x["n"].cast("string"))), ",").alias("followers"))


def follower_lookup(spark, sf_dir):
    return flat(chain.lookup(model(spark, sf_dir, 1), ["the"]))


def state_stats(spark, sf_dir):
    out = model(spark, sf_dir, 2).groupBy("state").agg(F.count(F.lit(1)).alias("degree"), F.sum("n").alias("total"), F.max("n").alias("top"), F.max_by("follow", F.struct("n", "follow")).alias("top_follow"))
    return out.select(F.array_join("state", " ").alias("state"), "degree", "total", "top", "top_follow")


def begin_followers(spark, sf_dir):
    return model(spark, sf_dir, 2).where(F.col("state") == chain.begin_state(2)).select("follow", "n")


def successor_states(spark, sf_dir):
    m = model(spark, sf_dir, 2).where(F.col("follow") != chain.END)
    return m.select(F.array_join("state", " ").alias("state"), F.array_join(chain.shift(F.col("state"), F.col("follow"), 2), " ").alias("successor"), "n")


def state_repr(spark, sf_dir):
    return model(spark, sf_dir, 2).select(chain.state_text(F.col("state")).alias("repr"), F.size("state").cast("bigint").alias("length"), F.get("state", F.lit(0)).alias("first")).distinct()


def model_totals(spark, sf_dir):
    docs, n = _in_pieces(spark, sf_dir)
    return chain.totals_upto(T.runs(docs), 3, n * SHARES)


def vocab_encode(spark, sf_dir):
    return chain.vocabulary_of_runs(doc_runs(spark, sf_dir)).select("word", F.col("word_id").cast("bigint").alias("word_id"))


def model_int_ids(spark, sf_dir):
    m = written(model(spark, sf_dir, 2), "model")
    out = chain.encode(m, chain.vocabulary(m), 2)
    return out.select(F.col("key")[0].alias("id0"), F.col("key")[1].alias("id1"), "follow_id", "n")


def _trained_ids(spark, sf_dir) -> tuple[DataFrame, DataFrame, int, int, int]:
    """The model over word ids as coded.train gives it, its vocabulary, the ids of the sentinels, and the bits of an id."""
    docs, n = _in_pieces(spark, sf_dir)
    rows, vocab, ends = coded.train(T.runs(docs), 2, "doc_id", n * SHARES // 2, n * SHARES)
    return rows, vocab, ends[chain.BEGIN], ends[chain.END], chain.id_bits(vocab.agg(F.max("word_id")).first()[0])


def walk_int_ids(spark, sf_dir):
    """The walks of walk_begin, over word ids."""
    rows, vocab, begin, end, bits = _trained_ids(spark, sf_dir)
    return _worded(walk.coded_walk(walk.requests(spark, WALKS), rows, 2, bits, begin, end, TEMPERATURE, SEED), vocab)


def vocab_by_sight(spark, sf_dir):
    return chain.vocabulary_by_sight(doc_runs(spark, sf_dir))


def followers_by_sight(spark, sf_dir):
    docs, n = _in_pieces(spark, sf_dir)
    out = chain.runs_by_sight(T.runs(docs), 2, n * SHARES, bits=chain.sight_bits(documents(spark, sf_dir, spread=False)))
    return out.select(F.array_join("state", " ").alias("state"), F.array_join(F.transform("followers", lambda x: F.concat(x["follow"], F.lit("="), x["n"].cast("string"))), ",").alias("followers"), "first.doc_id", *[F.col(f"first.{c}").cast("bigint").alias(c) for c in ("pos", "i")])


def _coded(spark, sf_dir) -> tuple[DataFrame, DataFrame, int, int]:
    """The model's encoded form, its vocabulary, and the ids of the sentinels."""
    m = written(model(spark, sf_dir, 2), "model")
    vocab = written(chain.vocabulary(m), "vocabulary")
    ends = {r.word: r.word_id for r in vocab.where(F.col("word").isin(chain.BEGIN, chain.END)).collect()}
    return chain.encode(m, vocab, 2), vocab, ends[chain.BEGIN], ends[chain.END]


def _worded(got: DataFrame, vocab: DataFrame) -> DataFrame:
    """Walks over ids as sentences."""
    words = got.select("walk_id", "status", F.posexplode_outer("words").alias("i", "word_id")).join(vocab, "word_id", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    return words.groupBy("walk_id", "status").agg(text.alias("sentence"), F.count("word").alias("n_words")).select("walk_id", "sentence", "n_words", "status")


def model_packed(spark, sf_dir):
    """The model with its states packed into integers, and the states that follow."""
    enc, vocab, _, _ = _coded(spark, sf_dir)
    bits = chain.id_bits(vocab.agg(F.max("word_id")).first()[0])
    return chain.packed(enc, 2, bits).select("lo", "follow_id", "next_lo", "n")


def walk_csr(spark, sf_dir):
    """The walks of walk_begin, through compressed sparse rows."""
    coded_rows, vocab, begin, end, bits = _trained_ids(spark, sf_dir)
    rows = coded.csr(coded_rows, 2, lambda n: sampling.weight(n, TEMPERATURE), bits, **stored.LOOKED_UP)
    return _worded(walk.csr_walk(walk.requests(spark, WALKS), rows, 2, begin, end, SEED, temperature=TEMPERATURE, bits=bits), vocab)


def csr_rows(spark, sf_dir):
    m = written(model(spark, sf_dir, 2), "model")
    out = chain.csr(chain.encode(m, chain.vocabulary(m), 2))
    return out.select(F.array_join(F.transform("key", lambda x: x.cast("string")), " ").alias("key"), F.col("state_id").cast("bigint").alias("state_id"), F.col("row_start").cast("bigint").alias("row_start"), "degree", F.aggregate("followers", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("total"))


# ---- algebra


def labelled(spark, sf_dir, quality: int, k: int = 2) -> DataFrame:
    some = read(spark, sf_dir, "labels").where(F.col("quality") == quality).select("doc_id").distinct()
    return chain.train(T.runs(read(spark, sf_dir, "documents").select("doc_id", "text").join(some, "doc_id", "left_semi")), k)


def combine_with(weights, spark, sf_dir):
    return flat(algebra.combine([labelled(spark, sf_dir, 1), labelled(spark, sf_dir, 0)], weights))


def combine_sources(spark, sf_dir):
    a = MarkovModel.from_text(read(spark, sf_dir, "benchmark"), 2, key="item_id")
    b = MarkovModel.from_text(documents(spark, sf_dir), 2)
    return MarkovModel.combine([a, b]).source.select("source")


def prune_2(spark, sf_dir):
    return flat(algebra.prune(model(spark, sf_dir, 2), 2))


def prune_removed(spark, sf_dir):
    return algebra.removed(model(spark, sf_dir, 2), 2)


def dangling_after_prune(spark, sf_dir):
    m = written(algebra.prune(model(spark, sf_dir, 2), 2), "pruned")
    succ = m.where(F.col("follow") != chain.END).select(chain.shift(F.col("state"), F.col("follow"), 2).alias("state")).distinct()
    return succ.join(m.select("state").distinct(), "state", "left_anti").select(F.array_join("state", " ").alias("state"))


# ---- sampling


def weights_t1_5(spark, sf_dir):
    m = model(spark, sf_dir, 2)
    return m.select(F.array_join("state", " ").alias("state"), "follow", F.round(sampling.weight(F.col("n"), 1.5), 6).alias("w"))


def cdf_t(t: float, spark, sf_dir):
    out = sampling.cdf(model(spark, sf_dir, 2, keyed=True), t, told(spark, sf_dir, 2))
    return out.select(F.array_join("state", " ").alias("state"), "follow", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), F.round("total", 5).alias("total"))


def move_grid(spark, sf_dir):
    """Every state of the model meets four fixed rolls."""
    return sampling.move_all(model(spark, sf_dir, 2, keyed=True), [0.0, 0.25, 0.5, 0.999], told=told(spark, sf_dir, 2)).select(F.array_join("state", " ").alias("state"), "u", "follow")


def move_missing(spark, sf_dir):
    """States of the benchmark's model in the documents' model: unknown ones give null."""
    rolls = written(benchmark_model(spark, sf_dir, 2).select("state").distinct().withColumn("u", F.lit(0.5)), "rolls")
    met = written(chain.train(doc_runs(spark, sf_dir), 2, states=rolls), "met")
    return sampling.move(rolls, sampling.cdf(met, 1.0), "left").select(F.array_join("state", " ").alias("state"), "follow")


def walk_begin(spark, sf_dir):
    got = walk.walk(walk.requests(spark, WALKS), written(model(spark, sf_dir, 2), "model"), 2, TEMPERATURE, SEED)
    return got.select("walk_id", F.array_join("words", " ").alias("sentence"), F.size("words").cast("bigint").alias("n_words"), "status")


def walk_sql(spark, sf_dir):
    """The walks of walk_mapped, as one recursive query."""
    got = walk.sql_walk(walk.requests(spark, WALKS), benchmark_model(spark, sf_dir, 1), 1, TEMPERATURE, SEED)
    return got.select("walk_id", F.array_join("words", " ").alias("sentence"), "status")


def walk_travel(spark, sf_dir):
    """The walks of walk_begin, through the model in its ranges."""
    got = walk.walk(walk.requests(spark, WALKS), model(spark, sf_dir, 2), 2, TEMPERATURE, SEED, strategy="travel")
    return got.select("walk_id", F.array_join("words", " ").alias("sentence"), F.size("words").cast("bigint").alias("n_words"), "status")


def state_segments(spark, sf_dir):
    """The sampling table in rows of bounded size."""
    out = sampling.segments(model(spark, sf_dir, 1), TEMPERATURE)
    return out.select(F.array_join("state", " ").alias("state"), F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), F.round("total", 5).alias("total"), F.col("degree").cast("bigint").alias("degree"), F.get("follows", F.lit(0)).alias("first_follow"))


def walk_from_state(spark, sf_dir):
    docs, n = _in_pieces(spark, sf_dir)
    table = travel.ranges_of_runs(T.runs(docs), 2, n * SHARES, TEMPERATURE)
    top = stored.heaviest(stored.rows_of(spark, table), 20).select(chain.key_words(F.col("key")).alias("state"), "t").orderBy(F.col("t").desc(), F.array_join("state", " ")).limit(20)
    req = top.select((F.row_number().over(_by_total()) - 1).cast("bigint").alias("walk_id"), F.lit(0).alias("attempt"), F.col("state").alias("init"))
    got = walk.ranged_walk(written(req, "requests"), table, 2, TEMPERATURE, SEED)
    return got.select("walk_id", F.array_join("words", " ").alias("sentence"), "status")


def _by_total():
    from pyspark.sql import Window

    return Window.orderBy(F.col("t").desc(), F.array_join("state", " "))  # of the 20 states at hand


def walk_mapped(spark, sf_dir, of="benchmark"):
    m = MarkovModel.from_text(_texts(spark, sf_dir, of), 1, key=KEYS[of], retain=False, temperature=TEMPERATURE)
    path = new_path(spark, "mapped")
    tables.save(m, path)
    got = tables.walk(spark, path, walk.requests(spark, WALKS), SEED)
    return got.select("walk_id", F.array_join("words", " ").alias("sentence"), "status")


#: The tables that generation can be trained on and tested against, with their ids.
KEYS = {"benchmark": "item_id", "documents": "doc_id"}


def _texts(spark, sf_dir, of: str) -> DataFrame:
    return documents(spark, sf_dir) if of == "documents" else read(spark, sf_dir, of)


def _retained(spark, sf_dir, of: str, k=1) -> MarkovModel:
    m = MarkovModel.from_text(_texts(spark, sf_dir, of), k, key=KEYS[of])
    from dataclasses import replace

    return replace(m, transitions=written(m.transitions, "model"), source=written(m.source, "source"))


def make_sentence(spark, sf_dir, of="benchmark"):
    return _retained(spark, sf_dir, of).make_sentences(50, SEED)


def make_sentence_bounded(spark, sf_dir, of="benchmark"):
    return _retained(spark, sf_dir, of).make_sentences(50, SEED, limits=generate.Limits(tries=5, min_words=8, max_words=16))


def make_short_sentence(spark, sf_dir, of="benchmark"):
    return _retained(spark, sf_dir, of).make_short_sentences(50, max_chars=60, min_chars=20, seed=SEED)


def _from_tables(spark, sf_dir, of: str, limits: generate.Limits) -> DataFrame:
    """Sentences of a model that is saved as tables and not loaded again."""
    path = new_path(spark, "mapped")
    tables.save(MarkovModel.from_text(_texts(spark, sf_dir, of), 1, key=KEYS[of], retain=False), path)
    return tables.make_sentences(spark, path, 50, SEED, limits)


def make_sentence_mapped(spark, sf_dir, of="benchmark"):
    return _from_tables(spark, sf_dir, of, generate.Limits(test_output=False, max_words=12))


def make_short_mapped(spark, sf_dir, of="benchmark"):
    return _from_tables(spark, sf_dir, of, generate.Limits(test_output=False, max_chars=80, min_chars=30))


def start_candidates(spark, sf_dir, of="benchmark"):
    out = generate.start_states(model(spark, sf_dir, 2) if of == "documents" else benchmark_model(spark, sf_dir, 2), 2, ["the"], strict=False, seed=SEED)
    return out.select(F.array_join("state", " ").alias("state"), "rank")


def _unretained(spark, sf_dir, of: str, k: int) -> MarkovModel:
    """For generation whose output is not tested, which needs no source."""
    m = MarkovModel.from_text(_texts(spark, sf_dir, of), k, key=KEYS[of], retain=False)
    from dataclasses import replace

    return replace(m, transitions=written(m.transitions, "model"))


def start_strict(spark, sf_dir, of="benchmark"):
    m = _unretained(spark, sf_dir, of, 2)
    return m.make_sentence_with_start("The", True, SEED, generate.Limits(tries=10, test_output=False))


def start_loose(spark, sf_dir, of="benchmark"):
    m = _unretained(spark, sf_dir, of, 2)
    return m.make_sentence_with_start("the", False, SEED, generate.Limits(tries=3, test_output=False, max_words=12))


def start_candidates_indexed(spark, sf_dir):
    """The loose start states of the corpus' model, from one range of its saved start index."""
    path = new_path(spark, "started")
    tables.save(MarkovModel(model(spark, sf_dir, 2), 2), path)
    return tables.starts(spark, path, ["the"], False, SEED).select(F.array_join("state", " ").alias("state"), "rank")


def start_loose_saved(spark, sf_dir):
    """start_loose, from tables."""
    path = new_path(spark, "started")
    tables.save(MarkovModel.from_text(read(spark, sf_dir, "benchmark"), 2, key="item_id", retain=False), path)
    return tables.make_sentence_with_start(spark, path, ["the"], False, SEED, generate.Limits(tries=3, test_output=False, max_words=12))


def _tried(spark, sf_dir, of: str) -> tuple[MarkovModel, DataFrame]:
    """The model's object, of which nothing is written but the ranges that are walked, and the walks."""
    texts = training_documents(spark, sf_dir) if of == "documents" else _texts(spark, sf_dir, of)
    m = MarkovModel.from_text(texts, 1, key=KEYS[of])
    got = walk.ranged_walk(walk.requests(spark, WALKS), m.transitions, 1, 1.0, SEED)
    return m, written(got, "candidates")


def overlap_grams(spark, sf_dir, of="benchmark"):
    _, got = _tried(spark, sf_dir, of)
    return got.select("walk_id", F.posexplode(overlap.grams(F.col("words"), 15, 0.7)).alias("i", "gram")).select("walk_id", *long("i"), "gram")


def overlap_reject(spark, sf_dir, of="benchmark"):
    """Which candidates overlap the source."""
    m, got = _tried(spark, sf_dir, of)
    bad = overlap.rejected(got, written(m.source, "source"), ["walk_id"])
    return got.select("walk_id").join(bad.withColumn("rejected", F.lit(True)), "walk_id", "left").select("walk_id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def overlap_positions(spark, sf_dir):
    """overlap_reject, by positions of rare words instead of scans."""
    m, got = _tried(spark, sf_dir, "benchmark")
    bad = overlap.rejected_by_positions(got, overlap.positions(m.parsed_sentences, "item_id"), ["walk_id"])
    return got.select("walk_id").join(bad.withColumn("rejected", F.lit(True)), "walk_id", "left").select("walk_id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def overlap_positions_documents(spark, sf_dir):
    """The same over the corpus, as model and as source; equal to overlap_reject_documents, which scans."""
    _, got = _tried(spark, sf_dir, "documents")
    bad = overlap.rejected_by_positions(got, written(T.texts(documents(spark, sf_dir)), "texts"), ["walk_id"])
    return got.select("walk_id").join(bad.withColumn("rejected", F.lit(True)), "walk_id", "left").select("walk_id", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def source_chunks(spark, sf_dir):
    """The corpus' rejoined text, cut into chunks that carry over what a gram may need."""
    out = overlap.chunks(doc_runs(spark, sf_dir), 100_000, 1000)
    return out.select("chunk", F.length("source").cast("bigint").alias("n_chars"), F.md5("source").alias("digest"))


def source_rejoined(spark, sf_dir):
    return overlap.rejoined(doc_runs(spark, sf_dir))


# ---- persistence


def json_roundtrip(spark, sf_dir):
    return flat(json_model.from_rows(json_model.to_rows(model(spark, sf_dir, 2))))


def json_model_meta(spark, sf_dir):
    doc = json_model.model_json(MarkovModel(benchmark_model(spark, sf_dir, 2), 2, 1.5))
    rows = json_model.parse_json(doc)
    return rows.groupBy("state_size", "temperature").agg(F.sum("n").alias("n_transitions"), F.count(F.lit(1)).alias("n_pairs"))


def mapped_state_lookup(spark, sf_dir):
    path = new_path(spark, "model-table")
    tables.save(MarkovModel(model(spark, sf_dir, 2), 2), path)
    return flat(tables.lookup(spark, path, [chain.BEGIN, "The"]))


def _blob(spark, m: DataFrame, mapped: bool) -> DataFrame:
    enc = files.encode_mapped if mapped else files.encode_stream
    return spark.createDataFrame([(bytearray(enc(files.states_of(m), 2, 1.5)),)], "content binary")


def binary_roundtrip(spark, sf_dir):
    return flat(files.transitions_of(_blob(spark, benchmark_model(spark, sf_dir, 2), False)))


def mapped_roundtrip(spark, sf_dir):
    return flat(files.transitions_of(_blob(spark, benchmark_model(spark, sf_dir, 2), True)))


def mapped_file_documents(spark, sf_dir):
    """The corpus' model through the random-access file, written and read by many tasks."""
    path = new_path(spark, "mapped-file")
    docs, n = _in_pieces(spark, sf_dir)
    mapped.save_runs(T.runs(docs), 2, path, "doc_id", n * SHARES // 2, n * SHARES, TEMPERATURE)
    return flat(mapped.transitions(spark, path, 20_000))


# ---- streams and synthetic data


def stream_equals_batch(spark, sf_dir):
    """The model of a stream over the conversations, whose batches are entered once each; its SQL is the batch model."""
    path = f"{sf_dir}/conversations.parquet"
    batch = spark.read.parquet(path)
    # A stream reads folders; a single file is matched by its own name.
    src = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 8).parquet(path if len(batch.inputFiles()) > 1 else path.rsplit("/", 1)[0] + "/conversations.parque[t]")
    out = new_path(spark, "trained")
    train.train_durably(src.select("text"), out, 1, new_path(spark, "stream")).awaitTermination()
    return flat(train.Trained(spark, out).model())


def zipf_corpus(spark, sf_dir):
    return zipf.corpus(spark, 2000, 500, 6, 16, 42).select("run", *long("pos"), "word")


QUERIES = {f.__name__: f for f in (
    split_sentences, split_lines, split_words, split_words_normalized, rejoin_sentences, model_normalized_k2, train_text_k2, train_newline_k1, train_from_sentences,
    chain_events_k1, chain_orders_k2, followers_nested, follower_lookup, state_stats, begin_followers, successor_states, state_repr, model_totals, vocab_encode,
    model_int_ids, walk_int_ids, csr_rows, model_packed, walk_csr, walk_travel, walk_sql, vocab_by_sight, followers_by_sight, state_segments, start_candidates_indexed, start_loose_saved, overlap_positions, overlap_positions_documents, source_chunks, combine_sources, prune_2, prune_removed, dangling_after_prune, weights_t1_5, move_grid, move_missing, walk_begin, walk_from_state, walk_mapped,
    make_sentence, make_sentence_bounded, make_short_sentence, make_sentence_mapped, make_short_mapped, start_candidates, start_strict, start_loose, overlap_grams,
    overlap_reject, source_rejoined, json_roundtrip, json_model_meta, mapped_state_lookup, binary_roundtrip, mapped_roundtrip, mapped_file_documents, stream_equals_batch, zipf_corpus,
)}
QUERIES |= {f"transitions_k{k}": partial(transitions_k, k) for k in (1, 2, 3)} | {f"model_k{k}": partial(model_k, k) for k in (1, 2, 3)}
QUERIES |= {"combine_default": partial(combine_with, None), "combine_weighted": partial(combine_with, [1.0, 2.0]), "combine_fractional": partial(combine_with, [0.5, 1.5])}
QUERIES |= {"cdf_t1": partial(cdf_t, 1.0), "cdf_t0_5": partial(cdf_t, 0.5), "cdf_t2": partial(cdf_t, 2.0)}
#: The same over the corpus, as model and as source; without SQL.
CORPUS = (walk_mapped, make_sentence, make_sentence_bounded, make_short_sentence, make_sentence_mapped, make_short_mapped, start_candidates, start_strict, start_loose, overlap_grams, overlap_reject)
QUERIES |= {f"{f.__name__}_documents": partial(f, of="documents") for f in CORPUS}
