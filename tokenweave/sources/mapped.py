"""The random-access model file, written and read by many tasks.

Every record's place follows from ranks and running sums: words by their rank, states by theirs, followers by the sum of the degrees
before. So each task writes its own byte ranges into the one file and reads its own range of records, and only sizes pass through the
driver. A task that runs again writes the same bytes at the same places. The file must be in a folder that the driver and all executors
have under one path.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokenweave.operators import chain, coded
from tokenweave.plans.model import MarkovModel
from tokenweave.sources.files import HEADER_BYTES, MAPPED_HEADER, MAPPED_MAGIC, MAPPED_VERSION, MappedFile
from tokenweave.sources.shared import running_sums, written

#: States that a task reads.
READ_STATES = 50_000


def local(path: str) -> str:
    """The path as the operating system has it."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a random-access file needs a folder that driver and executors share, by a file path")
    return path.removeprefix("file://")


def _put(path: str, places: list[tuple[int, bytes]]) -> int:
    with open(path, "r+b") as f:
        for at, raw in places:
            f.seek(at)
            f.write(raw)
    return sum(len(raw) for _, raw in places)


def _follow_on(batches):
    """The batches in pieces whose records (column 0: rank) follow one another; a batch may go on in another range."""
    for b in batches:
        cut = [0, *(np.flatnonzero(np.diff(np.asarray(b.column(0))) != 1) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, z - x) for x, z in zip(cut, cut[1:]) if z > x)


def save(model: MarkovModel, path: str) -> int:
    """Write the file; the number of its bytes. Words are numbered in order of their UTF-16 units, states in order of their numbers."""
    path, k = local(path), model.state_size
    m = written(model.transitions.select("state", "follow", F.col("n").cast("bigint").alias("n")), "model")
    words = _places(m.select(F.explode(F.array_append("state", F.col("follow"))).alias("word")).distinct())
    return _save(words, chain.csr(chain.encode(m, words.select("word", "word_id"), k)), k, model.temperature, path)


def save_runs(runs: DataFrame, k: int, path: str, key: str, pieces: int, parts: int, temperature: float = 1.0) -> int:
    """save of the model of runs (key, words; with words), which is trained on the words' numbers (coded.train): a transition moves once and meets no vocabulary."""
    path = local(path)
    rows, words, _ = coded.train(runs, k, key, pieces, parts, _places)
    return _save(words, coded.csr(rows, k), k, temperature, path)


def _places(words: DataFrame) -> DataFrame:
    """(word, size, one, start, rank, word_id) of distinct words: their numbers, and where their bytes begin."""
    words = words.withColumn("o", F.encode("word", "UTF-16BE")).withColumn("size", F.octet_length("word").cast("bigint"))
    places = running_sums(words.withColumn("one", F.lit(1)), ["o"], {"size": "start", "one": "rank"}, "word-places")
    return places.drop("o").withColumn("word_id", F.col("rank"))


def _save(words: DataFrame, rows: DataFrame, k: int, temperature: float, path: str) -> int:
    n_words, data = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_states, n_followers = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
    record = 4 * k + 12
    at_data = HEADER_BYTES + 8 * (n_words + 1)
    at_states = at_data + data
    at_followers = at_states + n_states * record
    size = at_followers + 8 * n_followers
    header = MAPPED_HEADER.pack(MAPPED_MAGIC, MAPPED_VERSION, k, float(temperature), n_states, record, n_words, HEADER_BYTES, at_data, at_states, at_followers)
    with open(path, "wb") as f:
        f.truncate(size)
    _put(path, [(0, header), (at_data - 8, struct.pack("<q", data))])

    def put_words(batches):
        for b in _follow_on(batches):
            rank, start = np.asarray(b.column(0)), np.asarray(b.column(1))
            raw = b"".join(w.encode() for w in b.column(2).to_pylist())
            yield _written(_put(path, [(HEADER_BYTES + 8 * int(rank[0]), start.astype("<i8").tobytes()), (at_data + int(start[0]), raw)]))

    def put_states(batches):
        for b in _follow_on(batches):
            rank, start, degree = (np.asarray(b.column(i)) for i in (0, 1, 2))
            out = np.zeros(len(rank), _shape(k))
            out["key"], out["start"], out["count"] = np.asarray(b.column(3).flatten()).reshape(-1, k), start, degree
            each = b.column(4).flatten()
            pairs = np.stack([np.asarray(each.field(0)), np.asarray(each.field(1))], 1).astype("<i4")
            yield _written(_put(path, [(at_states + record * int(rank[0]), out.tobytes()), (at_followers + 8 * int(start[0]), pairs.tobytes())]))

    # Both are tables in ranges of their ranks already (running_sums), so nothing moves.
    done = words.select("rank", "start", "word").mapInArrow(put_words, "n bigint")
    done = done.unionAll(rows.select("state_id", "row_start", "degree", "key", "followers").mapInArrow(put_states, "n bigint"))
    put = done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if put != size - HEADER_BYTES - 8:
        raise OSError(f"{put} of {size - HEADER_BYTES - 8} bytes were written")
    return size


def _shape(k: int) -> np.dtype:
    """A state's record."""
    return np.dtype([("key", "<i4", (k,)), ("start", "<i8"), ("count", "<i4")])


def _written(n: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n], pa.int64())], ["n"])


class MappedSource(DataSource):
    """``spark.read.format("tokenweave_mapped").load(path)``: transitions of one random-access file, by ranges of its states."""

    @classmethod
    def name(cls) -> str:
        return "tokenweave_mapped"

    def schema(self) -> str:
        return "state array<string>, follow string, n bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(local(self.options["path"]), int(self.options.get("states", READ_STATES)))


class _Ranges(DataSourceReader):
    def __init__(self, path: str, states: int):
        self.path, self.states = path, states

    def partitions(self):
        with open(self.path, "rb") as f:
            n = MappedFile(f.read(HEADER_BYTES)).n_states
        return [InputPartition((a, min(a + self.states, n))) for a in range(0, n, self.states)] or [InputPartition((0, 0))]

    def read(self, partition):
        a, z = partition.value
        raw = pa.memory_map(self.path).read_buffer()
        m = MappedFile(memoryview(raw))
        words = pa.LargeStringArray.from_buffers(m.n_words, raw.slice(m.at_index, 8 * (m.n_words + 1)), raw.slice(m.at_data, m.at_states - m.at_data))
        word = lambda ids: words.take(pa.array(ids)).cast(pa.string())
        for lo in range(a, z, 4096):
            n = min(4096, z - lo)
            states = np.frombuffer(raw, _shape(m.k), n, m.at_states + lo * m.record)
            start, count = states["start"], states["count"].astype(np.int64)
            first, stop = int(start.min()), int((start + count).max())
            pairs = np.frombuffer(raw, "<i4", 2 * (stop - first), m.at_followers + 8 * first).reshape(-1, 2)
            pairs = pairs[np.arange(int(count.sum())) + np.repeat(start - first - (np.cumsum(count) - count), count)]
            keys = word(np.repeat(states["key"], count, axis=0).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pairs) + 1, dtype=np.int32) * m.k), keys)
            yield pa.record_batch([lists, word(np.ascontiguousarray(pairs[:, 0])), pa.array(pairs[:, 1].astype(np.int64))], ["state", "follow", "n"])


def load(spark: SparkSession, path: str, states: int = READ_STATES) -> MarkovModel:
    """A saved model, whose file is read in tasks of so many states."""
    with open(local(path), "rb") as f:
        head = MappedFile(f.read(HEADER_BYTES))
    return MarkovModel(transitions(spark, path, states), head.k, head.temperature)


def transitions(spark: SparkSession, path: str, states: int = READ_STATES) -> DataFrame:
    spark.dataSource.register(MappedSource)
    return spark.read.format("tokenweave_mapped").option("states", str(states)).load(local(path))

