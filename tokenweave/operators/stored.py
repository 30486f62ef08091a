"""Walks through a model that stays in its files: the tasks that walk look states up in sorted Parquet files.

The rows of a model (``key, follow, n``: the state's key, chain.state_key) are ranged by key, sorted by key and follower, and written in files and
row groups of bounded size. A walking task finds a state by bisection over the files' first keys and the row groups' bounds, as their footers
have them, reads the row groups that hold it, and sums its weights; footers, row groups and states that were met stay at hand up to
bounds. So nothing but the model itself is written, a walk costs what its own states cost, and no step waits for another walk.

The files are opened by the tasks, so their folder must be one that Arrow can read; ``readable`` tells.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.operators.chain import BEGIN, END, escaped, key_words, state_key
from tokenweave.sources.shared import written

#: Rows of a file, and of a row group, in which a state is looked up.
FILE_ROWS, GROUP_ROWS = 1_000_000, 16_384
#: Options of files in whose row groups a state is looked up.
LOOKED_UP = {"parquet.block.row.count.limit": str(GROUP_ROWS)}
#: Row groups that a task keeps at hand, and states, and transitions of all of these.
GROUPS, HOT_STATES, HOT_ENTRIES = 32, 50_000, 500_000
#: Words that a walk takes between two writes.
STRIDE = 256

LIVE = "walk_id bigint, attempt int, words array<{0}>, status string, init array<{0}>"


def write_sorted(rows: DataFrame, path: str, partitions: int | None = None, file_rows: int = FILE_ROWS) -> None:
    """Write rows (key, follow, ...) so that names of files and row groups in them ascend with (key, follow)."""
    ranged = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
    out = ranged.sortWithinPartitions("key", "follow").write.mode("overwrite")
    out.option("maxRecordsPerFile", file_rows).option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)


def _in_order(file: str) -> tuple[list[int], str]:
    """What sorts the files of one write: number of partition, then of the file in it."""
    name = file.rsplit("/", 1)[-1]
    return [int(x) for m in (re.match(r"part-(\d+)", name), re.search(r"-c(\d+)\.", name)) if m for x in m.groups()], name


def files_of(rows: DataFrame) -> list[str]:
    """The files of a written table, in order of their keys."""
    return sorted(rows.inputFiles(), key=_in_order)


def rows_of(spark: SparkSession, table: Stored) -> DataFrame:
    """The rows (key, follow, n) of a table, in files."""
    return spark.read.parquet(*table.parts)


def heaviest(rows: DataFrame, top: int) -> DataFrame:
    """(key, t): among others, the states without sentinels that have the top greatest sums of n, with all that equal the least of these; rows as rows_of gives them.

    Rows of a state follow one another in the files, so a task has whole states but for those at the ends of what it reads at once, and
    only its greatest sums and those at the ends move.
    """
    plain = ~F.contains("key", F.lit(BEGIN)) | ~F.array_contains(key_words(F.col("key")), BEGIN)
    at = rows.where(plain).select("key", F.col("n").cast("bigint").alias("n"), F.col("_metadata.row_index").alias("at"))

    def sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, n, place = b.column(0), np.asarray(b.column(1)), np.asarray(b.column(2))
            gap = np.diff(place) != 1  # another file, or rows that were left out
            new = np.flatnonzero(np.concatenate(([True], gap | np.asarray(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False), bool))))
            total = np.add.reduceat(n, new)
            edge = np.zeros(len(new), bool)
            edge[[0, -1]] = True
            cut = np.searchsorted(new, np.flatnonzero(gap) + 1)  # the first state after a gap; the one before it may go on elsewhere, too
            edge[cut] = edge[cut - 1] = True
            inner = total[~edge]
            least = np.partition(inner, len(inner) - top)[len(inner) - top] if len(inner) > top else 0
            some = np.flatnonzero(edge | (total >= least))
            yield pa.record_batch([key.take(pa.array(new[some])), pa.array(total[some], pa.int64())], ["key", "t"])

    return at.mapInArrow(sums, "key string, t bigint").groupBy("key").agg(F.sum("t").alias("t"))


def readable(files: list[str]) -> bool:
    """Whether the tasks can open the files of a table themselves."""
    try:
        for f in files[:1]:
            fs.FileSystem.from_uri(f)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


class Stored:
    """A model in sorted files. What a task has opened is its own, and doesn't travel."""

    key, columns, word, lowest = "key", ["key", "follow", "n"], "string", b""

    def __init__(self, files: list[str], k: int, temperature: float = 1.0, begin: str = BEGIN, end: str = END):
        self.parts, self.k, self.begin, self.end, self.temperature = files, k, begin, end, temperature
        self._fresh()

    def _fresh(self):
        self.feet, self.groups, self.met, self.entries = {}, OrderedDict(), OrderedDict(), 0

    def __getstate__(self):
        return {c: getattr(self, c) for c in ("parts", "k", "begin", "end", "temperature")}

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self._fresh()

    def _foot(self, i: int):
        """The footer of a file: (file system, path, meta data, place of the key's column)."""
        if i not in self.feet:
            system, path = fs.FileSystem.from_uri(self.parts[i])
            with system.open_input_file(path) as f:
                meta = pq.read_metadata(f)
            self.feet[i] = system, path, meta, meta.schema.names.index(self.key) if meta.num_row_groups else 0
        return self.feet[i]

    def _group(self, i: int, g: int) -> pa.Table:
        if (i, g) not in self.groups:
            system, path, meta, _ = self._foot(i)
            with system.open_input_file(path) as f:
                self.groups[i, g] = pq.ParquetFile(f, metadata=meta).read_row_group(g, columns=self.columns, use_threads=False)
            while len(self.groups) > GROUPS:
                self.groups.popitem(last=False)
        self.groups.move_to_end((i, g))
        return self.groups[i, g]

    def _raw(self, x):
        """A key as keys are compared."""
        return x if isinstance(x, bytes) else x.encode()

    def _bounds(self, i: int, g: int) -> tuple:
        """First and last key of a row group, from the footer; from the rows where a key is too long for it."""
        _, _, meta, c = self._foot(i)
        s = meta.row_group(g).column(c).statistics
        lo, hi = (s.min, s.max) if s is not None and s.has_min_max else (lambda x: (x[0].as_py(), x[-1].as_py()))(self._group(i, g).column(self.key))
        return self._raw(lo), self._raw(hi)

    def _first(self, i: int):
        return self._bounds(i, 0)[0] if self._foot(i)[2].num_row_groups else self.lowest  # only the first file of a write may be empty

    def place(self, key) -> int:
        """The first file in which a key may be."""
        return max(0, bisect.bisect_left(range(len(self.parts)), key, key=self._first) - 1)

    def rows(self, key) -> pa.Table | None:
        """A state's rows in order of follow, without their key, or None."""
        raw, found = self._raw(key), []
        for i in range(self.place(raw), len(self.parts)):
            if self._first(i) > raw:
                break
            n = self._foot(i)[2].num_row_groups
            for g in range(bisect.bisect_left(range(n), raw, key=lambda g, i=i: self._bounds(i, g)[1]), n):
                if self._bounds(i, g)[0] > raw:
                    break
                some = self._group(i, g)
                some = some.filter(pc.equal(some.column(self.key), key))
                if len(some):
                    found.append(some.select(self.columns[1:]))
        return pa.concat_tables(found) if found else None

    def _key(self, state: tuple):
        return " ".join(map(escaped, state))

    def _opened(self, rows: pa.Table):
        """(words in order, cumulative weights) of a state's rows."""
        n = rows.column("n").to_numpy().astype(np.float64)
        return rows.column("follow").combine_chunks(), np.cumsum(n if self.temperature == 1.0 else n ** (1.0 / self.temperature))

    def followers(self, state: tuple):
        """(words in order, cumulative weights) of a state, or None."""
        if state not in self.met:
            rows = self.rows(self._key(state))
            got = self.met[state] = None if rows is None else self._opened(rows)
            self.entries += len(got[1]) if got else 1
            while len(self.met) > 1 and (len(self.met) > HOT_STATES or self.entries > HOT_ENTRIES):
                _, old = self.met.popitem(last=False)
                self.entries -= len(old[1]) if old else 1
        self.met.move_to_end(state)
        return self.met[state]

    def walk(self, seed: int, walk_id: int, attempt: int, init: list[str], max_steps: int, out: list[str]) -> tuple[list[str], str]:
        """The words drawn, after those of out, and the status; "open" after STRIDE words."""
        state, stop = (*init, *out)[-self.k :], len(out) + STRIDE
        for step in range(len(out), max_steps + 1):
            if step == stop:
                return out, "open"
            got = self.followers(state)
            if got is None:
                return out, "dead"
            words, hi = got
            at = 0
            if len(hi) > 1:  # of one, any roll picks it
                u = int(hashlib.md5(f"{seed}:{walk_id}:{attempt}:{step}".encode()).hexdigest()[:13], 16) / 4503599627370496
                at = min(int(np.searchsorted(hi, u * hi[-1], "right")), len(hi) - 1)
            word = words[at].as_py()
            if word == self.end:
                return out, "end"
            if step == max_steps:
                break
            out.append(word)
            state = (*state[1:], word)
        return out, "cut"


class StoredIds(Stored):
    """A model of word ids in files sorted by the state's ids in one integer of bits each (coded.one_key)."""

    word, lowest = "bigint", -1

    def __init__(self, files: list[str], k: int, bits: int, temperature: float, begin: int, end: int):
        self.bits = bits
        super().__init__(files, k, temperature, begin, end)

    def __getstate__(self):
        return super().__getstate__() | {"bits": self.bits}

    def _raw(self, x):
        return x

    def _key(self, state: tuple):
        out = 0
        for i in state:
            out = out << self.bits | i
        return out


class StoredRows(StoredIds):
    """The same of compressed sparse rows with sums (coded.csr with a weight and bits), which say the temperature."""

    key, columns = "one", ["one", "followers"]

    def _opened(self, rows: pa.Table):
        each = pa.Table.from_struct_array(pa.chunked_array([x.flatten() for x in rows.column("followers").chunks]))
        return each.column("follow_id").combine_chunks(), each.column("cum").to_numpy()


def stored_walk(requests: DataFrame, table: Stored, seed: int, max_steps: int, rounds: list | None = None) -> DataFrame:
    """walk_id, attempt, words, status of all requests, in rounds of STRIDE words; rounds, if given, gets the number of live walks and of the files where they wait of each."""
    spark = requests.sparkSession
    sent = spark.sparkContext.broadcast(table)
    n = spark.sparkContext.defaultParallelism
    lists = pa.list_(pa.string() if table.word == "string" else pa.int64())

    def go(batches):
        stored = sent.value
        for b in batches:
            ids, attempts, words, inits = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
            got = [stored.walk(seed, *x, max_steps, w) for *x, w in zip(ids, attempts, inits, words)]
            cols = [b.column(0), b.column(1), pa.array([g[0] for g in got], lists), pa.array([g[1] for g in got], pa.string()), b.column(4)]
            yield pa.record_batch(cols, ["walk_id", "attempt", "words", "status", "init"])

    begin = F.array_repeat(F.lit(table.begin), table.k)
    live, done = requests.select("walk_id", F.col("attempt").cast("int").alias("attempt"), F.array().cast(f"array<{table.word}>").alias("words"), F.lit("open").alias("status"), F.coalesce(F.col("init").cast(f"array<{table.word}>"), begin).alias("init")), None
    while True:
        if rounds is not None:
            rounds.append((live.count(), _waiting(live, table)))
        moved = written(live.repartition(n, "walk_id", "attempt").mapInArrow(go, LIVE.format(table.word)), "stored-walk")
        ended = moved.where("status <> 'open'").select("walk_id", "attempt", "words", "status")
        done = ended if done is None else done.unionByName(ended)
        live = moved.where("status = 'open'")
        if live.isEmpty():
            sent.unpersist()
            return done


def _waiting(live: DataFrame, table: Stored) -> int:
    whole: Column = F.concat("init", "words")
    states = live.select(state_key(F.slice(whole, F.size(whole) - table.k + 1, table.k)).alias("key")).distinct()
    return len({table.place(r.key.encode()) for r in states.toLocalIterator()})
