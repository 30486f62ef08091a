"""Models of word ids, trained on ids: no transition is looked up in the vocabulary, only the distinct words of a piece of the texts are.

The texts are dealt into pieces by their key. The distinct words of the pieces give the vocabulary, and meet it in one join; each piece then
gets its texts and its words' ids together, and its windows leave it as counted integers, which move once, into ranges of their states.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.operators.chain import BEGIN, END, _code, _decode, check_state_size, id_bits, joined, ranked
from tokenweave.sources.shared import new_path, running_sums, written


def by_word(words: DataFrame) -> DataFrame:
    """(word, word_id): ids in order of the words."""
    return ranked(words, "word", "word_id")


def windows_of(ids: np.ndarray, sizes: np.ndarray, k: int, begin: int, end: int) -> list[np.ndarray]:
    """The k + 1 columns of all windows of runs of ids, which stand end to end."""
    padded = sizes + k + 1
    start = np.cumsum(padded) - padded
    out = np.full(int(padded.sum()), begin, np.int32)
    out[np.arange(len(ids)) + np.repeat(start + k - (np.cumsum(sizes) - sizes), sizes)] = ids
    out[start + k + sizes] = end
    at = np.arange(int(sizes.sum()) + len(sizes)) + np.repeat(start - (np.cumsum(sizes + 1) - sizes - 1), sizes + 1)
    return [out[at + j] for j in range(k + 1)]


def counted(columns: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of ids in order, and how often each occurs."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    if len(columns) * bits <= 63:
        one = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            one = (one << bits) | c
        one.sort()
        new = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1])))
        some = one[new]
        out = [((some >> (bits * j)) & ((1 << bits) - 1)).astype(np.int32) for j in range(len(columns) - 1, -1, -1)]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        differs = np.zeros(len(order) - 1, bool)
        for c in columns:
            differs |= c[1:] != c[:-1]
        new = np.flatnonzero(np.concatenate(([True], differs)))
        out = [c[new] for c in columns]
    return out, np.diff(np.append(new, len(columns[0])))


def train(runs: DataFrame, k: int, key: str, pieces: int, parts: int, rank: Callable[[DataFrame], DataFrame] = by_word) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows, vocabulary, ids of the sentinels): rows (i0, ..., follow_id, n) is the model of runs (key, words; with words) in ranges of its states, each sorted.

    rank gives all words their ids (word, word_id, and more); key deals the runs into pieces.
    """
    check_state_size(k)
    texts = runs.where(F.size("words") > 0).select(F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int").alias("p"), joined(F.col("words")).alias("s"))
    codes = written(texts.select("p", F.explode(F.split("s", " ", -1)).alias("code")).distinct(), "piece-words")
    word = F.when(F.contains("code", F.lit("\\")), _decode(F.col("code"))).otherwise(F.col("code"))
    ends = runs.sparkSession.createDataFrame([(BEGIN,), (END,)], "word string")
    vocab = written(rank(codes.select(word.alias("word")).unionAll(ends).distinct()), "vocabulary")
    at = {r.word: r.word_id for r in vocab.where(F.col("word").isin(BEGIN, END)).collect()}
    begin, end = at[BEGIN], at[END]
    largest = vocab.agg(F.max("word_id")).first()[0]
    if largest >= 1 << 31:
        raise ValueError("more words than an id of 32 bits can number")
    bits = id_bits(largest)
    ids = codes.join(vocab.select(_code(F.col("word")).alias("code"), F.col("word_id").cast("int").alias("id")), "code").select("p", "code", "id")
    names = [*[f"i{j}" for j in range(k)], "follow_id"]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = pc.split_pattern(pa.concat_arrays(left.column("s").chunks), " ") if left.num_rows else pa.array([], pa.list_(pa.string()))
        known = pa.concat_arrays(right.column("code").chunks) if right.num_rows else pa.array([], pa.string())
        found = pc.index_in(lists.flatten(), value_set=known)
        if found.null_count:
            raise ValueError("a word is not in the vocabulary")
        got, n = counted(windows_of(right.column("id").to_numpy()[found.to_numpy()], np.diff(lists.offsets.to_numpy()), k, begin, end), bits)
        return pa.table([*[pa.array(c, pa.int32()) for c in got], pa.array(n, pa.int64())], names=[*names, "n"])

    some = texts.groupBy("p").cogroup(ids.groupBy("p")).applyInArrow(count, ", ".join(f"{c} int" for c in names) + ", n bigint")
    some = some.select(*[F.col(c).cast("bigint").alias(c) for c in names], "n")  # before the ranges: a cast after them would hide them from what comes next
    rows = some.repartitionByRange(parts, *names[:k]).groupBy(*names).agg(F.sum("n").alias("n")).sortWithinPartitions(*names)
    return rows, vocab, {BEGIN: begin, END: end}


def key_of(k: int) -> Column:
    return F.array(*[f"i{j}" for j in range(k)])


def one_key(k: int, bits: int) -> Column | None:
    """A state's ids in one integer that has their order, or null if they don't fit."""
    if k * bits > 63:
        return None
    out = F.lit(0).cast("bigint")
    for j in range(k):
        out = F.shiftleft(out, bits).bitwiseOR(F.col(f"i{j}"))
    return out


def csr(rows: DataFrame, k: int, weight=None, bits: int | None = None, **options) -> DataFrame:
    """chain.csr of rows that train gives, which don't move again; with bits, and if the ids fit, also one: the state in one integer (one_key). options: of the files."""
    from pyspark.sql import Window

    by, entry = [f"i{j}" for j in range(k)], ["follow_id", "n"]
    if weight is not None:
        upto = F.sum(weight(F.col("n")).cast("double")).over(Window.partitionBy(*by).orderBy("follow_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows, entry = rows.withColumn("cum", upto), [*entry, "cum"]
    out = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("followers"))
    more = [one_key(k, bits).alias("one")] if bits and k * bits <= 63 else []
    out = out.select(*by, *more, "followers", F.size("followers").cast("bigint").alias("degree"), F.lit(1).cast("bigint").alias("__one"))
    out = running_sums(out, by, {"__one": "state_id", "degree": "row_start"}, "rows", ranged=True, **options)
    return out.select(key_of(k).alias("key"), "state_id", "row_start", "degree", "followers", *(["one"] if more else []))


def in_files(rows: DataFrame, k: int, bits: int, **options) -> DataFrame:
    """(key, follow, n) of rows that train gives, with the state in one integer, written in their ranges."""
    path = new_path(rows.sparkSession, "id-ranges")
    rows.select(one_key(k, bits).alias("key"), F.col("follow_id").alias("follow"), "n").write.options(**options).parquet(path)
    return rows.sparkSession.read.parquet(path)
