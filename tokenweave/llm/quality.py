"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model.

``fit`` takes at most ``per_class`` labelled rows of each class (the rows whose hashed id is smallest), turns their
whole texts into hashed n-gram indicators on the executors (32 KB a row at most), and fits on the driver: the log-count ratio r of every
feature, then a support vector machine over r-scaled, length-normalised indicators by dual coordinate descent.
``score`` applies it to whole texts in one narrow pass, without a shuffle.

Defined results: a null text is an empty text; an empty text has no features and gets the score of the bias alone; a
null id counts as not held out; repeated rows are scored alike; a document labelled twice takes the lower label; null
labels are ignored; with labels of one class only (or none) every text gets that class's constant score (0.5 for none).
Other columns of the input are kept, whatever their names; ``score`` replaces a column of the name it is given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.llm import common as C

BITS = 18
#: Longest n-gram of bytes, and longest n-gram of byte-class runs.
BYTE_N, SHAPE_N = 4, 4
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97
_CLASS[9:14] = 32


def _grams(flags: np.ndarray, seq: np.ndarray, n_max: int, salt: int) -> None:
    h = np.full(len(seq), np.uint32(salt))
    for n in range(1, n_max + 1):
        if len(seq) < n:
            break
        with np.errstate(over="ignore"):
            h = (h[: len(seq) - n + 1] ^ seq[n - 1 :].astype(np.uint32)) * np.uint32(0x01000193) + np.uint32(n)
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        flags[g >> np.uint32(32 - BITS)] = True


def features(data: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of one text's bytes: n-grams of bytes, n-grams of byte-class runs, and how many words repeat the one before."""
    flags = np.zeros(1 << BITS, bool)
    _grams(flags, data, BYTE_N, 0x811C9DC5)
    shape = _CLASS[data]
    if len(shape):
        shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))]
    _grams(flags, shape, SHAPE_N, 0x1234567)
    _, starts, ends, _ = C.words(data, np.array([0, len(data)]))
    if len(starts) > 1:
        h = C.span_hash(C.prefix_hash(data), starts, ends)
        share = np.mean(h[1:] == h[:-1])
        _grams(flags, np.array([np.searchsorted([0.001, 0.01, 0.05, 0.2, 0.5], share)], np.uint8), 1, 0x7654321)
    return np.flatnonzero(flags).astype(np.int32)


def pack(idx: np.ndarray) -> bytes:
    """Feature numbers in at most 2**BITS / 8 bytes: as they are, or as bits where these are shorter."""
    if 4 * len(idx) < 1 << BITS - 3:
        return idx.astype("<i4").tobytes()
    flags = np.zeros(1 << BITS, bool)
    flags[idx] = True
    return np.packbits(flags).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if len(raw) < 1 << BITS - 3:
        return np.frombuffer(raw, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)


@dataclass
class Model:
    """w: weight of each feature, already scaled; r2: its share of the squared length; score = sigmoid(slope * margin)."""

    w: np.ndarray
    r2: np.ndarray
    bias: float
    slope: float = 4.0

    def margin(self, idx: np.ndarray) -> float:
        norm = float(np.sqrt(self.r2[idx].sum(dtype=np.float64)))
        return self.bias + (float(self.w[idx].sum(dtype=np.float64)) / norm if norm else 0.0)

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(idx), -30, 30))))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine over the given sparse rows, by dual coordinate descent.

    rows[i] are feature numbers, the value of feature f in row i is values[f] / |row i|; the bias is a feature of value 1.
    """
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    norms = [float(np.sqrt((values[r] ** 2).sum())) or 1.0 for r in rows]
    q = np.array([float(x @ x) + 1.0 for x in (values[r] / n for r, n in zip(rows, norms))])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x = values[rows[i]] / norms[i]  # made again in each round: all rows' values would be twice as large as the rows
            g = y[i] * (float(w[rows[i]] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                worst = max(worst, abs(step))
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
        if worst < 1e-4:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 4.0, rounds: int = 25, seed: int = 7) -> Model:
    size = 1 << BITS
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        return Model(np.zeros(size), np.zeros(size), 0.0 if n0 == n1 else (1.0 if n1 else -1.0))
    p, q = np.ones(size), np.ones(size)
    for r, l in zip(rows, labels):
        (p if l else q)[r] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p + q) <= 4] = 0  # seen in at most two rows
    y = np.where(labels > 0, 1.0, -1.0)
    w, bias = dual_descent(rows, ratio, y, cost * len(labels) / 2 / np.where(labels > 0, n1, n0), rounds, seed)
    return Model(w * ratio, ratio**2, bias)


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, seed: int = 11) -> Model:
    """Fit on at most per_class labelled rows of each class; keep: a condition on id_col of the rows to learn from."""
    known = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").alias("y")).where("i is not null and y is not null")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("i"), F.lit(seed)), "i").limit(per_class)
        picked = one if picked is None else picked.unionAll(one)
    rows = picked.collect()  # 2 * per_class rows at most
    spark = docs.sparkSession
    some = spark.createDataFrame([(r.i, int(r.y)) for r in rows], f"i {dict(labels.dtypes)[id_col]}, y int")

    def featurise(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                out.append(pack(features(np.frombuffer((v.as_py() or "").encode(), np.uint8))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["y", "f"])

    found = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(some), "i").select("y", "t").mapInArrow(featurise, "y int, f binary").orderBy(F.xxhash64("f"), "y").limit(2 * per_class).toArrow()
    feats, known_as = [unpack(f.as_py()) for f in found.column("f")], found.column("y").to_numpy().astype(int)
    del found
    model = fit_rows(feats, known_as)
    del feats
    C.release()  # the driver goes on without the rows
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 in column out; one narrow pass over whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.r2.astype(np.float32), model.bias, model.slope))  # 2 MB, fixed by BITS

    @F.arrow_udf("double")
    def apply(col: pa.Array) -> pa.Array:
        m, out = Model(*sent.value), []
        for lo, hi in C.pieces(col):
            data, off = C.texts(col.slice(lo, hi - lo))
            out += [m.score(features(data[a:b])) for a, b in zip(off[:-1], off[1:])]
        return pa.array(out, pa.float64())

    return docs.withColumn(out, apply(F.col(f"`{text_col}`")))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1 (null id: no)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))
