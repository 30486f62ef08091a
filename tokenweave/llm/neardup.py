"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

1. One pass makes each text's shingles (``words`` consecutive words, weighted by their number of occurrences), a SHA-256
   of its words and a ProbMinHash signature: each shingle is a Poisson process of rate its weight, whose arrivals fall
   on random registers; a register keeps the shingle that arrives first. A shingle's process ends as soon as it is later
   than all registers. Registers of two texts agree with the probability Jaccard of their weighted shingles.
2. Texts with equal words are one class, with the smallest id for it; only that one goes on.
3. Bands of registers are keys. First the texts of a key are paired with its smallest id only, and each pair is verified
   by the exact probability Jaccard from both whole texts; verified pairs make components. What is left are keys whose
   texts are in several components: of at most ``SMALL`` texts, all pairs across components are verified; of more, the
   texts go to tasks of at most two blocks of ``BLOCK`` texts, which compare them across components as matrices and give
   back one row a text at most. So no link between classes is lost, no group is expanded into pairs of rows, and no task
   holds more than two blocks.

Defined results: words are runs of [0-9a-z] and of non-ASCII characters after lower-casing A-Z; a text of fewer words is
one shingle; a text without words (null, empty) is a class of its own; rows of one id are one document; a null id is in
no class (null) ; class_id is the smallest id of the class. Other columns are not needed and not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm import common as C
from tokenweave.llm.components import components

BANDS, ROWS = 25, 5


def word_digests(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The first half of the SHA-256 of each text's words, lower-cased and joined by spaces."""
    low, starts, ends, before = C.words(data, off)
    inside = np.zeros(len(low) + 1, bool)
    inside[C.ranges(starts, ends - starts)] = True
    inside[ends] = True  # the byte after a word stands for the space; between two texts it is stripped
    spaced = low.copy()
    spaced[ends[ends < len(low)]] = 32
    out = []
    for t in range(len(off) - 1):
        a, z = before[t], before[t + 1]
        if a == z:
            out.append(hashlib.sha256().digest()[:16])
            continue
        lo, hi = starts[a], ends[z - 1]
        out.append(hashlib.sha256(spaced[lo:hi][inside[lo:hi]].tobytes()).digest()[:16])
    return out


def shingles(data: np.ndarray, off: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: text number, hash and weight of each distinct shingle (by text)."""
    low, starts, ends, before = C.words(data, off)
    count = np.diff(before)
    h = C.span_hash(C.prefix_hash(low), starts, ends)
    n = len(count)
    with np.errstate(over="ignore"):
        grams = np.maximum(count - n_words + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(n), grams)
        at = C.ranges(before[:-1], grams)
        left = before[1:][doc] - at
        g = np.full(len(at), np.uint64(0x1F83D9ABFB41BD6B))
        for k in range(n_words):
            more = left > k
            g[more] = C.mix(g[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + k])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    head = np.ones(len(g), bool)
    head[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    return doc[first], g[first], np.diff(np.concatenate((first, [len(g)]))).astype(np.float64)


def prob_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures (n, registers) of texts from their distinct weighted shingles; texts without shingles have zeros."""
    times = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, np.uint64)
    at, live, k = np.zeros(len(key)), np.arange(len(key)), 0
    while len(live):
        k += 1
        with np.errstate(over="ignore"):
            r = C.mix(key[live] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
            u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            cell = doc[live] * registers + (C.mix(r ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        at[live] -= np.log(u) / weight[live]
        t = at[live]
        np.minimum.at(times, cell, t)
        won = times[cell] == t
        sig[cell[won]] = key[live[won]]
        latest = times.reshape(n, registers).max(1) if k < 4 or k % 8 == 0 else latest
        live = live[t < latest[doc[live]]]
    return sig.reshape(n, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sig), np.uint64(b + 1))
            for r in range(rows):
                h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
            out[:, b] = h
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two weighted sets (sorted keys, weights)."""
    (ka, wa), (kb, wb) = a, b
    keys, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(keys):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    o = np.argsort(y / x, kind="stable")
    ratio, x, y = (y / x)[o], x[o], y[o]
    upto = np.searchsorted(ratio, ratio, "right")
    ca, cb = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    return float((1 / ((only_a + ca[upto]) / x + (only_b + cb[-1] - cb[upto]) / y)).sum())


def signatures(docs: DataFrame, id_col: str, text_col: str, n_words: int, bands: int, rows: int) -> DataFrame:
    def sign(batches):
        for b in batches:
            for lo, hi in C.pieces(b.column(1)):
                data, off = C.texts(b.column(1).slice(lo, hi - lo))
                doc, key, weight = shingles(data, off, n_words)
                digest, n = np.frombuffer(b"".join(word_digests(data, off)), np.int64).reshape(-1, 2), hi - lo
                keys = band_keys(prob_minhash(doc, key, weight, n, bands * rows), bands, rows)
                full = np.bincount(doc, minlength=n) > 0
                some = np.flatnonzero(full)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n).take(pa.array(some)), pa.array(digest[some, 0]), pa.array(digest[some, 1]), lists], names=["i", "d1", "d2", "bands"])

    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null")
    return src.mapInArrow(sign, "i bigint, d1 bigint, d2 bigint, bands array<bigint>")


def verify(pairs: DataFrame, cand: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose whole texts have at least the threshold."""

    @F.arrow_udf("double")
    def similarity(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for lo, hi in C.pieces(x):
            for a, z in C.pieces(y.slice(lo, hi - lo)):  # neither side's texts are long together
                sides = []
                for col in (x.slice(lo + a, z - a), y.slice(lo + a, z - a)):
                    doc, key, weight = shingles(*C.texts(col), n_words)
                    cut = np.searchsorted(doc, np.arange(len(col) + 1))
                    sides.append([(key[p:q], weight[p:q]) for p, q in zip(cut[:-1], cut[1:])])
                out += [probability_jaccard(p, q) for p, q in zip(*sides)]
        return pa.array(out, pa.float64())

    both = pairs.join(cand.select(F.col("i").alias("b"), F.col("t").alias("tb")), "b").join(cand.select(F.col("i").alias("a"), F.col("t").alias("ta")), "a")
    return both.withColumn("s", similarity("ta", "tb")).where(F.col("s") >= threshold).select("a", "b").distinct()


def group_roots(sets: list[tuple[np.ndarray, np.ndarray]], comp: np.ndarray, threshold: float) -> np.ndarray:
    """Of weighted sets in components comp (numbers): the least component that links of at least the threshold lead to."""
    m = len(sets)
    size = np.array([len(k) for k, _ in sets])
    keys = np.concatenate([k for k, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    row = np.repeat(np.arange(m), size)
    _, col, df = np.unique(keys, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    order = np.argsort(col[shared], kind="stable")
    r, c, w = row[shared][order], col[shared][order], weight[shared][order]
    c = np.cumsum(np.diff(c, prepend=c[:1]) > 0) if len(c) else c
    total = np.bincount(row, weight, m)
    unit = np.array([bool((x == 1).all()) for _, x in sets])
    both = np.zeros((m, m), np.float32)
    mass = np.zeros((m, m), np.float32) if not unit.all() else None
    width = max(1, 8_000_000 // m)
    for x in range(0, int(c[-1]) + 1 if len(c) else 0, width):
        p, q = np.searchsorted(c, (x, x + width))
        a = np.zeros((m, width), np.float32)
        a[r[p:q], c[p:q] - x] = 1
        both += a @ a.T
        if mass is not None:
            v = np.zeros((m, width), np.float32)
            v[r[p:q], c[p:q] - x] = w[p:q] / total[r[p:q]]
            mass += v @ a.T
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-3  # counts are whole numbers
    across = comp[:, None] != comp[None, :]
    i, j = np.nonzero(np.triu(linked & across & unit[:, None] & unit[None, :]))
    low = comp.copy()

    def join(i, j):
        while len(i):
            before = low.copy()
            least = np.minimum(low[i], low[j])
            name = {}
            for x, y, z in np.unique(np.stack([low[i], low[j], least], 1), axis=0).tolist():
                for v in (x, y):
                    name[v] = min(name.get(v, v), z)
            table = np.array(sorted(name.items())).reshape(-1, 2)
            at = np.minimum(np.searchsorted(table[:, 0], low), len(table) - 1)
            low[:] = np.where(table[at, 0] == low, table[at, 1], low)
            if (before == low).all():
                break

    join(i, j)
    if mass is not None:  # weights other than 1: a bound by shared mass first, then the exact measure
        maybe = (np.minimum(mass, mass.T) >= threshold - 1e-4) & ~(unit[:, None] & unit[None, :])
        for i, j in zip(*np.nonzero(np.triu(maybe, 1))):
            if low[i] != low[j] and probability_jaccard(sets[i], sets[j]) >= threshold:
                join(np.array([i]), np.array([j]))
    return low


#: Texts of a key that are compared as pairs of rows, and texts of a block.
SMALL, BLOCK = 4, 2000


def large_groups(named: DataFrame, cand: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """(a, b): links between components in the keys of named (key, i, c), as edges to one text of the merged component."""
    count = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    top = count.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.max("n").alias("na"), F.sum("n").alias("m")).withColumn("split", F.col("m") > BLOCK)
    rows = named.join(top, "key")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    rows = rows.withColumns({"main": F.col("split") & (F.col("c") == F.col("top")), "bm": blocks(F.col("na")), "bo": blocks(F.col("m") - F.col("na"))})
    own = F.when(F.col("main"), F.pmod(F.xxhash64("i"), "bm")).otherwise(F.pmod(F.xxhash64("i"), "bo")).cast("int")
    rows = rows.withColumn("own", own)
    others = F.transform(F.sequence(F.lit(0), F.col("bo") - 1), lambda o: F.struct(F.least(o, "own").alias("p"), F.greatest(o, "own").alias("q"), F.lit(0).alias("kind")))
    mains = F.transform(F.sequence(F.lit(0), F.col("bm") - 1), lambda o: F.struct(o.alias("p"), F.col("own").alias("q"), F.lit(1).alias("kind")))
    with_others = F.transform(F.sequence(F.lit(0), F.col("bo") - 1), lambda o: F.struct(F.col("own").alias("p"), o.alias("q"), F.lit(1).alias("kind")))
    one = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("kind")))
    tasks = F.when(~F.col("split"), one).when(F.col("main"), with_others).otherwise(F.concat(others, mains))
    rows = rows.select("key", "i", "c", F.explode(tasks).alias("t")).select(F.xxhash64("key", "t").alias("g"), "i", "c").join(cand, "i")

    def settle(batches):
        held = None

        def groups(t: pa.Table, last: bool):
            g = t.column("g").to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            done = len(cut) - 1 if last else len(cut) - 2
            if done < 1:
                return [], t
            text = t.column("t").slice(0, cut[done])
            sets, at = [], 0
            arr = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            for lo, hi in C.pieces(arr):
                doc, key, weight = shingles(*C.texts(arr.slice(lo, hi - lo)), n_words)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                sets += [(key[p:q], weight[p:q]) for p, q in zip(at[:-1], at[1:])]
            i, c = t.column("i").to_numpy(), t.column("c").to_numpy()
            out = []
            for p, q in zip(cut[:done], cut[1 : done + 1]):
                low = group_roots(sets[p:q], c[p:q], threshold)
                moved = np.flatnonzero(low != c[p:q])
                out += [(int(c[p + k]), int(low[k])) for k in moved]
            return sorted(set(out)), t.slice(cut[done])

        def batch(rows):
            a, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            out, held = groups(held, False)
            if out:
                yield batch(out)
        if held is not None and held.num_rows:
            out, _ = groups(held, True)
            if out:
                yield batch(out)

    return rows.select("g", "i", "c", "t").repartition("g").sortWithinPartitions("g", "i").mapInArrow(settle, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, class_id): one row a document."""
    ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i"))
    sig = C.written(signatures(docs, id_col, text_col, n_words, bands, rows), "signatures")
    reps = C.written(sig.groupBy("d1", "d2").agg(F.min("i").alias("rep"), F.first("bands").alias("bands")), "representatives")
    member = sig.select("i", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).select("i", "rep")
    keys = reps.select(F.col("rep").alias("i"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi")
    buckets = C.written(keys.join(shared, "key").select("key", "i", "lo").distinct(), "buckets")
    text = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.col(f"`{text_col}`").alias("t"))
    cand = C.written(text.join(buckets.select("i").distinct(), "i"), "candidates")

    stars = C.written(buckets.where("lo < i").select(F.col("lo").alias("a"), F.col("i").alias("b")).distinct(), "pairs")
    links = C.written(verify(stars, cand, n_words, threshold), "links")
    label = components(links, "a", "b")
    named = C.written(buckets.join(label.withColumnRenamed("id", "i"), "i", "left").select("key", "i", F.coalesce("component", "i").alias("c")), "labelled")
    mixed = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("m")).where("x < y").select("key", "m")
    open_ = C.written(named.join(mixed, "key"), "open-keys")
    few = open_.where(F.col("m") <= SMALL)
    pairs = few.select("key", F.col("i").alias("a"), F.col("c").alias("ca")).join(few.select("key", F.col("i").alias("b"), F.col("c").alias("cb")), "key").where("a < b and ca <> cb")
    pairs = C.written(pairs.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"), "pairs")
    more = C.written(verify(pairs, cand, n_words, threshold).unionAll(large_groups(open_.where(F.col("m") > SMALL).drop("m"), cand, n_words, threshold)), "links")
    if not more.isEmpty():
        label = components(label.toDF("a", "b").unionAll(more), "a", "b")  # the stars that the links became
    classes = member.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("i", F.coalesce("component", "rep").alias("class_id")).groupBy("i").agg(F.min("class_id").alias("class_id"))
    return ids.distinct().join(classes, "i", "left").select(F.col("i").alias(id_col), F.coalesce("class_id", "i").alias("class_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents whose class has a smaller id; rows with a null id stay, and so do all rows of an id that stays."""
    found = near_duplicates(docs.select(F.col(f"`{id_col}`").alias("__nd_id"), F.col(f"`{text_col}`").alias("__nd_text")), id_col="__nd_id", text_col="__nd_text", **options)
    gone = found.where("class_id <> __nd_id").select(F.col("__nd_id").alias("__gone"))
    return docs.join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col("__gone"), "left_anti")
