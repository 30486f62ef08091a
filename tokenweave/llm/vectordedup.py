"""Embedding near-dedup by robust-pruned graphs over overlapping cluster shards.

1. Equal vectors of a label are one vector with a count. Up to ``MAX_CENTROIDS`` vectors, a hashed sample of one in
   ``shard_size``, are centroids; of centroids of a label that are near each other the first stays, so a dense group is
   not cut up. Each vector goes to the shards of its ``overlap`` nearest centroids, as far as they are within ``margin``
   of the nearest.
2. A shard's graph: for each vector, near others (from the cells of a few pivots), some others at random and the shard's
   medoid, thinned by robust pruning, with the reverse edges. The lists of a vector in all its shards are united.
3. In each shard, on the united lists, a greedy beam search from the medoid (and the query's own node) finds each vector's
   neighbourhood, and a range expansion follows edges as long as the similarity stays within ``slack`` of the threshold. Similarities are computed
   in double precision from the vectors, so every link is verified. A link is found from either end and counts for both, in
   the smallest shard that both are in and nowhere else.
4. Links of a shard become a star for each of its components; stars of all shards are joined to components.
5. Audit: for a hashed sample of vectors, links are counted by brute force over all rows. The sample grows, to 16 times
   its size at most, until ``LINKED`` of its vectors outside dense groups (more than ``shard_size`` links) have links. As many
   probes, each a little nearer than the threshold to a sampled vector, are searched with the others and audited like them, so recall is
   always measured, links whose ends share no shard included. Recall is the mean over vectors with links, by itself for those in
   dense groups and for the others; the lower one counts. If it is below ``least_recall``, the shards are built anew with more
   overlap, in the last round with all centroids of the label and no margin; if it is below even then, all vectors of a
   label are compared with each other in blocks (a warning says so).

A shard of more than ``max_block`` vectors is cut into blocks by hash, and each pair of blocks is a task of its own, so
no task holds more than two blocks. Pairs of vectors are never emitted, and in a task links are bits of a matrix, however dense a group is.

Defined results: null ids are kept, with no links and a null component; null labels, and vectors that are null, empty,
zero or hold null or non-finite components, link with nothing; vectors of different lengths don't link; rows of one id
are one vector for ``component_id`` and count apiece for links of others unless their vectors are equal; other columns
stay out of the result.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm import common as C
from tokenweave.llm.components import components

MAX_CENTROIDS = 16384
LINKED = 32
DEGREE, NEAR, FAR, BEAM, ALPHA = 24, 24, 8, 16, 1.2
#: Pivots' cells that a vector goes to when a graph is built, and vectors of a cell that are compared.
LAYERS, CELL = 3, 256


def candidates(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Near neighbours of each vector (its own number where there are fewer), without comparing all pairs.

    Each vector goes to the cells of its LAYERS nearest of about sqrt(n) pivots; a cell is compared within itself, and cut at
    random if it holds more than CELL vectors. So n vectors take about n * sqrt(n) comparisons, however dense they are.
    """
    n = len(x)
    pivots = rng.choice(n, int(np.ceil(np.sqrt(n))) if n > CELL else 1, replace=False)
    layers = min(LAYERS, len(pivots))
    near = np.argsort(-(x @ x[pivots].T), 1, kind="stable")[:, :layers]
    each = NEAR // layers
    out = np.repeat(np.arange(n)[:, None], layers * each, 1)
    for layer in range(layers):
        cell = near[:, layer]
        order = np.lexsort((rng.random(n), cell))
        cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        for a, z in zip(cuts, np.append(cuts[1:], n)):
            for g in np.array_split(order[a:z], -(-(z - a) // CELL)):
                k = min(each, len(g) - 1)
                if k > 0:
                    s = x[g] @ x[g].T
                    np.fill_diagonal(s, -2)
                    out[g, layer * each : layer * each + k] = g[np.argpartition(-s, k - 1, 1)[:, :k]]
    return out


def build_graph(x: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """Union of the pruned lists and their reverse edges as offsets and targets, and the medoid."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(0)))
    if n == 1:
        return np.zeros(2, np.int64), np.zeros(0, np.int64), 0
    rng = np.random.default_rng(seed)
    near, src, dst = candidates(x, rng), [], []
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        cand = np.concatenate((near[rows], rng.integers(0, n, (len(rows), FAR)), np.full((len(rows), 1), medoid)), 1)
        kept = robust_prune(x[rows], x[cand], rows, cand)
        r, k = np.nonzero(kept >= 0)
        src.append(rows[r])
        dst.append(kept[r, k])
    src, dst = np.concatenate(src), np.concatenate(dst)
    both = np.unique(np.concatenate((src * n + dst, dst * n + src)))
    src, dst = both // n, both % n
    return np.searchsorted(src, np.arange(n + 1)), dst, medoid


def robust_prune(x: np.ndarray, near: np.ndarray, rows: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Of each node's candidates (n, c) with vectors near, those that no kept, ALPHA times nearer candidate hides; -1 else."""
    n, c = cand.shape
    d_own = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", x, near)))
    d_own[cand == rows[:, None]] = np.inf
    order = np.argsort(d_own, 1, kind="stable")
    cand, d_own = np.take_along_axis(cand, order, 1), np.take_along_axis(d_own, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    d_pair = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))))
    alive, kept, count = np.isfinite(d_own), np.zeros((n, c), bool), np.zeros(n, int)
    for t in range(c):
        take = alive[:, t] & (count < DEGREE)
        kept[:, t] = take
        count += take
        alive &= ~(take[:, None] & (ALPHA * d_pair[:, t] <= d_own))
        alive[:, t] = False
    return np.where(kept, cand, -1)


def _expand(off, dst, q, node):
    """(query, neighbour) of all edges of the (query, node) pairs."""
    n = off[node + 1] - off[node]
    return np.repeat(q, n), dst[C.ranges(off[node], n)]


def near_rows(x: np.ndarray, graph, queries: np.ndarray, threshold: float, slack: float):
    """(queries, others) in chunks: which vectors the graph search finds at a cosine >= threshold, as a matrix of flags.

    Where a chunk's neighbourhoods turn out to be a good part of all vectors, following edges costs more than comparing: the chunk is compared with all.
    """
    off, dst, medoid = graph
    n = len(x)
    for a in range(0, len(queries), 256):
        ids = queries[a : a + 256]
        k = len(ids)
        seen = np.zeros((k, n), bool)
        # Greedy beam search from the medoid and the own node: each round expands every query's best open node.
        beam_n = np.stack([np.full(k, medoid), ids], 1)
        seen[np.arange(k), medoid] = seen[np.arange(k), ids] = True
        beam_s = np.einsum("kd,kbd->kb", x[ids], x[beam_n])
        beam_s[ids == medoid, 1] = -3
        open_ = beam_s > -2.5
        while open_.any():
            pick = np.argmax(np.where(open_, beam_s, -9), 1)
            live = np.flatnonzero(open_[np.arange(k), pick])
            open_[live, pick[live]] = False
            q, o = _expand(off, dst, live, beam_n[live, pick[live]])
            new = ~seen[q, o]
            q, o = q[new], o[new]
            seen[q, o] = True
            s = np.einsum("id,id->i", x[ids[q]], x[o])
            width = np.bincount(q, minlength=k).max(initial=0)
            if not width:
                continue
            slot = np.arange(len(q)) - np.searchsorted(q, np.arange(k))[q]
            ext_n, ext_s = np.zeros((k, width), np.int64), np.full((k, width), -3.0)
            ext_n[q, slot], ext_s[q, slot] = o, s
            all_n, all_s = np.concatenate((beam_n, ext_n), 1), np.concatenate((beam_s, ext_s), 1)
            all_o = np.concatenate((open_, ext_s > -2.5), 1)
            top = np.argsort(-all_s, 1, kind="stable")[:, :BEAM]
            beam_n, beam_s, open_ = (np.take_along_axis(v, top, 1) for v in (all_n, all_s, all_o))
        # Range expansion from what is near enough.
        seen[:] = False
        q, c = np.nonzero(beam_s >= threshold - slack)
        q, o = np.concatenate((q, np.arange(k))), np.concatenate((beam_n[q, c], ids))
        seen[q, o] = True
        frontier = np.unique(q * n + o)
        near = np.zeros((k, n), bool)
        near[q, o] = np.einsum("id,id->i", x[ids[q]], x[o]) >= threshold
        while len(frontier):
            if len(frontier) > k * max(32, n >> 6):
                near = (x[ids] @ x.T) >= threshold
                break
            q, o = _expand(off, dst, frontier // n, frontier % n)
            new = ~seen[q, o]
            code = np.unique(q[new] * n + o[new])
            q, o = code // n, code % n
            seen[q, o] = True
            s = np.concatenate([np.einsum("id,id->i", x[ids[q[b : b + 100_000]]], x[o[b : b + 100_000]]) for b in range(0, len(q), 100_000)] or [np.zeros(0)])
            near[q, o] = s >= threshold
            frontier = code[s >= threshold - slack]
        near[np.arange(k), ids] = False
        yield ids, near


def search(x: np.ndarray, graph, queries: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, other) with cosine >= threshold that the graph search finds, as pairs: for few vectors."""
    parts = [(ids[q], o) for ids, near in near_rows(x, graph, queries, threshold, slack) for q, o in [np.nonzero(near)]]
    return tuple(np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (list(zip(*parts)) if parts else ((), ())))


def compared(x: np.ndarray, threshold: float):
    """The same by comparing all with all."""
    for a in range(0, len(x), 256):
        near = (x[a : a + 256] @ x.T) >= threshold
        near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        yield np.arange(a, a + len(near)), near


#: Rows of flags that are unpacked at once.
FLAGS = 1024


class Links:
    """Links among n vectors as rows of bits, however dense: n * n / 8 bytes and no pairs."""

    def __init__(self, n: int, chunks, apart: np.ndarray | None = None):
        """chunks: as near_rows gives them; a link found from either end is one; apart: group numbers, only links between different ones count."""
        self.n = n
        self.bits = np.zeros((n, -(-n // 8)), np.uint8)
        for ids, near in chunks:
            self.bits[ids] = np.packbits(near, axis=1)
        for a in range(0, n, FLAGS):
            z = min(a + FLAGS, n)
            near = self.rows(a, z) | np.unpackbits(self.bits[:, a >> 3 : -(-z >> 3)], axis=1, count=z - a).astype(bool).T
            if apart is not None:
                near &= apart[a:z, None] != apart[None, :]
            self.bits[a:z] = np.packbits(near, axis=1)

    def rows(self, a: int, z: int) -> np.ndarray:
        return np.unpackbits(self.bits[a:z], axis=1, count=self.n).astype(bool)

    def counts(self, times: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """The vectors linked to each, with their times, but those that share a smaller shard (bits) with it."""
        shared, out = np.unpackbits(smaller, axis=1).astype(np.float32), np.zeros(self.n, np.int64)
        for a in range(0, self.n, FLAGS):
            z = min(a + FLAGS, self.n)
            near = self.rows(a, z)
            if shared.shape[1]:
                near &= (shared[a:z] @ shared.T) == 0
            out[a:z] = near @ times
        return out

    def roots(self, real: np.ndarray) -> np.ndarray:
        """The smallest number in each vector's component, by links between real vectors."""
        low = np.arange(self.n, dtype=np.int32)
        while True:
            before = low.copy()
            for a in range(0, self.n, FLAGS):
                z = min(a + FLAGS, self.n)
                near = self.rows(a, z) & real[None, :] & real[a:z, None]
                if near.any():
                    low[a:z] = np.minimum(low[a:z], np.where(near, low[None, :], self.n).min(1))
            low = low[low]
            if (low == before).all():
                return low


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, shard_size: int = 1000, overlap: int = 3, margin: float = 0.15, slack: float = 0.02, max_block: int = 8192, audit_queries: int = 256, least_recall: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("i"), F.col(f"`{label_col}`").cast("string").alias("l"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fit = "i is not null and l is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity')) and exists(v, c -> c <> 0)"
    own = src.where(fit).groupBy("l", "v").agg(F.min("i").alias("i"), F.count_distinct("i").alias("times"))
    own = C.written(own, "vectors")
    n = own.count()
    hashed = F.pmod(F.xxhash64("i", F.lit(17)), F.lit(max(shard_size, -(-n // MAX_CENTROIDS)))) == 0
    picked = own.where(hashed).orderBy(F.xxhash64("i", F.lit(17)), "i").limit(MAX_CENTROIDS).select("l", "v").toArrow()
    by: dict = {}
    for label, v in zip(picked.column("l").to_pylist(), picked.column("v").to_pylist()):
        by.setdefault((label, len(v)), []).append(v)
    centroids = {}
    for key, vs in by.items():
        m, keep = _units(np.array(vs)), []
        for k in range(len(m)):
            if not keep or (m[keep] @ m[k]).max() < 0.9:
                keep.append(k)
        centroids[key] = m[keep]
    sent = spark.sparkContext.broadcast(centroids)
    most = max([len(m) for m in centroids.values()], default=1)
    exact = _audited(own, n, threshold, audit_queries, shard_size)
    probes = _probes(own, threshold, audit_queries)
    exact |= _brute(own, probes.toArrow(), threshold)
    searched = own.unionByName(probes)

    while True:
        links, stars = _shards(searched, sent, threshold, overlap, margin, slack, max_block)
        found = links.join(F.broadcast(spark.createDataFrame([(i,) for i in exact], "i bigint")), "i").collect()  # sampled vectors and probes
        recall = _recall(exact, {r.i: r.n for r in found}, shard_size)
        if recall >= least_recall:
            break
        if overlap >= most and margin == np.inf:
            warnings.warn(f"recall of links is {recall:.4f}, below {least_recall}, with all centroids: all vectors of a label are compared", RuntimeWarning, stacklevel=2)
            links, stars = _shards(own, spark.sparkContext.broadcast({}), threshold, 1, np.inf, slack, max_block, True)
            break
        overlap, margin = overlap * 2, margin * 2
        if overlap >= most:
            margin = np.inf
    comp = components(stars, "i", "root")
    per = own.select("l", "v", F.col("i").alias("rep"), "times")
    good = src.where(fit).join(per, ["l", "v"]).select("i", "rep", "times").distinct()
    good = good.join(links.withColumnRenamed("i", "rep"), "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    good = good.groupBy("i").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("bigint").alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = src.select("i").join(good, "i", "left")
    return out.select(F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "i").alias("component_id"), (F.col("i") == F.coalesce("component_id", "i")).alias("kept"))


def _probes(own: DataFrame, threshold: float, size: int) -> DataFrame:
    """Vectors (l, v, i, times 0) each a little nearer than the threshold to one of a hashed sample, with ids of their own: what the search must find, also where no sampled vector has links.

    Their links count for them alone: with times 0 they add to no other's, and they join no components.
    """
    low, high = own.agg(F.min("i"), F.max("i")).first()
    sample = own.orderBy(F.xxhash64("i", F.lit(31)), "i").limit(size).select("l", "v").toArrow()
    rng, near, rows = np.random.default_rng(31), threshold + (1 - threshold) / 4, []
    for label, v in zip(sample.column("l").to_pylist(), sample.column("v").to_pylist()):
        if len(v) > 1:
            u = _units(np.array([v]))[0]
            w = rng.normal(size=len(v))
            w -= (w @ u) * u
            rows.append((label, (near * u + np.sqrt(1 - near * near) * w / np.sqrt(w @ w)).tolist()))
    first = low - len(rows) if rows and low > -(1 << 63) + len(rows) else (high or 0) + 1
    return own.sparkSession.createDataFrame([(label, v, first + k, 0) for k, (label, v) in enumerate(rows)], "l string, v array<double>, i bigint, times bigint")


def _audited(own: DataFrame, n: int, threshold: float, size: int, dense: int) -> dict[int, int]:
    """Exact links of a hashed sample that has LINKED vectors with some, outside groups of more than dense links."""
    exact, done = {}, 0
    for most in (size, 4 * size, 16 * size):
        sample = own.orderBy(F.xxhash64("i", F.lit(23)), "i").limit(most).select("i", "l", "v").toArrow()
        exact |= _brute(own, sample.slice(done), threshold)
        done = len(sample)
        if most >= n or sum(0 < x <= dense for x in exact.values()) >= LINKED:
            break
    return exact


def _recall(exact: dict[int, int], found: dict[int, int], dense: int) -> float:
    """The lower of the mean recalls of the vectors in dense groups and of the others; 1 where none has links."""
    parts = [[min(found.get(i, 0), x) / x for i, x in exact.items() if x and (x > dense) == hot] for hot in (False, True)]
    return min((sum(p) / len(p) for p in parts if p), default=1.0)


def _brute(own: DataFrame, sample: pa.Table, threshold: float) -> dict[int, int]:
    """Links of the sampled vectors (to other vectors, with counts) against all rows."""
    queries: dict = {}
    for i, label, v in zip(*(sample.column(c).to_pylist() for c in ("i", "l", "v"))):
        queries.setdefault((label, len(v)), []).append((i, v))
    sent = own.sparkSession.sparkContext.broadcast({k: ([i for i, _ in q], _units(np.array([v for _, v in q]))) for k, q in queries.items()})

    def count(batches):
        for b in batches:
            for key, rows in _by_key(b):
                if key in sent.value:
                    ids, m = sent.value[key]
                    near = (m @ _units(np.array(b.column("v").take(pa.array(rows)).to_pylist())).T) >= threshold
                    other = np.array(ids)[:, None] != np.asarray(b.column("i"))[rows]
                    n = ((near & other) * np.asarray(b.column("times"))[rows]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["i", "n"])

    got = own.select("l", "v", "i", "times").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {r.i: r.n for r in got}


def _by_key(b):
    groups: dict = {}
    for k, (label, v) in enumerate(zip(b.column("l").to_pylist(), np.diff(np.asarray(b.column("v").offsets)).tolist())):
        groups.setdefault((label, v), []).append(k)
    return [(key, np.array(rows)) for key, rows in groups.items()]


def _local(node: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and targets of the united lists (node numbers), as far as they stay among these vectors."""
    if isinstance(near, pa.ChunkedArray):
        near = near.combine_chunks()
    order = np.argsort(node)
    src, to = np.repeat(np.arange(len(node)), np.diff(near.offsets.to_numpy())), near.flatten().to_numpy()
    at = order[np.minimum(np.searchsorted(node, to, sorter=order), len(node) - 1)]
    here = node[at] == to
    return np.searchsorted(src[here], np.arange(len(node) + 1)), at[here]


def _smaller(shards, shard: int) -> np.ndarray:
    """Which shards before this one each vector is in, as bits."""
    if isinstance(shards, pa.ChunkedArray):
        shards = shards.combine_chunks()
    row, at = np.repeat(np.arange(len(shards)), np.diff(shards.offsets.to_numpy())), shards.flatten().to_numpy()
    row, at = row[at < shard], at[at < shard]
    some, at = np.unique(at, return_inverse=True)
    width = -(-len(some) // 8)
    bits = np.zeros((len(shards), width), np.uint8)
    np.bitwise_or.at(bits, (row, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return bits


def _shards(own: DataFrame, sent, threshold: float, overlap: int, margin: float, slack: float, max_block: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(i, n) links of each vector, and (i, root) stars; exact: by comparing all vectors of a shard."""

    def assign(batches):
        for b in batches:
            for key, rows in _by_key(b):
                rows_pa = pa.array(rows)
                x = _units(np.array(b.column("v").take(rows_pa).to_pylist()))
                m = sent.value.get(key)
                if m is None or len(m) == 1:
                    who, shard = np.arange(len(rows)), np.zeros(len(rows), int)
                else:
                    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ m.T)))
                    near = np.argsort(d, 1, kind="stable")[:, :overlap]
                    dn = np.take_along_axis(d, near, 1)
                    who, c = np.nonzero(dn <= dn[:, :1] + margin)
                    shard = near[who, c]
                sel = pa.array(rows[who])
                n = np.bincount(who, minlength=len(rows))
                all_of = C.ranges((np.cumsum(n) - n)[who], n[who])
                shards = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[who]))), pa.int32()), pa.array(shard[all_of], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("l").take(sel), pa.array(np.full(len(who), key[1]), pa.int32()), pa.array(shard, pa.int32()), shards, b.column("i").take(sel), b.column("times").take(sel), b.column("v").take(sel)], names=["l", "dim", "shard", "shards", "i", "times", "v"])

    rows = C.written(own.select("l", "v", "i", "times").mapInArrow(assign, "l string, dim int, shard int, shards array<int>, i bigint, times bigint, v array<double>"), "shards")
    keys = ["l", "dim", "shard"]
    big = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max_block)
    rows = rows.join(big, keys, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / max_block), F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("m", "blocks", "other")

    rows = C.written(rows.withColumn("node", F.xxhash64("l", "i", "v")), "shard-rows")

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("node")
        node = t.column("node").to_numpy()
        off, dst, _ = build_graph(_units(np.array(t.column("v").to_pylist())))
        return pa.table({"node": pa.array(node, pa.int64()), "near": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(node[dst], pa.int64()))})

    if exact:
        united = None
    else:
        graph = rows.groupBy(*keys, "p", "q").applyInArrow(build, "node bigint, near array<bigint>")
        united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # lists of one vector, in the few shards it is in

    def one(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("i", "ascending"), ("node", "ascending")])
        x = _units(np.array(t.column("v").to_pylist()))
        ids, times, block, node = (t.column(c).to_numpy() for c in ("i", "times", "block", "node"))
        if exact:
            chunks = compared(x, threshold)
        else:
            chunks = near_rows(x, _local(node, t.column("near")) + (int(np.argmax(x @ x.mean(0))),), np.arange(len(x)), threshold, slack)
        links = Links(len(x), chunks, block if key[3] != key[4] else None)
        n, root = links.counts(times, _smaller(t.column("shards"), key[2].as_py())), ids[links.roots(times > 0)]
        return pa.table({"i": pa.array(ids, pa.int64()), "root": pa.array(root, pa.int64()), "n": pa.array(n, pa.int64())})

    rows = rows if exact else rows.join(united, "node")
    found = C.written(rows.groupBy(*keys, "p", "q").applyInArrow(one, "i bigint, root bigint, n bigint"), "vector-links")
    return found.groupBy("i").agg(F.sum("n").alias("n")), found.where("i <> root").select("i", "root")
