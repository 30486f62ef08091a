"""A prefix trie of conversations, by distributed MSD radix partitioning.

Distinct turns (role and text) get dictionary ids, and a conversation becomes the array of its turns' ids. Equal conversations
are one sequence with a weight. Sequences start in one bucket, the root; a bucket of more than ``local_turns`` turns is split by
the id at its depth, which makes the children of its node, and each large child is split again. Buckets that are small are
finished where they are: a multikey quicksort of their sequences, whose recursion emits the nodes below. Sums over subtrees
are finished in the local buckets and then go up through the split nodes, level by level.

A node is known by (conv_id, depth): its smallest member and the number of turns; that conversation has one node at each depth.

At scale: turns are hashed before they move, so texts are read once and don't; counts of a bucket's children are summed before
the shuffle, so a first turn that a third of all conversations share is no hot key; equal conversations are counted before the
shuffle, and the ids that ``ends_sha256`` needs in order arrive as one joined piece for each range of ids. Every round writes
its tables to the shared folder. A round splits one turn deeper, so there are as many rounds as the turns that more than
``local_turns`` turns of different conversations share. A conversation is one row (16 bytes a turn), as its sequence must be one.

Defined results: null roles and texts are empty; rows without a conversation id belong to none and are left out; turns come in order of
``turn``, null first, equal ones by the sha256 of role and text, and repeated rows are repeated turns; a conversation without turns left is
a member of the root, and ends there; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweave.llm.common import column, written

#: Turns of a bucket that is finished in one piece.
LOCAL_TURNS = 100_000
#: Large children of a round that may be broadcast.
BROADCAST_NODES = 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, top boolean"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, ids array<bigint>, chars array<int>): each conversation's turns in order, as dictionary ids with their texts' code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    full = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = written(turns.where("conv_id is not null").select("conv_id", "turn", F.unhex(full).alias("d"), F.length(text).alias("chars")), "trie-turns")
    ids = written(rows.select("d").distinct().select("d", F.monotonically_increasing_id().alias("id")), "trie-dictionary")
    entry = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "d", "id", "chars")
    out = rows.join(ids, "d").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return out.select("conv_id", F.transform("x", lambda e: e["id"]).alias("ids"), F.transform("x", lambda e: e["chars"]).alias("chars"))


def grafted(convs: DataFrame, base_every: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % base_every, with h = crc32(c) % heads; then their own after h."""
    convs = written(convs, "trie-own")
    head = lambda c: F.slice(c, 1, heads)
    base = convs.where(F.col("conv_id") % base_every == 0).select(F.col("conv_id").alias("b"), head("ids").alias("bi"), head("chars").alias("bc"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    both = convs.join(base, F.col("conv_id") - F.col("conv_id") % base_every == F.col("b"), "left").withColumn("h", h)
    join = lambda b, own: F.concat(F.slice(F.coalesce(b, F.array().cast(convs.schema[own].dataType)), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own)))
    return both.select("conv_id", join("bi", "ids").alias("ids"), join("bc", "chars").alias("chars"))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of pieces sorted by (key, place): the sha256 of each key's pieces, comma-joined."""
    key, sha = None, None
    for b in batches:
        keys, out = [], []
        for k, piece in zip(column(b, "key").to_pylist(), column(b, "piece").to_pylist()):
            if k == key:
                sha.update(b",")
            else:
                if sha is not None:
                    keys.append(key)
                    out.append(sha.hexdigest())
                key, sha = k, hashlib.sha256()
            sha.update(piece.encode())
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends"])
    if sha is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["key", "ends"])


def sequences(convs: DataFrame) -> DataFrame:
    """(ids, chars, n, low, ends): the distinct sequences, their conversations' number, smallest id and digest of ids in order."""
    convs = written(convs.withColumn("key", _digest(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))), "trie-conversations")
    same = convs.groupBy("key").agg(F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    ranged = convs.select("conv_id", "key").repartitionByRange("conv_id").withColumn("p", F.spark_partition_id())
    pieces = ranged.groupBy("key", "p").agg(F.array_sort(F.collect_list("conv_id")).alias("x"))
    pieces = pieces.select("key", F.element_at("x", 1).alias("at"), F.array_join(F.transform("x", lambda c: c.cast("string")), ",").alias("piece"))
    ends = pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_end_digests, "key binary, ends string")
    return written(same.join(ends, "key").drop("key"), "trie-sequences")


def _quicksort(groups: np.ndarray, ids: np.ndarray, off: np.ndarray, emit) -> None:
    """Multikey quicksort of the sequences ids[off[i]:off[i+1]], which share their first id within a group; groups holds the groups' first rows.

    emit(rows, depth, parent) is called for each node with the rows below it and gives the node's number.
    """
    length = np.diff(off)
    stack = [(np.arange(a, z), 1, -1, True) for a, z in zip(groups[:-1], groups[1:])][::-1]
    while stack:
        rows, depth, parent, node = stack.pop()
        if node:  # all rows share the first depth ids
            parent = emit(rows, depth, parent)
            if len(rows) == 1:
                continue  # its chain has been emitted
            rows = rows[length[rows] > depth]
            if not len(rows):
                continue
        here = ids[off[rows] + depth]
        pivot = here[len(here) // 2]
        for part, same in ((here < pivot, False), (here > pivot, False), (here == pivot, True)):
            if part.any():
                stack.append((rows[part], depth + same, parent, same))


class _Nodes:
    """Nodes of whole buckets, emitted by the sort; sums over subtrees come last, level by level from below."""

    def __init__(self, length, off, chars, n, low, ends):
        self.length, self.off, self.chars, self.n, self.low, self.row_ends = length, off, chars, n, low, ends
        self.parts, self.size, self.ends = [], 0, {}

    def emit(self, rows: np.ndarray, depth: int, parent: int) -> int:
        first = self.size
        if len(rows) == 1:
            r = int(rows[0])
            k = int(self.length[r]) - depth + 1
            d = np.arange(depth, depth + k)
            up = np.arange(first - 1, first + k - 1)
            up[0] = parent
            self.parts.append((d, up, np.full(k, self.low[r]), np.full(k, self.n[r]), (self.n[r] - 1) * self.chars[self.off[r] + d - 1], np.full(k, r)))
            self.ends[first + k - 1] = self.row_ends[r]
        else:
            k, total, r = 1, int(self.n[rows].sum()), int(rows[0])
            self.parts.append((np.array([depth]), np.array([parent]), np.array([self.low[rows].min()]), np.array([total]), np.array([(total - 1) * self.chars[self.off[r] + depth - 1]]), np.array([r])))
            done = rows[self.length[rows] == depth]
            if len(done):  # one at most, as sequences differ
                self.ends[first] = self.row_ends[int(done[0])]
        self.size += k
        return first + k - 1

    def table(self, above: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
        """above, base: the conversation of the node over each row's bucket, and its depth."""
        depth, up, low, n, saved, row = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts))
        order = np.argsort(depth, kind="stable")[::-1]
        cuts = np.flatnonzero(np.diff(depth[order], prepend=depth[order][0] + 1))
        kids, leaves = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for a, z in zip(cuts, [*cuts[1:], self.size]):
            level = order[a:z]
            leaves[level] += kids[level] == 0
            inner = level[up[level] >= 0]
            np.add.at(kids, up[inner], 1)
            np.add.at(leaves, up[inner], leaves[inner])
            np.add.at(saved, up[inner], saved[inner])
        top = up < 0
        over = np.where(top, above[row], low[np.maximum(up, 0)])
        ends = [self.ends.get(i, NO_ENDS) for i in range(self.size)]
        cols = [low, depth + base[row], over, n, kids, leaves, saved]
        names = [f.split()[0] for f in NODE.split(", ")]
        return pa.record_batch([*map(pa.array, cols), pa.array(ends, pa.string()), pa.array(top)], names)


def _lists(arr) -> tuple[np.ndarray, np.ndarray]:
    off = np.asarray(arr.offsets).astype(np.int64)
    return np.asarray(arr.values)[off[0] : off[-1]], off - off[0]


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of small buckets, given sorted by bucket (depth, parent, digit), some whole buckets at a time."""
    held: list[pa.RecordBatch] = []

    def nodes(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        get = lambda c: t.column(c).combine_chunks()
        ids, off = _lists(get("ids"))
        chars, _ = _lists(get("chars"))
        base, above, digit = (np.asarray(get(c)) for c in ("depth", "parent", "digit"))
        new = np.flatnonzero((np.diff(base) != 0) | (np.diff(above) != 0) | (np.diff(digit) != 0)) + 1
        made = _Nodes(np.diff(off), off, chars.astype(np.int64), np.asarray(get("n")), np.asarray(get("low")), get("ends").to_pylist())
        _quicksort(np.concatenate(([0], new, [len(base)])), ids, off, made.emit)
        return made.table(above, base)

    turns = 0
    for b in batches:
        if not b.num_rows:
            continue
        # Where the bucket of the batch's last row begins: what is before it is whole.
        same = np.ones(b.num_rows, bool)
        for c in ("depth", "parent", "digit"):
            x = np.asarray(column(b, c))
            same &= x == x[-1]
        last = int(np.argmax(same))
        goes_on = bool(held) and all(column(held[-1], c)[-1] == column(b, c)[0] for c in ("depth", "parent", "digit"))
        if last or not goes_on:
            if last:
                held.append(b.slice(0, last))
            if held and turns + len(column(b, "ids").flatten()) >= LOCAL_TURNS:
                yield nodes(pa.Table.from_batches(held))
                held, turns = [], 0
        held.append(b.slice(last))
        turns += len(column(b, "ids").flatten())
    if held:
        yield nodes(pa.Table.from_batches(held))


def trie(convs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of conversations given as (conv_id, ids, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    n_convs: conversations below; saved_tokens: over the subtree, the texts' code points times the conversations beyond the first.
    """
    seqs = sequences(convs)
    spark = seqs.sparkSession
    whole = seqs.agg(F.min("low").alias("low"), F.sum("n").alias("n")).first()
    split = [spark.createDataFrame([] if whole.low is None else [(whole.low, None, whole.n, 0)], "low bigint, parent bigint, n_convs bigint, chars int")]
    active, local, ended = seqs.withColumn("parent", F.lit(whole.low).cast("bigint")), [], []
    while True:
        r = len(split) - 1
        ended.append(active.where(F.size("ids") == r).select(F.col("parent").alias("node"), "ends"))
        deeper = active.where(F.size("ids") > r).withColumn("digit", F.col("ids")[r])
        children = deeper.groupBy("parent", "digit").agg(F.sum("n").alias("n_convs"), F.min("low").alias("child"), F.sum(F.size("ids") - r).alias("turns"), F.max(F.col("chars")[r]).alias("chars"))
        large = written(children.where(F.col("turns") > local_turns), "trie-split")
        count = large.count()
        keys = large.select("parent", "digit", "child")
        found = deeper.join(F.broadcast(keys) if count <= BROADCAST_NODES else keys, ["parent", "digit"], "left") if count else deeper.withColumn("child", F.lit(None).cast("bigint"))
        rest = lambda c, r=r: F.slice(c, F.lit(r + 1), F.size(c)).alias(c)
        local.append(found.where("child is null").select(F.lit(r).cast("bigint").alias("depth"), "parent", "digit", rest("ids"), rest("chars"), "n", "low", "ends"))
        if not count:
            break
        split.append(large.select(F.col("child").alias("low"), "parent", "n_convs", "chars"))
        active = written(found.where("child is not null").drop("parent", "digit").withColumnRenamed("child", "parent"), "trie-bucket")
    parts = local[0]
    for more in local[1:]:
        parts = parts.unionByName(more)
    nodes = written(parts.repartition("depth", "parent", "digit").sortWithinPartitions("depth", "parent", "digit").mapInArrow(finish, NODE), "trie-nodes")
    out = nodes.drop("top")
    below = None
    for r in range(len(split) - 1, -1, -1):
        kids = nodes.where(F.col("top") & (F.col("depth") == r + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        kids = kids if below is None else kids.unionByName(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent_conv_id").alias("low")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        own = split[r].join(sums, "low", "left").join(ended[r].withColumnRenamed("node", "low"), "low", "left")
        below = written(own.select(
            F.col("low").alias("conv_id"), F.lit(r).cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("l", F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("s", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-upper")
        out = out.unionByName(below)
    return out

