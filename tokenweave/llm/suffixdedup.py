"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts earlier.

Sorting all suffixes of a corpus would move each byte many times, so only suffixes that can repeat are sorted:

1. Anchors. In every window of ``length`` bytes the smallest hash of its 32-byte grams is the window's anchor, so equal
   windows have equal anchors. A run is the windows of one anchor; its region is their bytes. One row a run - hashes of
   anchor and region, document, place - goes to the partition of its anchor. A run whose region occurred earlier in the
   same piece of text is known to be removed and only passes through, so hot copies are summed before the shuffle. Rows
   of an anchor (or, in step 3, of a common part) that a sample of the documents shows to be hot go apart by region.
2. Rows are read in order of anchor, region, document and place. Equal regions: all but the first are removed. An anchor
   with one region only is done. Of anchors with several regions, one row each goes on.
3. Those runs are cut into blocks of at most ``BLOCK`` windows, at places fixed by the anchor, and compared again in the
   same way: equal blocks are removed but for the first, and a block whose windows' common part occurs in no other
   block is done. What is left are the blocks in which a repeat begins or ends.
4. The suffixes at the windows of those blocks are cut from the texts. Sampled splitters range-partition them by their
   bytes; each bucket sorts by multikey quicksort, eight bytes at a time and only among ties, and of equal neighbours all
   but the earliest are removed. Equal windows of one piece of text are settled before. The first and the last window of
   a bucket may go on in the next one: they are compared across boundaries by one more, small aggregation.
5. Removed spans are united by document and cut from the texts.

No group is larger than a document: what a third of all texts share is summed by piece and split between buckets.
Rows are equal in steps 2 and 3 if two 64-bit hashes of different bytes are (of the anchor or the common part, and of the region), in step
4 if their bytes are.

Defined results: texts are UTF-8 bytes, null is empty; matches never cross documents; texts shorter than ``length`` lose
nothing; a null id comes before all others; rows with one id are one document with several texts: equal texts of it
count once, and a span removed in one is removed in all; ids are integers; other columns of the input stay, but those of
the names that the result gets are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenweave.llm import common as C

GRAM = 32
NO_ID = -(1 << 63)
#: A run's windows and its anchor's place in it are kept in 16 and 15 bits.
MAX_LENGTH = 30_000
#: Windows of a block, and windows that are sorted at once if their first eight bytes allow.
BLOCK, PORTION = 8, 200_000
#: Anchors and common parts in HOT of about SAMPLE hashed documents are hot. The sample decides where rows go, never what comes out.
SAMPLE, HOT = 4096, 16


def runs_of(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number of windows, anchor place, hashes of the anchor and the region."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = C.prefix_hash(data)
    p = np.arange(n - gram + 1)
    g = C.span_hash(prefix, p, p + gram)
    grams, mask = length - gram + 1, np.uint64((1 << 24) - 1)
    key = (g & ~mask) | (p.astype(np.uint64) & mask)  # of equal grams the leftmost
    blocks = np.concatenate((key, np.full(-len(key) % grams, ~np.uint64(0)))).reshape(-1, grams)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    wins = n - length + 1
    low = (np.minimum(after[:wins], before[grams - 1 : grams - 1 + wins]) & mask).astype(np.int64)
    s = np.arange(wins)
    place = s + ((low - s) & int(mask))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:wins]
    ok = s + length <= off[1:][doc]
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return runs_of(data[:0], off[:1], length, gram)
    count = np.bincount((np.cumsum(new) - 1)[ok], minlength=len(first))
    at = place[first]
    with np.errstate(over="ignore"):
        region = C.mix(C.span_hash(prefix, first, first + count - 1 + length) + (at - first).astype(np.uint64))
    return first, count, at, g[at], np.where(region == 0, np.uint64(1), region)


def pack(first: np.ndarray, count: np.ndarray, to_anchor: np.ndarray) -> np.ndarray:
    """A run as one integer, in order of its first window; bit 15 marks a hot anchor."""
    return first << 32 | count << 16 | to_anchor


def unpack(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return run >> 32, run >> 16 & 0xFFFF, run & 0x7FFF


ROWS = "kind tinyint, key bigint, i bigint, run bigint"


def _rows(kind: int, key, i, run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind), pa.int8()), *(pa.array(x, pa.int64()) for x in (key, i, run))], names=["kind", "key", "i", "run"])


def _pass_repeats(key: np.ndarray, region: np.ndarray, i: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """The rows of a piece of text; one whose region occurred earlier in it is known (region 0) and goes anywhere."""
    order = np.lexsort((run, i, region))
    r, ii, rr = region[order], i[order], run[order]
    head = np.ones(len(order), bool)
    head[1:] = r[1:] != r[:-1]
    rep = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    again = np.zeros(len(order), bool)
    again[order] = ~head & ((ii != ii[rep]) | (rr != rr[rep]))
    ii, (first, count, _) = i[again], unpack(run[again])  # runs that follow one another become one
    o = np.lexsort((first, ii))
    ii, first, count = ii[o], first[o], count[o]
    new = np.ones(len(o), bool)
    new[1:] = (ii[1:] != ii[:-1]) | (first[1:] != first[:-1] + count[:-1]) | (first[1:] >> 15 != first[:-1] >> 15)
    at = np.flatnonzero(new)
    ii, run_of = ii[at], pack(first[at], np.add.reduceat(count, at) if len(at) else count, np.zeros(len(at), np.int64))
    return _keyed(*(np.concatenate((x[~again], y)) for x, y in ((key.view(np.int64), _anywhere(ii, run_of)), (region.view(np.int64), np.zeros(len(at), np.int64)), (i, ii), (run, run_of))))


def _anywhere(i: np.ndarray, run: np.ndarray) -> np.ndarray:
    return C.mix(i.view(np.uint64) ^ run.view(np.uint64)).view(np.int64)


def _keyed(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["key", "region", "i", "run"])


def _first_of_regions(batches):
    """Of rows sorted by key, region, i and run: the repeats of a region (kind 1), and its first row (kind 0) if the key has several regions or is hot."""
    last, shown = None, True  # the first row of the region at hand, and whether it went on
    for b in batches:
        k, r, i, run = (np.asarray(b.column(c)) for c in range(4))
        known = r == 0
        if known.any():
            yield _rows(1, k[known], i[known], run[known])
            k, r, i, run = (x[~known] for x in (k, r, i, run))
        if not len(k):
            continue
        carried = last is not None
        if carried:
            k, r, i, run = (np.concatenate(([x], y)) for x, y in zip(last, (k, r, i, run)))
        head = np.ones(len(k), bool)
        head[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        rep = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
        gone = ~head & ((i != i[rep]) | (run != run[rep]))
        yield _rows(1, k[gone], i[gone], run[gone])
        c = np.flatnonzero(head)
        same = np.zeros(len(c) + 1, bool)
        same[1:-1] = k[c][1:] == k[c][:-1]
        many = same[:-1] | same[1:] | ((run[c] & 0x8000) > 0)
        show = many.copy()
        if carried and shown:
            show[0] = False
        yield _rows(0, k[c[show]], i[c[show]], run[c[show]])
        shown = bool(many[-1]) or (carried and shown and len(c) == 1)
        last = tuple(x[c[-1]] for x in (k, r, i, run))


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words (n, m), and the number of each sorted row's group of equal rows.

    Multikey quicksort by columns: each column is sorted only within the groups that all columns before left tied.
    """
    n, m = words.shape
    order, group, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for level in range(m):
        if not len(tied):
            break
        rows = order[tied]
        key = words[rows, level]
        o = np.lexsort((key, group[tied]))
        order[tied] = rows[o]
        key, g = key[o], group[tied]
        step = np.zeros(len(tied), bool)
        step[1:] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        # a group's number is the place of its first row
        start = np.ones(len(tied), bool)
        start[1:] = (g[1:] != g[:-1]) | step[1:]
        group[tied] = tied[np.maximum.accumulate(np.where(start, np.arange(len(tied)), 0))]
        size = np.bincount(group[tied], minlength=n)
        tied = tied[size[group[tied]] > 1]
    return order, group


def _windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The windows data[s:s+length] as rows of big-endian 8-byte words."""
    words = -(-length // 8)
    if len(data) < length:
        return np.zeros((0, words), ">u8")
    view = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
    out = np.zeros((len(starts), words * 8), np.uint8)
    out[:, :length] = view
    return out.view(">u8")


def _with_texts(src: DataFrame, runs: DataFrame, what, shape: str) -> DataFrame:
    """what, given batches (i, t, runs) of the texts that have runs; texts and runs meet in one shuffle by document."""

    def meet(batches):
        own_i, own = np.zeros(0, np.int64), np.zeros(0, np.int64)  # runs of the last document so far
        for b in batches:
            i, is_run = np.asarray(b.column(0)), np.asarray(b.column(2).is_valid())
            own_i, own = np.concatenate((own_i, i[is_run])), np.concatenate((own, np.asarray(b.column(2).drop_null())))
            at = np.flatnonzero(~is_run)
            lo, hi = np.searchsorted(own_i, i[at], "left"), np.searchsorted(own_i, i[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            if len(at):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hi - lo)), pa.int32()), pa.array(own[C.ranges(lo, hi - lo)], pa.int64()))
                yield from what(pa.RecordBatch.from_arrays([pa.array(i[at], pa.int64()), b.column(1).take(pa.array(at)), lists], names=["i", "t", "runs"]))
            if len(i):
                z = int(np.searchsorted(own_i, i[-1], "left"))
                own_i, own = own_i[z:], own[z:]

    both = src.select("i", "t", F.lit(None).cast("bigint").alias("run")).unionAll(runs.select("i", F.lit(None).cast("string"), "run"))
    return both.repartition("i").sortWithinPartitions("i", F.col("run").asc_nulls_last()).mapInArrow(meet, shape)


def _by_document(rows: DataFrame, column: str, merge, shape: str) -> DataFrame:
    """rows (i, column), by document: merge gets tables of sorted rows, each of whole documents."""

    def whole(batches):
        held = []
        for b in batches:
            i = np.asarray(b.column(0))
            z = int(np.searchsorted(i, i[-1], "left")) if len(i) else 0  # the last document may go on
            if z:
                yield from merge(pa.Table.from_batches([*held, b.slice(0, z)]))
                held = []
            held.append(b.slice(z))
        if sum(b.num_rows for b in held):
            yield from merge(pa.Table.from_batches(held))

    return rows.select("i", column).repartition("i").sortWithinPartitions("i", column).mapInArrow(whole, shape)


def _united(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row a document with its spans, sorted, disjoint and not touching: start, end, start, end, ..."""
    i, span = t.column(0).to_numpy(), t.column(1).to_numpy()
    s, e = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
    new = np.ones(len(i), bool)
    new[1:] = i[1:] != i[:-1]
    doc = np.cumsum(new) - 1
    reach = np.maximum.accumulate(e + (doc << 33)) - (doc << 33)  # the furthest end so far in the document
    cut = new.copy()
    cut[1:] |= s[1:] > reach[:-1]
    a = np.flatnonzero(cut)
    z = np.append(a[1:], len(i)) - 1
    first = np.flatnonzero(new[a])
    flat = np.stack([s[a], reach[z]], 1).ravel()
    yield pa.RecordBatch.from_arrays([pa.array(i[a][first], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(2 * first, len(flat)), pa.int32()), pa.array(flat, pa.int64()))], names=["i", "all"])


def _runs_by_row(b, length: int):
    """Of a batch (i, t, runs), piece by piece: text bytes, ids, and the runs with their text's offset; runs beyond their text belong to another text with this id."""
    for lo, hi in C.pieces(b.column(1)):
        data, off = C.texts(b.column(1).slice(lo, hi - lo))
        runs = b.column(2).slice(lo, hi - lo)
        row = np.repeat(np.arange(hi - lo), np.diff(np.asarray(runs.offsets)))
        s, n, d = unpack(np.asarray(runs.flatten()))
        ok = s + n - 1 + length <= np.diff(off)[row]
        yield data, np.asarray(b.column(0))[lo:hi][row[ok]], off[row[ok]], s[ok], n[ok], d[ok]


def _blocks(data: np.ndarray, off: np.ndarray, s: np.ndarray, n: np.ndarray, d: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Blocks of the runs: the run of each, first window and number of windows, distance to the anchor, hashes of the windows' common part and of their bytes."""
    low, high = (d - n + 1) // BLOCK, d // BLOCK  # of the distances from window to anchor
    who = np.repeat(np.arange(len(n)), high - low + 1)
    block = C.ranges(low, high - low + 1)
    at = (off + s + d)[who]
    first, last = at - np.minimum(d[who], block * BLOCK + BLOCK - 1), at - np.maximum((d - n + 1)[who], block * BLOCK)
    prefix = C.prefix_hash(data)
    with np.errstate(over="ignore"):
        key = C.mix(C.span_hash(prefix, at - block * BLOCK, at - block * BLOCK - BLOCK + 1 + length) + block.astype(np.uint64))
        region = C.mix(C.span_hash(prefix, first, last + length) + (at - first).astype(np.uint64))
    return who, first - off[who], last - first + 1, at - first, key, np.where(region == 0, np.uint64(1), region)


def hot_keys(src: DataFrame, length: int, gram: int) -> np.ndarray:
    """Sorted hashes of the anchors and of the blocks' common parts that many documents of a bounded, hashed sample hold."""
    step = max(1, src.count() // SAMPLE)

    def keys(batches):
        for b in batches:
            for lo, hi in C.pieces(b.column(0)):
                data, off = C.texts(b.column(0).slice(lo, hi - lo))
                first, count, at, anchor, _ = runs_of(data, off, length, gram)
                doc = np.searchsorted(off, first, "right") - 1
                who, _, _, _, key, _ = _blocks(data, off[doc], first - off[doc], count, at - first, length)
                both = np.stack([np.concatenate((doc, doc[who])), np.concatenate((anchor, key)).view(np.int64)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(both, axis=0)[:, 1], pa.int64())], names=["key"])

    sample = src.where(F.pmod(F.xxhash64("i", F.lit(29)), F.lit(step)) == 0).select("t")
    found = sample.mapInArrow(keys, "key bigint").groupBy("key").count().where(F.col("count") >= HOT).select("key").toArrow()
    return np.sort(found.column("key").to_numpy())


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(i, spans): sorted, disjoint and not touching byte spans to remove, by document: start, end, start, end, ..."""
    if not 8 <= length <= MAX_LENGTH:
        raise ValueError(f"length must be 8 to {MAX_LENGTH}")
    gram = min(GRAM, length)
    src = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("i"), F.col(f"`{text_col}`").alias("t"))
    hot = src.sparkSession.sparkContext.broadcast(hot_keys(src, length, gram))  # bounded by the sample

    def apart(key, region, i, run):
        """Rows of a piece of text; those with a hot key go by their region as well, and are marked."""
        many = np.isin(key.view(np.int64), hot.value)
        return _pass_repeats(np.where(many, C.mix(key ^ region), key), region, i, run | np.where(many, 0x8000, 0))

    def anchors(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for lo, hi in C.pieces(b.column(1)):
                data, off = C.texts(b.column(1).slice(lo, hi - lo))
                first, count, at, anchor, region = runs_of(data, off, length, gram)
                d = np.searchsorted(off, first, "right") - 1
                yield apart(anchor, region, ids[lo:hi][d], pack(first - off[d], count, at - first))

    def blocks(b):
        for data, i, off, s, n, d in _runs_by_row(b, length):
            who, first, count, to_anchor, key, region = _blocks(data, off, s, n, d, length)
            yield apart(key, region, i[who], pack(first, count, to_anchor))

    def windows(b):
        for data, i, off, s, n, _ in _runs_by_row(b, length):
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PORTION, "right")))
                who = np.repeat(np.arange(a, z), n[a:z])
                at = C.ranges(s[a:z], n[a:z])
                yield from _settle(_windows(data, off[who] + at, length), i[who], at, length)
                a = z

    def buckets(batches):
        """Rows in order of lead; a bucket's least and greatest window leave as kind 2."""
        held, size, ends = [], 0, [None, None]

        def flush(t):
            raw = t.column("win").combine_chunks()
            win = np.zeros((t.num_rows, -(-length // 8) * 8), np.uint8)
            win[:, :length] = _bytes(raw)[0].reshape(-1, length)
            for out in _settle(win.view(">u8"), t.column("i").to_numpy(), t.column("s").to_numpy(), length):
                kept = out.filter(pc.equal(out.column("kind"), 0))  # in order of the windows, each one's earliest
                if kept.num_rows:
                    for k, row, better in ((0, 0, min), (1, kept.num_rows - 1, max)):
                        new = tuple(kept.column(c)[row].as_py() for c in ("win", "i", "s"))
                        ends[k] = new if ends[k] is None else better(ends[k], new, key=lambda x: x[0])
                yield out.filter(pc.equal(out.column("kind"), 1))

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PORTION:
                t = pa.Table.from_batches(held)
                lead = t.column("lead").to_numpy()
                z = int(np.searchsorted(lead, lead[-1], "left"))  # the last lead may go on
                if z:
                    yield from flush(t.slice(0, z))
                    held, size = t.slice(z).to_batches(), t.num_rows - z
        if size:
            yield from flush(pa.Table.from_batches(held))
        for win, i, s in {x for x in ends if x}:
            yield _spans(2, np.array([i]), np.array([s]), length, [win])

    shape = "key bigint, region bigint, i bigint, run bigint"
    firsts = lambda rows: rows.repartition("key").sortWithinPartitions("key", "region", "i", "run").mapInArrow(_first_of_regions, ROWS)
    found = C.written(firsts(src.mapInArrow(anchors, shape)), "suffix-runs")
    parts = C.written(firsts(_with_texts(src, found.where("kind = 0"), blocks, shape)), "suffix-blocks")
    sufs = C.written(_with_texts(src, parts.where("kind = 0"), windows, SPANS), "suffix-windows")
    lead = F.conv(F.hex(F.substring("win", 1, 7)), 16, 10).cast("bigint")
    ends = sufs.where("kind = 0").select("win", "i", "s", lead.alias("lead")).repartitionByRange("win", "i", "s").sortWithinPartitions("lead").mapInArrow(buckets, SPANS)
    same = Window.partitionBy("kind", F.when(F.col("kind") == 2, F.xxhash64("win")).otherwise(F.xxhash64("i", "s")), "win")  # of the windows at edges, two a bucket
    ends = ends.withColumn("first", F.min(F.struct("i", "s")).over(same)).where("kind = 1 or first <> struct(i, s)")
    one = lambda s, n: (F.shiftleft(s, 32) + n).alias("span")
    spans = [rows.select("i", one(F.col("s"), F.col("e") - F.col("s"))) for rows in (sufs.where("kind = 1"), ends)]
    for rows in (found, parts):
        spans.append(rows.where("kind = 1").select("i", one(F.shiftright("run", 32), F.shiftright("run", 16).bitwiseAND(0xFFFF) - 1 + length)))
    return _by_document(reduce(DataFrame.unionAll, spans), "span", _united, "i bigint, all array<bigint>").withColumnRenamed("all", "spans")


SPANS = "kind tinyint, i bigint, s bigint, e bigint, win binary"


def _spans(kind: int, i: np.ndarray, s: np.ndarray, length, win) -> pa.RecordBatch:
    text = pa.nulls(len(i), pa.binary()) if win is None else pa.array(win, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind), pa.int8()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(s + length, pa.int64()), text], names=["kind", "i", "s", "e", "win"])


def _settle(win: np.ndarray, i: np.ndarray, s: np.ndarray, length: int):
    """Of windows: the earliest of equal ones, in order of the windows (kind 0), and the spans of the others (kind 1)."""
    if not len(win):
        return
    order, group = multikey_sort(win)
    by = np.lexsort((s[order], i[order], group))
    order, group = order[by], group[by]
    head = np.ones(len(order), bool)
    head[1:] = group[1:] != group[:-1]
    rep = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    ii, ss = i[order], s[order]
    gone = ~head & ((ii != ii[rep]) | (ss != ss[rep]))
    raw = np.ascontiguousarray(win[order[head]].view(np.uint8).reshape(-1, win.shape[1] * 8)[:, :length])
    off = np.arange(len(raw) + 1, dtype=np.int32) * length
    step = max(1, (1 << 30) // length)
    for a in range(0, len(raw), step):  # offsets of 32 bits
        n = len(raw[a : a + step])
        text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off[: n + 1]), pa.py_buffer(raw[a : a + step])])
        yield _spans(0, ii[head][a : a + n], ss[head][a : a + n], length, text)
    if gone.any():  # as few spans as cover them
        i, s = ii[gone], ss[gone]
        o = np.lexsort((s, i))
        i, s = i[o], s[o]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1] + 1)
        a = np.flatnonzero(new)
        yield _spans(1, i[a], s[a], length + s[np.append(a[1:], len(s)) - 1] - s[a], None)


def _bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, kept: str = "kept", prefix: str = "") -> DataFrame:
    """docs with the remaining bytes in column kept (binary), and prefix + n_bytes, n_removed, n_spans."""
    spans = removed_spans(docs, id_col=id_col, text_col=text_col, length=length).withColumnRenamed("i", "__sd_i").withColumnRenamed("spans", "__sd_spans")
    shape = "struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint>"

    @F.arrow_udf(shape)
    def apply(col: pa.Array, spans: pa.Array) -> pa.Array:
        cols = [[], [], [], []]
        for t, sp in zip(col, spans):
            raw = (t.as_py() or "").encode()
            keep, at, removed, n = [], 0, 0, 0
            v = sp.as_py() or []
            for x, y in zip(v[::2], v[1::2]):
                y = min(y, len(raw))  # the spans of another text with this id may be longer
                if x < y:
                    keep.append(raw[at:x])
                    at, removed, n = y, removed + y - x, n + 1
            keep.append(raw[at:])
            for c, x in zip(cols, (b"".join(keep), len(raw), removed, n)):
                c.append(x)
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["kept", "n_bytes", "n_removed", "n_spans"])

    both = docs.join(spans, F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)) == F.col("__sd_i"), "left").withColumn("__sd", apply(F.col(f"`{text_col}`"), F.col("__sd_spans")))
    return both.withColumns({kept: F.col("__sd.kept")} | {prefix + n: F.col(f"__sd.{n}") for n in ("n_bytes", "n_removed", "n_spans")}).drop("__sd", "__sd_spans", "__sd_i")
