"""Benchmark decontamination by suffix arrays over shards of the training texts.

The benchmark's words are numbered; a text's word outside that vocabulary is 0 and matches nothing. Every Arrow batch
of training texts (2 MB at most, or one longer text) is a shard: its word suffixes that can match at all - those whose
leading words are a benchmark n-gram, of any test suffix - are sorted into a suffix array by their first ``window``
words, and every test suffix, the last of each item too, is binary-searched in it, all together: the shard's occurrences
of every window with their places, and the longest match of every training suffix, which is with one of its neighbours among
the test suffixes. Matches of a whole window go on, in the tests' full suffix array, without any bound on the length. Matches
never cross documents. No shuffle, one pass over whole texts.

The test side is read in blocks of at most ``block_bytes`` of text and each block is broadcast by itself; with more than
one block, the hits of equal rows (of one id and one text) are united afterwards.

Defined results: a null text has no words; an item without words has no window; an item of fewer than ``window`` words
is one window; equal items count apiece; spans are the matches of a window's words at least, as long as they go, and the
occurrences of shorter items, without those that lie in another; an item and its place of several is named; every row is judged
by its own text, whatever other rows have its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm import common as C


def _item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    low, starts, ends, _ = C.words(data, np.array([0, len(data)]))
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


class Tests:
    """A block of benchmark items: numbered words, the windows, and which items each window belongs to."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window = window
        split = [(i, w) for i, t in items if (w := _item_words(t))]
        vocab = {w: n + 1 for n, w in enumerate(sorted({x for _, w in split for x in w}))}
        raw = np.frombuffer(b"".join(vocab), np.uint8)
        sizes = np.array([len(w) for w in vocab], np.int64)
        ends = np.cumsum(sizes)
        h = C.span_hash(C.prefix_hash(raw), ends - sizes, ends) if vocab else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.word_hash, self.word_id = h[order], (order + 1).astype(np.int64)
        self.bits = max(1, int(len(vocab)).bit_length())
        seen: dict[tuple[int, ...], set] = {}
        for i, w in split:
            ids = [vocab[x] for x in w]
            for a in range(max(1, len(ids) - window + 1)):
                seen.setdefault(tuple(ids[a : a + window]), set()).add(i)
        self.windows = sorted(seen)
        self.items = [sorted(seen[w], key=str) for w in self.windows]
        self.lead = min([2, *map(len, self.windows)])
        # Every test suffix (for the longest matches) as a row of at most window words, 0 beyond its end.
        coded = [[vocab[x] for x in w] for _, w in split]
        sufs = sorted({tuple(ids[a : a + window]) for ids in coded for a in range(len(ids))})
        self.grams = np.unique(np.array([self._lead(s) for s in sufs if len(s) >= self.lead], np.int64))
        self.sufs = np.zeros((len(sufs), window), np.int64)
        for r, s in enumerate(sufs):
            self.sufs[r, : len(s)] = s
        place = {s: r for r, s in enumerate(sufs)}
        self.win_at = np.array([place[w] for w in self.windows], np.int64)
        self.suf_keys = self.pack(self.sufs)  # from the least to the greatest suffix that begins with the words of a row
        self.suf_ends = self.pack(np.where(self.sufs > 0, self.sufs, (1 << self.bits) - 1))
        self.win_len = np.array([len(w) for w in self.windows], np.int64)
        self.names = [str(i) for i, _ in split]
        self.starts = np.cumsum([0, *map(len, coded)])
        self.flat = np.array([x for ids in coded for x in ids], np.int64)
        self.left = np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(len(self.flat))
        self.sa = _suffix_array(self.flat, self.left)
        self.prefix = C.prefix_hash(self.flat)

    def _lead(self, w) -> int:
        return w[0] if self.lead == 1 else (w[0] << self.bits) | w[1]

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Rows of word numbers as few big-endian integers, whose order is that of the rows."""
        per = max(1, 62 // self.bits)
        cols = []
        for a in range(0, rows.shape[1], per):
            key = np.zeros(len(rows), np.int64)
            for j in range(a, min(a + per, rows.shape[1])):
                key = (key << self.bits) | rows[:, j]
            cols.append(key)
        return np.stack(cols, 1) if cols else np.zeros((len(rows), 0), np.int64)


def _bisect(sa: np.ndarray, keys: np.ndarray, right: bool) -> np.ndarray:
    """Places of the key rows among the sorted rows sa, for all keys at once."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(sa), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        row = sa[np.minimum(mid, len(sa) - 1)]
        less, equal = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for c in range(keys.shape[1]):
            less |= equal & (row[:, c] < keys[:, c])
            equal &= row[:, c] == keys[:, c]
        go = (less | equal) if right else less
        lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def _suffix_array(ids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in order of the whole suffixes, each of left words, by prefix doubling; equal ones by place."""
    rank, step, n = ids, 1, len(ids)
    while n and step < left.max():
        after = np.where(left > step, rank[np.minimum(np.arange(n) + step, n - 1)], 0)
        rank = np.unique(rank * (max(n, int(rank.max())) + 1) + after, return_inverse=True)[1] + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def _common(tests: Tests, prefix: np.ndarray, p: np.ndarray, size: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Words that the training suffixes at p, cut to size, and the test suffixes at q have in common."""
    lo, hi = np.zeros(len(p), np.int64), np.minimum(size, tests.left[q])
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = C.span_hash(prefix, p, p + mid) == C.span_hash(tests.prefix, q, q + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def _verbatim(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the first size words at a[p] and b[q] are equal, word by word: hashes only proposed them."""
    differ = a[C.ranges(p, size)] != b[C.ranges(q, np.minimum(size, len(b) - q))] if (q + size <= len(b)).all() else None
    if differ is None:
        return np.array([int(np.argmin(np.append(a[i : i + n] == b[j : j + n] if j + n <= len(b) else False, False))) for i, j, n in zip(p, q, size)], np.int64)
    start = np.cumsum(size) - size
    bad = np.flatnonzero(differ)
    first = np.append(bad, len(differ))[np.searchsorted(bad, start)]
    return np.minimum(first - start, size)


def _lower(tests: Tests, ids: np.ndarray, prefix: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First places in the tests' suffix array whose suffix is not before the training suffix at p, cut to size."""
    lo, hi = np.zeros(len(p), np.int64), np.full(len(p), len(tests.sa), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        q = tests.sa[np.minimum(mid, len(tests.sa) - 1)]
        n = _common(tests, prefix, p, size, q)
        end = n == tests.left[q]
        less = (n < size) & (end | (tests.flat[np.where(end, q, q + n)] < ids[p + n]))
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def search(tests: Tests, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[set], np.ndarray, list[list[dict]]]:
    """Of the texts of one shard: number of words, hit word numbers, items hit, length of the longest match, spans."""
    low, starts, ends, before = C.words(data, off)
    n_texts, w = len(off) - 1, tests.window
    hits, items = [np.zeros(0, np.int64)] * n_texts, [set() for _ in range(n_texts)]
    full, spans = np.zeros(n_texts, np.int64), [[] for _ in range(n_texts)]
    n_words = np.diff(before)
    if not len(starts) or not len(tests.windows):
        return n_words, hits, items, full, spans
    h = C.span_hash(C.prefix_hash(low), starts, ends)
    at = np.minimum(np.searchsorted(tests.word_hash, h), len(tests.word_hash) - 1)
    ids = np.where(tests.word_hash[at] == h, tests.word_id[at], 0)
    ids = np.concatenate((ids, np.zeros(w, np.int64)))
    doc = np.repeat(np.arange(n_texts), n_words)
    left = before[1:][doc] - np.arange(len(doc))  # words from here to the text's end
    if tests.lead == 1:
        lead = ids[:-w]
        ok = lead > 0
    else:
        lead = (ids[:-w] << tests.bits) | ids[1 : len(ids) - w + 1]
        ok = (ids[:-w] > 0) & (left > 1)
    lead_at = np.minimum(np.searchsorted(tests.grams, lead), len(tests.grams) - 1)
    suf = np.flatnonzero(ok & (tests.grams[lead_at] == lead))
    np.maximum.at(full, doc, (ids[:-w] > 0).astype(np.int64))
    if not len(suf):
        return n_words, hits, items, full, spans
    rows = ids[suf[:, None] + np.arange(w)]
    rows[np.arange(w) >= left[suf][:, None]] = 0
    keys = tests.pack(rows)
    order = np.lexsort(keys.T[::-1])
    sa, keys, rows = suf[order], keys[order], rows[order]  # the suffix array of the shard
    # Every test suffix is searched in the array: what lies between two of them has them for neighbours, the nearest of all.
    lo, hi = _bisect(keys, tests.suf_keys, False), _bisect(keys, tests.suf_ends, True)
    place = np.searchsorted(lo, np.arange(len(sa)), "right")
    best = np.zeros(len(sa), np.int64)
    for near in (place - 1, place):
        okn = (near >= 0) & (near < len(tests.sufs))
        same = (tests.sufs[np.clip(near, 0, len(tests.sufs) - 1)] == rows) & (rows > 0)
        best = np.maximum(best, np.where(okn, np.cumprod(same, 1).sum(1), 0))
    # What matches a whole window goes on as far as known words of the text do.
    long = np.flatnonzero(best == w)
    prefix, p = C.prefix_hash(ids), sa[long]
    stop = np.flatnonzero(ids == 0)
    known = np.minimum(left[p], stop[np.searchsorted(stop, p)] - p)
    place = _lower(tests, ids, prefix, p, known)
    for near in (place - 1, place):
        n = _common(tests, prefix, p, known, tests.sa[np.clip(near, 0, len(tests.sa) - 1)])
        best[long] = np.maximum(best[long], n)
    short_of = best < w
    np.maximum.at(full, doc[sa[short_of]], best[short_of])
    size = np.zeros(len(doc), np.int64)
    size[p] = best[long]
    lo, hi = lo[tests.win_at], hi[tests.win_at]
    hit_at = sa[C.ranges(lo, hi - lo)]  # every occurrence of every window
    which = np.repeat(np.arange(len(lo)), hi - lo)
    flags = np.zeros(len(doc), bool)
    flags[C.ranges(hit_at, tests.win_len[which])] = True
    at = np.flatnonzero(flags)
    for d in np.unique(doc[at]):
        hits[d] = at[slice(*np.searchsorted(at, before[d : d + 2]))] - before[d]
    for d, k in np.unique(np.stack([doc[hit_at], which], 1), axis=0).tolist():
        items[d].update(tests.items[k])
    short = tests.win_len[which] < w
    np.maximum.at(size, hit_at[short], tests.win_len[which[short]])
    end = np.maximum.accumulate(np.arange(len(doc)) + size)
    p = np.flatnonzero((size > 0) & (np.diff(end, prepend=-1) > 0))
    q = tests.sa[np.minimum(_lower(tests, ids, prefix, p, size[p]), len(tests.sa) - 1)]
    size[p] = _verbatim(ids, p, tests.flat, q, size[p])
    p, q = p[size[p] > 0], q[size[p] > 0]
    np.maximum.at(full, doc[p], size[p])
    item = np.searchsorted(tests.starts, q, "right") - 1
    for d, a, n, k, b in zip(doc[p].tolist(), (p - before[doc[p]]).tolist(), size[p].tolist(), item.tolist(), (q - tests.starts[item]).tolist()):
        spans[d].append({"start": a, "n_words": n, "item": tests.names[k], "item_start": b})
    return n_words, hits, items, full, spans


def _digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SPANS = "array<struct<start: bigint, n_words: bigint, item: string, item_start: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))


def _outer(spans: list[dict]) -> list[dict]:
    """The spans that lie in no other."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["n_words"], s["item"], s["item_start"])):
        if s["start"] + s["n_words"] > end:
            out.append(s)
            end = s["start"] + s["n_words"]
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t or "") + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20, prefix: str = "") -> DataFrame:
    """docs with columns (each named prefix + name) n_words, n_hit, n_items, items_sha256, contaminated, longest_match, spans.

    longest_match is the longest verbatim match with a benchmark text, in words. spans has the matches as (start, n_words, item, item_start), in words.
    """
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(Tests(b, window)) for b in blocks(benchmark, item_col, item_text_col, block_bytes)]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "spans"]
    text = F.col(f"`{text_col}`")

    def shards(col, tests):
        for lo, hi in C.pieces(col):
            data, off = C.texts(col.slice(lo, hi - lo))
            yield search(tests, data, off)

    if len(sent) <= 1:
        tests = sent[0] if sent else spark.sparkContext.broadcast(Tests([], window))

        @F.arrow_udf("struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, longest_match: bigint, spans: " + SPANS + ">")
        def judge(col: pa.Array) -> pa.Array:
            cols = [[] for _ in names]
            for n_words, hits, items, full, spans in shards(col, tests.value):
                for c, v in zip(cols, (n_words.tolist(), [len(h) for h in hits], [len(i) for i in items], [_digest(list(i)) for i in items], [len(h) > 0 for h in hits], full.tolist(), spans)):
                    c += v
            return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), _SPANS))], names)

        out = docs.withColumn("__judged", judge(text))
        return out.withColumns({prefix + n: F.col(f"__judged.{n}") for n in names}).drop("__judged")

    @F.arrow_udf("struct<hits: array<bigint>, items: array<string>, full: bigint, spans: " + SPANS + ">")
    def part(col: pa.Array, block: pa.Array) -> pa.Array:
        cols = [[], [], [], []]
        if len(col):
            for _, hits, items, full, spans in shards(col, sent[block[0].as_py()].value):
                for c, v in zip(cols, ([h.tolist() for h in hits], [sorted(map(str, i)) for i in items], full.tolist(), spans)):
                    c += v
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), _SPANS))], ["hits", "items", "full", "spans"])

    ident = F.struct(F.col(f"`{id_col}`"), F.sha2(text, 256))  # equal rows have equal results
    some = None
    for k in range(len(sent)):
        one = docs.select(ident.alias("__i"), part(text, F.lit(k)).alias("p")).where("p.full > 0")
        some = one if some is None else some.unionAll(one)
    by_doc = some.groupBy("__i").agg(F.array_distinct(F.flatten(F.collect_list("p.hits"))).alias("__dc_h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p.items")))).alias("__dc_it"), F.max("p.full").alias("__dc_f"), F.flatten(F.collect_list("p.spans")).alias("__dc_s"))

    @F.arrow_udf(SPANS)
    def outer(col: pa.Array) -> pa.Array:
        return pa.array([_outer(s or []) for s in col.to_pylist()], _SPANS)

    @F.arrow_udf("bigint")
    def count(col: pa.Array) -> pa.Array:
        return pa.array([n for lo, hi in C.pieces(col) for n in np.diff(C.words(*C.texts(col.slice(lo, hi - lo)))[3]).tolist()], pa.int64())

    both = docs.join(by_doc, ident.eqNullSafe(F.col("__i")), "left")
    made = {"n_words": count(text), "n_hit": F.coalesce(F.size("__dc_h"), F.lit(0)).cast("bigint"), "n_items": F.coalesce(F.size("__dc_it"), F.lit(0)).cast("bigint"), "items_sha256": F.sha2(F.coalesce(F.array_join("__dc_it", ","), F.lit("")), 256), "contaminated": F.coalesce(F.size("__dc_h"), F.lit(0)) > 0, "longest_match": F.coalesce("__dc_f", F.lit(0)), "spans": outer(F.col("__dc_s"))}
    return both.withColumns({prefix + n: made[n] for n in names}).drop("__i", "__dc_h", "__dc_it", "__dc_f", "__dc_s")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows; all columns stay as they are."""
    return contamination(docs, benchmark, prefix="__dc_", **options).where("not __dc_contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
