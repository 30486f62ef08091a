"""Frozen models: compressed sparse rows in flat arrays, through which all walks of a batch take a step together.

A state is two integers: the digest of its words, or its packed word ids. Rows are sorted by them; each entry of a row has the
follower's id, the sum of the weights up to it, and the row of the state that it leads to, so a walk never looks a state up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: In place of a successor's row: the run ends here, or the model lacks the state.
ENDS, LACKS = -1, -2
STATUS = pa.array(["end", "dead", "cut"])


def bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For each of many ranges [lo, hi) of ascending values: the first place with a value > x (right) or >= x; hi if none."""
    lo, hi = lo.copy(), hi.copy()
    at = np.flatnonzero(lo < hi)
    while len(at):
        mid = (lo[at] + hi[at]) >> 1
        up = values[mid] <= x[at] if right else values[mid] < x[at]
        lo[at[up]] = mid[up] + 1
        hi[at[~up]] = mid[~up]
        at = at[lo[at] < hi[at]]
    return lo


def row_sums(weights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums within each row start[i]:start[i + 1], added in order from the row's first: the same doubles as one row's own sum."""
    out = weights.astype(np.float64)
    degree = np.diff(start)
    rows = np.argsort(-degree, kind="stable")
    falling = -degree[rows]
    j = 1
    while (n := int(np.searchsorted(falling, -j, "left"))) > 16:  # rows with more than j entries
        at = start[rows[:n]] + j
        out[at] += out[at - 1]
        j += 1
    for r in rows[:n]:
        a, z = start[r] + j - 1, start[r + 1]
        out[a:z] = np.cumsum(out[a:z])
    return out


def row_order(hi: np.ndarray, lo: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Order by (hi, lo, follow). One of hi and lo mostly tells all: digests differ in hi, small packed states have hi 0."""
    first, second = (lo, hi) if len(hi) and (hi == hi[0]).all() else (hi, lo)
    order = np.argsort(follow, kind="stable")
    order = order[np.argsort(first[order], kind="stable")]
    a, b = first[order], second[order]
    return order if not ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else np.lexsort((follow, lo, hi))


def halves(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two positive integers from 16-byte digests."""
    if isinstance(digests, pa.ChunkedArray):
        digests = digests.combine_chunks()
    off = np.frombuffer(digests.buffers()[1], np.int32)[digests.offset :][: len(digests) + 1] if len(digests) else np.zeros(1, np.int32)
    raw = np.frombuffer(digests.buffers()[2], ">u8", count=2 * len(digests), offset=int(off[0])) if len(digests) else np.zeros(0, ">u8")
    both = (raw.astype(np.uint64) >> np.uint64(1)).astype(np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class Frozen:
    """The payload of the broadcast walker. words: the words by id, or None where ids are what is wanted."""

    def __init__(self, hi, lo, start, follow, cum, after, words):
        self.hi, self.lo, self.start, self.follow, self.cum, self.after, self.words = hi, lo, start, follow, cum, after, words

    @staticmethod
    def build(hi, lo, follow, n, next_hi, next_lo, end, power: float, words=None) -> Frozen:
        """From one entry a transition, in any order: the state's and its successor's keys, the follower's id (in the order in which followers are summed) and count."""
        order = row_order(hi, lo, follow)
        hi, lo, follow, n = hi[order], lo[order], follow[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))) if len(hi) else np.zeros(0, np.int64)
        start = np.append(new, len(hi)).astype(np.int64)
        cum = row_sums(n.astype(np.float64) if power == 1.0 else n.astype(np.float64) ** power, start)
        out = Frozen(hi[new], lo[new], start, follow, cum, None, words)
        after = out.rows(next_hi[order], next_lo[order])
        after[follow == end] = ENDS
        out.after = after.astype(np.int32 if len(new) < 1 << 31 else np.int64)
        return out

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hi, self.lo, self.start, self.follow, self.cum, self.after)) + (self.words.nbytes if self.words is not None else 0)

    def rows(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The row of each state, LACKS if there is none."""
        first, second, q, q2 = (self.hi, self.lo, hi, lo) if len(self.hi) and self.hi[0] != self.hi[-1] else (self.lo, self.hi, lo, hi)
        order = np.argsort(q)  # in order, the search stays in the cache
        at = np.empty(len(q), np.int64)
        at[order] = np.searchsorted(first, q[order], "left")
        if len(first) and (first[1:] == first[:-1]).any():  # several states share the first integer
            z = np.empty(len(q), np.int64)
            z[order] = np.searchsorted(first, q[order], "right")
            at = bisect(second, at, z, q2, False)
        found = at < len(first)
        found[found] = (first[at[found]] == q[found]) & (second[at[found]] == q2[found])
        return np.where(found, at, LACKS)

    def run(self, seed: int, walk_id: np.ndarray, attempt: np.ndarray, row: np.ndarray, step: np.ndarray, max_steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All walks, each at a row and a step, until they end, are cut or come to a state that is not here: (walk, follower id) of all words in order, and the status of each walk.

        One roll a step, of which states with one follower need none.
        """
        status = np.full(len(row), 1, np.int8)
        live = np.flatnonzero(row >= 0)
        at, step, went, said = row[live].astype(np.int64), step[live], [], []
        while len(live):
            first, stop = self.start[at], self.start[at + 1]
            pick, many = first.copy(), np.flatnonzero(stop - first > 1)
            if len(many):
                who = live[many]
                digests = (hashlib.md5(b"%d:%d:%d:%d" % (seed, w, a, s)).digest() for w, a, s in zip(walk_id[who].tolist(), attempt[who].tolist(), step[many].tolist()))
                u = np.fromiter((int.from_bytes(d[:7], "big") >> 4 for d in digests), np.float64, len(who)) / 4503599627370496
                last = stop[many] - 1
                pick[many] = np.minimum(bisect(self.cum, first[many], stop[many], u * self.cum[last], True), last)
            after = self.after[pick]
            status[live[after == ENDS]] = 0
            cut = (after != ENDS) & (step >= max_steps)
            status[live[cut]] = 2
            on = (after != ENDS) & ~cut
            live, at, pick, step = live[on], after[on].astype(np.int64), pick[on], step[on] + 1
            went.append(live)
            said.append(self.follow[pick])
            live, at, step = live[at >= 0], at[at >= 0], step[at >= 0]
        if not went:
            return np.zeros(0, np.int64), np.zeros(0, self.follow.dtype), status
        went, said = np.concatenate(went), np.concatenate(said)
        order = np.argsort(went, kind="stable")
        return went[order], said[order], status

    def named(self, ids: np.ndarray) -> pa.Array:
        return self.words.take(pa.array(ids)) if self.words is not None else pa.array(ids, pa.int64())

    def walk(self, seed: int, walk_id: np.ndarray, attempt: np.ndarray, row: np.ndarray, max_steps: int) -> pa.RecordBatch:
        """walk_id, attempt, words, status of walks that begin in the given rows."""
        went, said, status = self.run(seed, walk_id, attempt, row, np.zeros(len(row), np.int64), max_steps)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(went, minlength=len(row)))))
        words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.named(said))
        return pa.record_batch([pa.array(walk_id, pa.int64()), pa.array(attempt, pa.int32()), words, STATUS.take(pa.array(status))], ["walk_id", "attempt", "words", "status"])
