"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie, with byte fallback.

The pieces come from a SentencePiece model file (never trained here) with their log scores, or, if the file holds merge
ranks instead, with the log scores that Zipf's law gives to those ranks. A text gets a whitespace
marker in front, and each space is one; inside, the marker is the byte 0x20, so that a literal U+2581 of a text goes to
byte fallback and decoding gives every text back exactly. ``encode`` cuts texts where no piece can reach across (a byte
pair that no piece contains), numbers the distinct chunks of a batch, and runs the Viterbi recurrence over all new
chunks at once: position by position, all chunks walk the trie together. In a long chunk all places walk it together. Chunks' results are kept in a bounded cache of
each Python worker. A character that no path of pieces reaches becomes its UTF-8 bytes as byte pieces.

All work is narrow: one pass, no shuffle; the vocabulary is broadcast (its size is that of the model file).

Defined results: a null or empty text has no ids, and no ids decode to an empty text; ids outside the vocabulary and
control ids decode to nothing; bytes that are not UTF-8 after decoding become U+FFFD. Ties: of equal scores the earlier
start (the longer last piece) wins. Rows that repeat are encoded alike. Other columns of the input stay, but a column of the
name that the result gets is replaced.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.llm import common as C

UNK_PENALTY = 10.0
#: Longest chunk that advances together with others, and places of a longer one that walk the trie at once.
LONG, STRETCH = 256, 1 << 16
#: Places of the byte pieces, which come before all others where pieces are ranked.
BYTES = 256
#: Chunks and their bytes that a worker's cache holds before it starts anew; longer chunks are not cached.
CACHE_CHUNKS, CACHE_LONGEST = 1_000_000, 64


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays of a double-array trie over distinct, sorted keys; the root is state 1."""
    size = 1 << 12
    base, check, value = [0] * size, [0] * size, [-1] * size
    check[0] = check[1] = -1
    free_from = 2
    todo = [(1, 0, len(keys), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if len(keys[lo]) == depth:
            value[state] = lo
            lo += 1
        if lo == hi:
            continue
        kids, a = [], lo
        while a < hi:
            c, z = keys[a][depth], a + 1
            while z < hi and keys[z][depth] == c:
                z += 1
            kids.append((c, a, z))
            a = z
        while check[free_from]:
            free_from += 1
            if free_from + 512 > len(check):
                base += [0] * len(base)
                check += [0] * len(check)
                value += [-1] * len(value)
        at, misses = max(free_from, kids[0][0] + 1), 0
        while True:
            b = at - kids[0][0]
            if b + 256 >= len(check):
                base += [0] * len(base)
                check += [0] * len(check)
                value += [-1] * len(value)
            if all(not check[b + c] for c, _, _ in kids):
                break
            at, misses = at + 1, misses + 1
        if misses > 200 and len(kids) == 1:
            free_from = at  # the stretch before is nearly full
        base[state] = b
        for c, _, _ in kids:
            check[b + c] = state
        todo += [(b + c, x, z, depth + 1) for c, x, z in kids]
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class Vocabulary:
    """pieces: bytes by id (None: not ordinary), scores; byte_ids: id of the piece of each byte."""

    pieces: list[bytes | None]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray = None
    check: np.ndarray = None
    value: np.ndarray = None
    unk: float = 0.0
    inside: np.ndarray = None
    out_bytes: np.ndarray = None
    out_off: np.ndarray = None
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        normal = sorted((p, i) for i, p in enumerate(self.pieces) if p)
        ids = np.array([i for _, i in normal], np.int32)
        self.base, self.check, value = double_array([p for p, _ in normal])
        self.value = np.where(value >= 0, ids[np.maximum(value, 0)], -1).astype(np.int32)
        self.unk = float(self.scores[ids].min()) - UNK_PENALTY
        self.inside = np.zeros((256, 256), bool)
        for p, _ in normal:
            q = np.frombuffer(p, np.uint8)
            self.inside[q[:-1], q[1:]] = True
        outs = [p or b"" for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            outs[i] = bytes([b])
        self.out_bytes = np.frombuffer(b"".join(outs), np.uint8)
        self.out_off = np.concatenate(([0], np.cumsum([len(x) for x in outs]))).astype(np.int64)

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, byte_ids = [], np.zeros(256, np.int32)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                pieces.append(None)
            else:
                pieces.append(None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else piece.replace("▁", " ").encode())
        if len(set(byte_ids.tolist())) < 256:
            raise ValueError("the model has no byte pieces")
        scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())], np.float64)
        return Vocabulary(pieces, log_scores(scores, np.array([bool(p) for p in pieces])), byte_ids)


def log_scores(scores: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The scores of a model, as log probabilities of its normal pieces.

    A BPE model's scores are merge ranks (whole numbers, each piece its own), whose sums say nothing about a text: by
    Zipf's law the piece of rank r, after the byte pieces, has a probability in proportion to 1 / (BYTES + r). Nothing is
    trained. A unigram model's scores stay as they are.
    """
    own = scores[normal]
    if not len(own) or (own != np.rint(own)).any() or len(np.unique(own)) * 2 < len(own):
        return scores
    rank = np.empty(len(own))
    rank[np.argsort(-own, kind="stable")] = np.arange(1, len(own) + 1)
    weight = 1 / (BYTES + rank)
    out = scores.copy()
    out[normal] = np.log(weight / weight.sum())
    return out


_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4


def viterbi(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best ids of the chunks data[off[i]:off[i+1]], end to end, and their offsets; all but long chunks advance together."""
    n = np.diff(off)
    if (n > LONG).any():
        short = np.flatnonzero(n <= LONG)
        text, size = gather(data, off, short)
        ids, ends = viterbi(v, text, np.concatenate(([0], np.cumsum(size))))
        parts: list = [None] * len(n)
        for k, a, z in zip(short.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            parts[k] = ids[a:z]
        for k in np.flatnonzero(n > LONG).tolist():
            parts[k] = viterbi_of_one(v, data[off[k] : off[k + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    order = np.argsort(-n, kind="stable")
    size, start = n[order], off[:-1][order]
    cell = np.concatenate(([0], np.cumsum(size + 1)))[:-1]  # DP cells of a chunk: one for each byte boundary
    total = int((size + 1).sum())
    best, back, piece = np.full(total, -np.inf), np.full(total, -1, np.int64), np.full(total, -1, np.int32)
    best[cell] = 0.0
    longest = int(size[0]) if len(size) else 0
    for p in range(longest):
        live = np.arange(np.searchsorted(-size, -p, "left"))  # chunks longer than p
        live = live[best[cell[live] + p] > -np.inf]
        if not len(live):
            continue
        here = best[cell[live] + p]
        width = _CHAR_BYTES[data[start[live] + p]]
        single = np.zeros(len(live), bool)
        state, who, step = np.ones(len(live), np.int64), np.arange(len(live)), 0
        while len(who):
            chunk = live[who]
            ok = p + step < size[chunk]
            if not ok.all():
                who, state, chunk = who[ok], state[ok], chunk[ok]
                if not len(who):
                    break
            nxt = v.base[state].astype(np.int64) + data[start[chunk] + p + step]
            ok = v.check[nxt] == state
            who, state, chunk = who[ok], nxt[ok], chunk[ok]
            step += 1
            pid = v.value[state]
            end = pid >= 0
            if end.any():
                w, c, i = who[end], chunk[end], pid[end]
                to = cell[c] + p + step
                cand = here[w] + v.scores[i]
                up = cand > best[to]
                to = to[up]
                best[to], back[to], piece[to] = cand[up], p, i[up]
                single[w[width[w] == step]] = True
        rest = np.flatnonzero(~single)
        if len(rest):
            c = live[rest]
            to = cell[c] + np.minimum(p + width[rest], size[c])
            cand = here[rest] + v.unk
            up = cand > best[to]
            best[to[up]], back[to[up]], piece[to[up]] = cand[up], p, -1
    # Walk back from the ends of all chunks together.
    at, who = size.copy(), np.arange(len(size))
    who = who[at > 0]
    spans = []
    while len(who):
        to = cell[who] + at[who]
        spans.append((who, back[to], at[who], piece[to]))
        at[who] = back[to]
        who = who[at[who] > 0]
    if not spans:
        return np.zeros(0, np.int32), np.zeros(len(n) + 1, np.int64)
    who, a, z, pid = (np.concatenate(x) for x in zip(*spans))
    chunk = order[who]
    count = np.where(pid < 0, z - a, 1)
    o = np.lexsort((a, chunk))
    chunk, a, pid, count, src = chunk[o], a[o], pid[o], count[o], start[who][o]
    ids = np.repeat(pid, count)
    byte = np.repeat(pid < 0, count)
    pos = C.ranges(src + a, count)
    ids[byte] = v.byte_ids[data[pos[byte]]]
    return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(chunk, count, len(n))))).astype(np.int64)


def viterbi_of_one(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """Best ids of one long chunk: its places walk the trie together, stretch by stretch, and the recurrence goes over the matches found.

    Time and memory (14 bytes a byte of text) grow with the length; nothing is cut, so the result is that of the whole chunk.
    """
    n, unk, inf = len(data), v.unk, float("-inf")
    best, step, piece = array("d", [inf]) * (n + 1), array("H", [0]) * (n + 1), array("i", [-1]) * (n + 1)
    best[0] = 0.0
    for a in range(0, n, STRETCH):
        at = np.arange(a, min(n, a + STRETCH))
        state, who, size, found = np.ones(len(at), np.int64), at, 0, []
        while len(who):
            nxt = v.base[state].astype(np.int64) + data[who + size]
            ok = v.check[nxt] == state
            who, state, size = who[ok], nxt[ok], size + 1
            end = v.value[state] >= 0
            found.append((who[end], np.full(int(end.sum()), size), v.value[state[end]]))
            more = who + size < n
            who, state = who[more], state[more]
        where, long, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((long, where))
        first = np.searchsorted(where[order], np.append(at, at[-1] + 1)).tolist()
        worth, long, ids = v.scores[ids[order]].tolist(), long[order].tolist(), ids[order].tolist()
        width = np.minimum(_CHAR_BYTES[data[at]], n - at).tolist()
        for k, p in enumerate(range(a, a + len(at))):
            here = best[p]
            if here == inf:  # inside a character
                continue
            w, single = width[k], False
            for j in range(first[k], first[k + 1]):
                to, m = here + worth[j], long[j]
                single |= m == w
                if to > best[p + m]:
                    best[p + m], step[p + m], piece[p + m] = to, m, ids[j]
            if not single and here + unk > best[p + w]:
                best[p + w], step[p + w], piece[p + w] = here + unk, w, -1
    out, p = array("i"), n
    while p:
        if piece[p] >= 0:
            out.append(piece[p])
        else:
            out.extend(int(v.byte_ids[x]) for x in data[p - step[p] : p][::-1])
        p -= step[p]
    return np.frombuffer(out, np.int32)[::-1] if len(out) else np.zeros(0, np.int32)


def gather(flat: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[off[w]:off[w+1]] for each w, end to end, and the lengths."""
    n = off[which + 1] - off[which]
    return flat[C.ranges(off[which], n)], n


class ChunkCache:
    """Ids of chunks seen before, in flat arrays under an open-addressed table; starts anew when it holds too many.

    A chunk is found by a 64-bit hash and then compared by its bytes, so a collision only means that it isn't kept.
    """

    def __init__(self, encode):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(1 << 16, -1, np.int32)
        self.hash = np.zeros(0, np.uint64)
        self.raw, self.raw_off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the chunks with the hashes h; -1: none."""
        mask = np.uint64(len(self.slot) - 1)
        at, place, live = np.full(len(h), -1, np.int64), (h & mask).astype(np.int64), np.arange(len(h))
        while len(live):
            e = self.slot[place[live]]
            live, e = live[e >= 0], e[e >= 0]
            same = self.hash[e] == h[live]
            at[live[same]] = e[same]
            live = live[~same]
            place[live] = (place[live] + 1) & int(mask)
        return at

    def _enter(self, first: int) -> None:
        """Put the chunks from number first on into the table, at most half full."""
        if 2 * len(self.hash) > len(self.slot):
            self.slot, first = np.full(1 << int(4 * len(self.hash)).bit_length(), -1, np.int32), 0
        mask = len(self.slot) - 1
        who = np.arange(first, len(self.hash))
        place = (self.hash[who] & np.uint64(mask)).astype(np.int64)
        while len(who):
            free = self.slot[place] < 0
            self.slot[place[free]] = who[free]
            left = self.slot[place] != who
            who, place = who[left], (place[left] + 1) & mask

    def lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct chunks (a binary array), end to end, with offsets."""
        if len(self.hash) > CACHE_CHUNKS:
            self._clear()
        data, off = C.texts(chunks)
        size = np.diff(off)
        h = C.span_hash(C.prefix_hash(data), off[:-1], off[1:])
        at = self._find(h)
        known = np.flatnonzero(at >= 0)
        other = np.diff(self.raw_off)[at[known]] != size[known]
        at[known[other]], known = -1, known[~other]
        same = self.raw[C.ranges(self.raw_off[at[known]], size[known])] == data[C.ranges(off[known], size[known])]
        if not same.all():
            at[np.repeat(known, size[known])[~same]] = -1
        new = np.flatnonzero(at < 0)
        if not len(new):
            out = gather(self.ids, self.off, at)
            return out[0], np.concatenate(([0], np.cumsum(out[1])))
        fresh, fresh_off = self.encode(chunks.take(pa.array(new)))
        at[new] = len(self.off) - 1 + np.arange(len(new))
        out = gather(np.concatenate((self.ids, fresh)), np.concatenate((self.off, fresh_off[1:] + self.off[-1])), at)
        keep = np.flatnonzero((size[new] <= CACHE_LONGEST) & (self._find(h[new]) < 0))
        keep = keep[np.unique(h[new[keep]], return_index=True)[1]]
        kept, n = gather(fresh, fresh_off, keep)
        text, m = gather(data, off, new[keep])
        first = len(self.hash)
        self.hash = np.concatenate((self.hash, h[new[keep]]))
        self.raw, self.raw_off = np.concatenate((self.raw, text)), np.concatenate((self.raw_off, self.raw_off[-1] + np.cumsum(m)))
        self.ids, self.off = np.concatenate((self.ids, kept)), np.concatenate((self.off, self.off[-1] + np.cumsum(n)))
        self._enter(first)
        return out[0], np.concatenate(([0], np.cumsum(out[1])))


def encode_chunks(cache: ChunkCache, data: np.ndarray, starts: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts whose chunks begin at starts in data, end to end; by_text: chunks before each text (len+1 values)."""
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(by_text), np.int64)
    off = np.concatenate((starts, [len(data)])).astype(np.int32)
    arr = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    enc = arr.dictionary_encode()
    ids, id_off = cache.lookup(enc.dictionary)
    out, n = gather(ids, id_off, np.asarray(enc.indices).astype(np.int64))
    before = np.concatenate(([0], np.cumsum(n)))
    return out, before[by_text]


def encode_texts(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts data[off[i]:off[i+1]], end to end, and their offsets."""
    n = np.diff(off)
    full = np.flatnonzero(n > 0)
    size = np.where(n > 0, n + 1, 0)
    new_off = np.concatenate(([0], np.cumsum(size)))
    buf = np.full(int(new_off[-1]), 0x20, np.uint8)
    body = np.ones(len(buf), bool)
    body[new_off[:-1][full]] = False
    buf[body] = data
    cut = np.zeros(len(buf), bool)
    if len(buf):
        cut[1:] = ~v.inside[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        cut[new_off[:-1][full]] = True
    starts = np.flatnonzero(cut)
    if "chunks" not in v.cache:
        v.cache["chunks"] = ChunkCache(lambda chunks: viterbi(v, *C.texts(chunks)))
    return encode_chunks(v.cache["chunks"], buf, starts, np.searchsorted(starts, new_off))


def decode_ids(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[str]:
    """Texts of the id sequences ids[off[i]:off[i+1]]."""
    ids = ids.astype(np.int64)
    ids = np.where((ids >= 0) & (ids < len(v.pieces)), ids, 0)
    raw, n = gather(v.out_bytes, v.out_off, ids)
    ends = np.concatenate(([0], np.cumsum(n)))[off]
    whole = raw.tobytes()
    out = []
    for a, z in zip(ends[:-1], ends[1:]):
        text = whole[a:z]
        out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
    return out


_loaded: dict = {}


def _vocabulary(sent) -> Vocabulary:
    if sent.id not in _loaded:
        _loaded.clear()
        _loaded[sent.id] = Vocabulary(*sent.value)
    return _loaded[sent.id]


class Sent:
    """A broadcast vocabulary; every worker builds its trie once."""

    def __init__(self, spark: SparkSession, model_file: str):
        v = Vocabulary.load(model_file)
        self.bc = spark.sparkContext.broadcast((v.pieces, v.scores, v.byte_ids))
        self.id = id(self.bc), model_file

    @property
    def value(self):
        return self.bc.value


def encode(docs: DataFrame, model_file: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of the whole text in column out (array<int>)."""
    sent = Sent(docs.sparkSession, model_file)

    @F.arrow_udf("array<int>")
    def apply(col: pa.Array) -> pa.Array:
        v = _vocabulary(sent)
        parts = []
        for lo, hi in C.pieces(col):
            ids, off = encode_texts(v, *C.texts(col.slice(lo, hi - lo)))
            parts.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(out, apply(F.col(f"`{text_col}`")))


def decode(df: DataFrame, model_file: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the ids in column out; null ids decode to an empty text."""
    sent = Sent(df.sparkSession, model_file)

    @F.arrow_udf("string")
    def apply(col: pa.Array) -> pa.Array:
        v = _vocabulary(sent)
        col = col.fill_null([]) if col.null_count else col
        off = np.asarray(col.offsets).astype(np.int64) if len(col) else np.zeros(1, np.int64)
        flat = np.asarray(col.flatten().fill_null(-1))
        texts, a = [], 0
        while a < len(col):  # a few MB of text at a time
            z = min(len(col), max(a + 1, int(np.searchsorted(off, off[a] + 500_000, "right")) - 1))
            texts += decode_ids(v, flat[off[a] - off[0] : off[z] - off[0]], off[a : z + 1] - off[a])
            a = z
        return pa.array(texts, pa.string())

    return df.withColumn(out, apply(F.col(f"`{ids_col}`")))
