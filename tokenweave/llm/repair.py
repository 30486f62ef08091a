"""Token ids as grammar-compressed binary shards (Re-Pair), written in document order and read back.

``write_shards`` range-partitions the documents by id, sorts each partition, encodes whole texts with a given
tokenizer, appends the end id to each document and packs blocks of about ``block_tokens`` ids. A block is compressed by
Re-Pair: adjacent id pairs are counted, the frequent ones replaced by new symbols and the counts mended, until no pair repeats often. Files are Parquet, one
row a block, so that commits, retries of lost executors and remote stores work as for any Spark output:

    shard int, block int, start long (ids of the shard before the block), ids array (document ids, in order),
    n_tokens long, payload binary

payload, little-endian: b"TWRP", u32 end id, u32 first nonterminal, u32 rules, u32 symbols, u32 documents, u8 bytes a symbol (2 or
4), then the rules (pairs of u32), each rule's expansion length (u32), the symbols, and symbols before each document
(u32). The symbol before the first nonterminal stands for the end id at a document's end (texts may hold that id too). No
rule crosses a document's end, so ``decode_document`` expands one document alone, and ``decode_range`` skips
by expansion lengths to any token range.

Defined results: null and empty texts are the end id alone; a null document id comes first; rows with equal ids stay
neighbours, ordered by a hash of their texts; an empty table writes no block. Other columns are not written.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweave.llm import common as C
from tokenweave.llm import unigram as U

MAGIC = b"TWRP"
HEAD = struct.Struct("<4sIIIIIB")


# ---- tokenizing -------------------------------------------------------------------------------------------------

#: Classes of bytes: 0 white space, 1 letters, 2 punctuation, 3 what must stay with its neighbours, 4 digits.
_KIND = np.full(256, 3, np.uint8)
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalpha() else 4 if chr(_b).isdigit() else 2
for _b in b"'<|>":
    _KIND[_b] = 3
for _b in b" \t\n\v\f\r":
    _KIND[_b] = 0


#: Runs of ASCII punctuation that are one word: all but ' < | >
_SIGNS = r"^[!-&(-/:;=?@\[-`{}~]+$"


#: The normaliser and pre-tokenizer that the cuts are made for, as a tokenizers file names them.
SPLITS_FOR = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


class WordTokenizer:
    """A tokenizers file whose white space is dropped and whose words split between letters, digits and punctuation.

    Texts are cut where that tokenizer always cuts (white space; between ASCII letters, digits and punctuation other
    than ' < | >, which its patterns or special tokens can span), and each distinct chunk is encoded once. A file with
    another normaliser or pre-tokenizer, or special tokens not in <| |>, would be cut wrongly and is refused.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        split = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = split[0].get("pattern", {}).get("Regex"), split[0].get("behavior"), split[0].get("invert")
        odd = [t["content"] for t in shape.get("added_tokens", []) if not re.fullmatch(r"<\|[a-z]+\|>", t["content"])]
        if (shape.get("normalizer") or {}).get("normalizers") != SPLITS_FOR["normalizers"] or pattern != (SPLITS_FOR["pattern"], "Removed", True) or shape["model"].get("end_of_word_suffix") != "</w>" or odd:
            raise ValueError(f"{path} splits words in another way than this tokenizer is made for")
        self.cache = U.ChunkCache(self._new)
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that end a word
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks: one call for many chunks that are one word each, whose ids end with an end of word; else a call each."""
        words = chunks.cast(pa.string())
        one = np.asarray(pc.or_(pc.utf8_is_alpha(words), pc.match_substring_regex(words, _SIGNS)))
        parts, sizes = [np.zeros(0, np.int64)] * 2, np.zeros(len(words), np.int64)
        for k, which in enumerate((np.flatnonzero(one), np.flatnonzero(~one))):
            some = words.take(pa.array(which))
            flat, n = self._encode(pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, len(some), 200), len(some)], pa.int32()), some), " ") if k == 0 else some)
            if k == 0:
                n = np.diff(np.flatnonzero(self.last[flat]) + 1, prepend=0)
                if len(n) != len(which):  # a word that is not one word to this tokenizer
                    flat, n = self._encode(some)
            parts[k], sizes[which] = flat, n
        off = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.zeros(int(off[-1]), np.int32)
        for which, flat in zip((one, ~one), parts):
            ids[C.ranges(off[:-1][which], sizes[which])] = flat
        return ids, off

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.int64, int(n.sum())), n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = data if b"<|" in data.tobytes() else C._LOWER[data]
        kind = _KIND[low]
        keep = kind > 0
        cut = np.zeros(len(low), bool)
        if len(low):
            a, b = kind[:-1], kind[1:]
            cut[1:] = (a == 0) | ((a != b) & (a != 3) & (b != 3)) | ((a == 4) & (b == 4))
            cut[off[:-1][off[:-1] < len(low)]] = True
        cut &= keep
        starts = np.flatnonzero(cut)
        new_at = np.cumsum(keep, dtype=np.int32 if len(low) < 1 << 31 else np.int64)[starts] - 1
        return U.encode_chunks(self.cache, low[keep], new_at, np.searchsorted(starts, off))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str, content: bytes | None = None) -> WordTokenizer:
    """The tokenizer of a file, made once in each worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# ---- Re-Pair ----------------------------------------------------------------------------------------------------


#: Counters of pairs, by a hash of the pair.
COUNTERS = 1 << 19


def _counter(a: np.ndarray, b: np.ndarray, end: int) -> np.ndarray:
    """The counter of each pair; COUNTERS for a pair with the symbol end."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA77)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    out = (h >> np.uint32(13)).astype(np.int32)
    out[(a == end) | (b == end)] = COUNTERS
    return out


def compress(seq: np.ndarray, end: int, *, min_count: int = 8, pairs: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (n, 2) and the first nonterminal of the ids seq; pairs with the symbol end are never replaced.

    Pairs are counted once; then each round replaces all occurrences of the ``pairs`` most frequent pairs, chosen so that
    no symbol is the left part of one and the right part of another, and mends the counters around the replaced places.
    It ends when no pair occurs ``min_count`` times: a rule takes 12 bytes, so rarer pairs would not pay for theirs.
    """
    seq = seq.astype(np.int32)
    first = int(seq.max(initial=end)) + 1
    rules, n_rules, floor = [np.zeros((0, 2), np.int64)], 0, False
    if not len(seq):
        return seq.astype(np.int64), rules[0], first
    pair = np.append(_counter(seq[:-1], seq[1:], end), np.int32(COUNTERS))  # the last symbol has no pair
    count = np.bincount(pair, minlength=COUNTERS + 1)
    number = np.full(COUNTERS + 1, -1, np.int32)  # of the chosen pair of a counter
    while True:
        count[COUNTERS] = 0
        often = count[count >= min_count]
        if not len(often):
            break
        least = min_count if floor or len(often) <= 2 * pairs else int(np.partition(often, -2 * pairs)[-2 * pairs])
        at = np.flatnonzero((count >= least)[pair])
        code = seq[at].astype(np.int64) << 32 | seq[at + 1]
        codes, n = np.unique(code, return_counts=True)
        codes, n = codes[n >= min_count], n[n >= min_count]
        left, right, chosen = set(), set(), []
        for c in codes[np.lexsort((codes, -n))[: 2 * pairs]].tolist():
            x, y = c >> 32, c & 0xFFFFFFFF
            if x in right or y in left or x == y and (x in left or y in right):
                continue
            left.add(x)
            right.add(y)
            chosen.append(c)
            if len(chosen) == pairs:
                break
        if not chosen:  # those counters are sums over several rare pairs
            if least == min_count:
                break
            floor = True
            continue
        floor = False
        chosen = np.array(chosen, np.int64)
        slot = _counter(chosen >> 32, chosen & 0xFFFFFFFF, end)
        slot, first_of = np.unique(slot, return_index=True)
        chosen = chosen[first_of]  # of two pairs with one counter, the other waits for a later round
        number[slot] = np.arange(len(chosen))
        where = number[pair[at]]
        ok = (where >= 0) & (chosen[where] == code)
        number[slot] = -1
        at, where = at[ok], where[ok]
        new = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1)
        if (new[:, 0] == new[:, 1]).any():  # in a run of one symbol, every second pair
            head = np.concatenate(([True], np.diff(at) > 1))
            start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            ok = (np.arange(len(at)) - start) % 2 == 0
            at, where = at[ok], where[ok]
        changed = np.zeros(len(seq), bool)
        changed[at] = changed[at + 1] = True
        changed[at[at > 0] - 1] = True
        count -= np.bincount(pair[changed], minlength=COUNTERS + 1)
        seq[at] = first + n_rules + where
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, pair, again = seq[stay], pair[stay], np.flatnonzero(changed[stay])
        if again[-1] == len(seq) - 1:
            pair[-1], again = COUNTERS, again[:-1]
        pair[again] = _counter(seq[again], seq[again + 1], end)
        count += np.bincount(pair[again], minlength=COUNTERS + 1)
        rules.append(new)
        n_rules += len(new)
    return seq.astype(np.int64), np.concatenate(rules), first


def expand(seq: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that the symbols seq stand for; each symbol is written at its place, or its rule's pair put there instead."""
    lengths = expansion_lengths(rules, first) if lengths is None else lengths
    size = np.concatenate((np.ones(first, np.int64), lengths))
    seq, rules = seq.astype(np.int64), rules.astype(np.int64)
    ends = np.cumsum(size[seq])
    place, out = ends - size[seq], np.zeros(int(ends[-1]) if len(seq) else 0, np.int64)
    while len(seq):
        deep = seq >= first
        out[place[~deep]] = seq[~deep]
        place, pair = place[deep], rules[seq[deep] - first]
        seq, place = pair.T.ravel(), np.concatenate((place, place + size[pair[:, 0]]))
    return out


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(len(rules), np.int64)
    for i, (x, y) in enumerate(rules.tolist()):
        out[i] = (out[x - first] if x >= first else 1) + (out[y - first] if y >= first else 1)
    return out


def pack(ids: np.ndarray, stops: np.ndarray, end_id: int, **options) -> bytes:
    """The payload of documents' ids, end to end; stops: where each document ends, its last id being the end id."""
    seq = ids.astype(np.int64)
    end = max(int(seq.max(initial=0)), end_id) + 1
    seq[stops - 1] = end
    seq, rules, first = compress(seq, end, **options)
    doc_off = np.concatenate(([0], np.flatnonzero(seq == end) + 1))
    width = 2 if seq.max(initial=0) < 65536 else 4
    return b"".join((
        HEAD.pack(MAGIC, end_id, first, len(rules), len(seq), len(stops), width), rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(),
        seq.astype(f"<u{width}").tobytes(), doc_off.astype("<u4").tobytes(),
    ))


class Block:
    """A payload opened for random access."""

    def __init__(self, payload: bytes):
        magic, self.end_id, self.first, n_rules, n_sym, self.n_docs, width = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).astype(np.int64).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(payload, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.seq = np.frombuffer(payload, f"<u{width}", n_sym, at)
        at += width * n_sym
        self.doc_off = np.frombuffer(payload, "<u4", self.n_docs + 1, at).astype(np.int64)

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        deep = seq >= self.first
        out = np.ones(len(seq), np.int64)
        out[deep] = self.lengths[seq[deep].astype(np.int64) - self.first]
        return out

    def _ids(self, seq: np.ndarray) -> np.ndarray:
        out = expand(seq, self.rules, self.first, self.lengths)
        out[out == self.first - 1] = self.end_id
        return out

    def decode(self) -> np.ndarray:
        return self._ids(self.seq)

    def decode_document(self, k: int) -> np.ndarray:
        return self._ids(self.seq[self.doc_off[k] : self.doc_off[k + 1]])

    def decode_range(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Ids [lo, hi) of document k; only the symbols that cover them are expanded."""
        seq = self.seq[self.doc_off[k] : self.doc_off[k + 1]]
        ends = np.cumsum(self.sizes(seq))
        a, z = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
        skip = lo - (int(ends[a - 1]) if a else 0)
        return self._ids(seq[a:z])[skip : skip + max(0, hi - lo)]

    def doc_tokens(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.sizes(self.seq))))
        return np.diff(total[self.doc_off])


# ---- shards -----------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_tokens: int = 1 << 20) -> None:
    """Write the token shards of docs under path, in ascending order of the id."""
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("i")).dtypes)["i"]
    src = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    src = src.repartitionByRange("i").sortWithinPartitions("i", F.xxhash64("t"))

    def encode(batches):
        tok, shard = tokenizer(tokenizer_file), TaskContext.get().partitionId()
        held, ids, stops, size, start, block = [], [], [], 0, 0, 0

        def flush():
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64())]
            flat = pa.concat_arrays(ids)
            row += [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([size], pa.int64()), pa.array([pack(np.concatenate(held), np.concatenate(stops), end_id)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["shard", "block", "start", "ids", "n_tokens", "payload"])

        for b in batches:
            for lo, hi in C.pieces(b.column(1), 3 << 20):
                got, off = tok.encode(*C.texts(b.column(1).slice(lo, hi - lo)))
                out = np.full(len(got) + hi - lo, end_id, np.int32)
                body = np.ones(len(out), bool)
                last = off[1:] + np.arange(hi - lo)
                body[last] = False
                out[body] = got
                held.append(out)
                stops.append(size + last + 1)
                ids.append(b.column(0).slice(lo, hi - lo))
                size += len(out)
                if size >= block_tokens:
                    yield flush()
                    start, block, held, ids, stops, size = start + size, block + 1, [], [], [], 0
        if held:
            yield flush()

    src.mapInArrow(encode, f"shard int, block int, start bigint, ids array<{kind}>, n_tokens bigint, payload binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """A row a document: its id, start (ids of all documents before it), n_tokens, ids_crc32; read from the files alone."""
    from pyspark.sql import Window

    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # as many rows as write partitions
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def open_(batches):
        for b in batches:
            for k in range(b.num_rows):
                block = Block(b.column(2)[k].as_py())
                flat = block.decode().astype("<u4")
                n = block.doc_tokens()
                off = np.concatenate(([0], np.cumsum(n)))
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
                start = b.column(3)[k].as_py() + off[:-1]
                yield pa.RecordBatch.from_arrays([b.column(1)[k].values, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    rows = files.join(F.broadcast(before), "shard").select("shard", "ids", "payload", (F.col("start") + F.col("before")).alias("start"))
    return rows.mapInArrow(open_, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_path(spark: SparkSession) -> str:
    return f"{C.shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
