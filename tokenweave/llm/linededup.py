"""Line dedup by two Bloom filters, of line keys seen once and seen twice.

1. Every task sets the filter bits of the distinct line keys of its texts: a key's bits go to its "once" filter and,
   from the second document on, also to its "twice" filter. Tasks send the positions of their bits by segment of the
   filter, or the segment itself where it is full (64 KB); a segment's bits of two tasks or of a task's "twice" filter make the final "twice" filter.
2. Lines whose key hits the "twice" filter are suspected repeats. Only they are shuffled: keys with one count per
   document, summed before the shuffle, with the first occurrence. A false hit of the filter ends here.
3. Confirmed keys go to a last narrow pass over the texts, by broadcast up to ``broadcast_bytes`` of keys and by a join
   on the document id beyond that.

The filter never misses a repeated key, so the result is exact for any filter size; ``max_filter_bits`` bounds what is
broadcast, and a filter that is too small for the input only makes more lines suspects.

Defined results: a text is split at every \\n, so a null or empty text is one empty line (and a null becomes an empty
text in the output); a key is the line stripped of [\\x20\\x09-\\x0D] and lower-cased (A-Z); keys shorter than
``min_chars`` code points never count; rows with one id are one document, and so are those with a null id; ``keep="first"`` keeps
the line with the smallest (id, line number), nulls first, of each repeated key in all rows where these are equal. All
other columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweave.llm import common as C

STRIP = " \t\n\v\f\r"
HASHES = 2
SEGMENT = 19  # log2 of the bits of a segment


def lines(arr) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Lines of all texts end to end, line offsets by text, line keys."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    parts = pc.split_pattern(arr, "\n")
    flat = parts.flatten()
    off = np.asarray(parts.offsets).astype(np.int64)
    return flat, off - off[0], pc.ascii_lower(pc.utf8_trim(flat, characters=STRIP))


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES positions a hash, all in one segment: (HASHES, n)."""
    seg = (h >> np.uint64(40)) % np.uint64(max(1, bits >> SEGMENT))
    width = min(bits, 1 << SEGMENT) - 1
    return np.stack([(seg << np.uint64(SEGMENT)) | ((h >> np.uint64(19 * k)) & np.uint64(width)) for k in range(HASHES)])


def _packed(at: np.ndarray) -> bytes:
    """Distinct bits of a segment: their places, or the whole segment as bits where that is shorter."""
    if 4 * len(at) < 1 << SEGMENT - 3:
        return at.astype("<u4").tobytes()
    flags = np.zeros(1 << SEGMENT, bool)
    flags[at.astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4") if len(raw) < 1 << SEGMENT - 3 else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def _distinct_by_text(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Indices of the first line of each hash in each text."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, doc))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return np.sort(order[first])


def repeated_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, max_filter_bits: int = 1 << 27) -> tuple[DataFrame, object]:
    """(key, n_docs, first) of the keys in at least min_docs documents, first = (id, line number); and the filter."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    n = docs.select((F.length(F.col(f"`{text_col}`")) - F.length(F.replace(F.col(f"`{text_col}`"), F.lit("\n"), F.lit(""))) + 1).alias("n")).agg(F.sum("n")).first()[0] or 1
    bits = min(max_filter_bits, 1 << max(SEGMENT, int(16 * n - 1).bit_length()))

    def positions(batches):
        once, twice = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]

        def settle():  # hashes of one task: distinct, and those that two texts had
            h, c = np.unique(np.concatenate(once), return_counts=True)
            again = np.unique(np.concatenate([*twice, h[c > 1]]))
            once[:], twice[:] = [h], [again]

        held = 0
        for b in batches:
            for lo, hi in C.pieces(b.column(0)):
                _, off, keys = lines(b.column(0).slice(lo, hi - lo))
                h = C.strings_hash(keys)
                sel = _distinct_by_text(h, off)
                if min_chars > 0:
                    sel = sel[np.asarray(pc.utf8_length(keys))[sel] >= min_chars]
                once.append(h[sel])
                held += len(sel)
                if held > 2_000_000:
                    settle()
                    held = 0
        settle()
        for kind, h in ((0, once[0]), (1, twice[0])):
            pos = np.unique(_bits(h, bits))
            seg = (pos >> np.uint64(SEGMENT)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(seg, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(pos)]):
                yield pa.RecordBatch.from_arrays([pa.array([seg[a]], pa.int32()), pa.array([kind], pa.int32()), pa.array([_packed(pos[a:z] & np.uint64((1 << SEGMENT) - 1))])], names=["seg", "kind", "pos"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEGMENT, np.uint8)
        for b in batches:
            for kind, pos in zip(b.column("kind"), b.column("pos")):
                at = _unpacked(pos.as_py())
                seen[at] = np.minimum(seen[at], 1) + 1 if not kind.as_py() else 2
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()])], names=["seg", "bits"])

    found = src.select("t").mapInArrow(positions, "seg int, kind int, pos binary").groupBy("seg").applyInArrow(merge, "seg int, bits binary").toArrow()  # max_filter_bits / 8 bytes at most
    flat = np.zeros(max(bits, 1 << SEGMENT) >> 3, np.uint8)
    for seg, part in zip(found.column("seg").to_pylist(), found.column("bits")):
        flat[seg << SEGMENT - 3 : (seg + 1) << SEGMENT - 3] = np.frombuffer(part.as_py(), np.uint8)
    sent = spark.sparkContext.broadcast((flat, bits))

    def suspects(batches):
        for b in batches:
            for lo, hi in C.pieces(b.column(1)):
                _, off, keys = lines(b.column(1).slice(lo, hi - lo))
                h = C.strings_hash(keys)
                sel = _distinct_by_text(h, off)
                sel = sel[hit(sent.value, h[sel])]
                if min_chars > 0:
                    sel = sel[np.asarray(pc.utf8_length(keys))[sel] >= min_chars]
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[sel]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(sel)), b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(sel - off[doc], pa.int64())], names=["key", "i", "line"])

    kind = dict(src.dtypes)["i"]
    own = src.mapInArrow(suspects, f"key string, i {kind}, line bigint").groupBy("key", "i").agg(F.min("line").alias("line"))  # rows of one id are one document
    keys = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("i", "line")).alias("first")).where(F.col("n_docs") >= min_docs)
    return keys, sent


def hit(filt: tuple[np.ndarray, int], h: np.ndarray) -> np.ndarray:
    flat, bits = filt
    out = np.ones(len(h), bool)
    for pos in _bits(h, bits):
        out &= (flat[pos >> np.uint64(3)] >> (7 - (pos & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out


_held: dict = {}


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none", max_filter_bits: int = 1 << 27, broadcast_bytes: int = 32 << 20, stats: tuple[str, str] | None = None) -> DataFrame:
    """docs with the repeated lines taken out of text_col; stats names columns for the lines before and the lines dropped."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = docs.sparkSession
    keys, filt = repeated_keys(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars, max_filter_bits=max_filter_bits)
    keys = C.written(keys, "line-keys")
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("i")).dtypes)["i"]
    shape = "struct<kept: string, n_lines: bigint, n_dropped: bigint>"
    size = keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")

    if size <= broadcast_bytes:
        firsts = {r.key: (r.i, r.line) if keep == "first" else None for r in keys.select("key", "first.i", "first.line").toLocalIterator()}
        sent = spark.sparkContext.broadcast(firsts)

        @F.arrow_udf(shape)
        def apply(ids: pa.Array, col: pa.Array) -> pa.Array:
            out = []
            for lo, hi in C.pieces(col):
                part = col.slice(lo, hi - lo)
                flat, off, key = lines(part)
                at = np.flatnonzero(hit(filt.value, C.strings_hash(key)))
                known = sent.value
                drop = np.array([k in known for k in key.take(pa.array(at)).to_pylist()], bool)
                at = at[drop]
                if keep == "first" and len(at):
                    doc = np.searchsorted(off, at, "right") - 1
                    some = key.take(pa.array(at)).to_pylist()
                    idv = ids.slice(lo, hi - lo).take(pa.array(doc)).to_pylist()
                    at = at[[known[k] != (i, int(l)) for k, i, l in zip(some, idv, at - off[doc])]]
                out.append(_without(part, flat, off, at))
            return pa.concat_arrays(out) if out else _empty()

        res = docs.withColumn("__line_dedup", apply(ident, text))
    else:
        res = _joined(docs, keys, filt, ident, text, kind, keep, shape)
    drop = ["__line_dedup"]
    if stats:
        res = res.withColumns({stats[0]: F.col("__line_dedup.n_lines"), stats[1]: F.col("__line_dedup.n_dropped")})
    return res.withColumn(text_col, F.col("__line_dedup.kept")).drop(*drop)


def _empty() -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["kept", "n_lines", "n_dropped"])


def _without(part, flat, off, at) -> pa.StructArray:
    """The texts without the lines numbered at."""
    stay = np.ones(len(flat), bool)
    stay[at] = False
    before = np.concatenate(([0], np.cumsum(stay)))
    n = np.diff(off)
    kept_off = before[off]
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_off, pa.int32()), flat.filter(pa.array(stay))), "\n") if len(at) else pc.fill_null(part, "")
    return pa.StructArray.from_arrays([kept.cast(pa.string()), pa.array(n, pa.int64()), pa.array(n - np.diff(kept_off), pa.int64())], ["kept", "n_lines", "n_dropped"])


def _joined(docs, keys, filt, ident, text, kind, keep, shape) -> DataFrame:
    """The way for more keys than may be broadcast: suspects join keys, and each document gets the keys that it has."""

    def suspects(batches):
        for b in batches:
            for lo, hi in C.pieces(b.column(1)):
                _, off, key = lines(b.column(1).slice(lo, hi - lo))
                h = C.strings_hash(key)
                sel = _distinct_by_text(h, off)
                sel = sel[hit(filt.value, h[sel])]
                doc = np.searchsorted(off, sel, "right") - 1
                yield pa.RecordBatch.from_arrays([key.take(pa.array(sel)), b.column(0).slice(lo, hi - lo).take(pa.array(doc))], names=["key", "i"])

    src = docs.select(ident.alias("i"), text.alias("t"))
    line = F.when(F.col("first.i").eqNullSafe(F.col("i")), F.col("first.line")) if keep == "first" else F.lit(None).cast("bigint")
    own = src.mapInArrow(suspects, f"key string, i {kind}").join(keys, "key").groupBy("i").agg(F.collect_set(F.struct("key", line.alias("line"))).alias("__keys")).withColumnRenamed("i", "__i")

    @F.arrow_udf(shape)
    def apply(col: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for lo, hi in C.pieces(col):
            part = col.slice(lo, hi - lo)
            flat, off, key = lines(part)
            at = []
            for d, mine in enumerate(drops.slice(lo, hi - lo).to_pylist()):
                if mine:
                    first = {x["key"]: x["line"] for x in mine}
                    own_keys = key.slice(off[d], off[d + 1] - off[d]).to_pylist()
                    at += [off[d] + j for j, k in enumerate(own_keys) if k in first and first[k] != j]
            out.append(_without(part, flat, off, np.array(at, np.int64)))
        return pa.concat_arrays(out) if out else _empty()

    both = docs.join(own, ident.eqNullSafe(F.col("__i")), "left")
    return both.withColumn("__line_dedup", apply(text, F.col("__keys"))).drop("__keys", "__i")
