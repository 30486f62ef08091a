"""Helpers shared by the operators of this subpackage: Arrow text buffers, hashes, shared folders."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: An odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that the vectorised kernels take at once; a longer single text is taken alone.
PIECE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own if driver and executors are one process, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tokenweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its len+1 offsets; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not (pa.types.is_string(arr.type) or pa.types.is_binary(arr.type)):
        arr = arr.cast(pa.string())
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    lo, hi = int(off[0]), int(off[-1])
    data = np.frombuffer(bufs[2], np.uint8)[lo:hi] if bufs[2] is not None and hi > lo else np.zeros(0, np.uint8)
    return data, off - lo


def pieces(arr, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of an Arrow string array, each of at most limit bytes unless one text alone is longer."""
    n = len(arr)
    sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0)) if n else np.zeros(0, int)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, min(hi, n)
        lo = hi
    if n:
        release()


def release() -> None:
    """Give memory that is free in this Python worker back to the system: workers are reused, and would keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", BASE), ("down", BASE_INV)):
                p = np.full(size, U64(base))
                p[0] = 1
                _powers[key] = np.cumprod(p, dtype=U64)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 1 << 22 and n <= 1 << 22:  # a very long text must not keep its tables for good
        _powers["up"], _powers["down"] = up[: 1 << 22].copy(), down[: 1 << 22].copy()
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of a well-known 64-bit hash)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = BASE**s times the polynomial hash of data[s:e]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], dtype=U64, out=out[1:])
    return out


#: Longest span that is hashed as one polynomial: modulo 2**64 there are known pairs of strings of 1,024 places with one value for every base.
PLAIN = 512
MORE = U64(0xD1B54A32D192ED03)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [starts, ends) from prefix_hash: equal strings have equal hashes wherever they are.

    Spans of more than PLAIN places are hashed in pieces of PLAIN, whose mixed hashes are chained.
    """
    _, down = powers(len(prefix))

    def plain(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[z] - prefix[a]) * down[a] + (z - a).astype(U64) * U64(0x2545F4914F6CDD1D))

    if not len(starts) or int((ends - starts).max()) <= PLAIN:
        return plain(starts, ends)
    out = plain(starts, np.minimum(ends, starts + PLAIN))
    at = np.flatnonzero(ends - starts > PLAIN)
    a = starts[at] + PLAIN
    while len(at):
        z = np.minimum(a + PLAIN, ends[at])
        with np.errstate(over="ignore"):
            out[at] = mix(out[at] * MORE + plain(a, z))
        on = z < ends[at]
        at, a = at[on], z[on]
    return out


def strings_hash(arr) -> np.ndarray:
    """64-bit hashes of the strings of an Arrow array (null: as empty)."""
    data, off = texts(arr)
    return span_hash(prefix_hash(data), off[:-1], off[1:])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of start, start+1, ... for each (start, length), end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lengths = np.asarray(lengths, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


#: Bytes of words: digits, letters and everything outside ASCII; A-Z are lower-cased first.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, word starts and ends, and the number of words before each text (len+1 values).

    A word is a maximal run of bytes of [0-9a-z] or of non-ASCII characters inside one text.
    """
    low = _LOWER[data]
    flag = _WORD[low]
    start = flag.copy()
    start[1:] &= ~flag[:-1]
    cut = off[(off > 0) & (off < len(low))]
    start[cut] = flag[cut]  # texts follow one another without a gap
    stop = np.zeros(len(low), bool)
    if len(low):
        stop[:-1] = flag[:-1] & (~flag[1:] | start[1:])
        stop[-1] = flag[-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return low, starts, ends, np.searchsorted(starts, off)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
