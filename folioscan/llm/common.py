"""What the operators share: checkpoints, Arrow text buffers, byte-level word hashing.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` in UTF-8.  All the white space is ASCII,
so byte positions never fall inside a character.  The hashes are vectorised over a whole Arrow buffer.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes a worker handles at once in numpy (about 80 bytes of scratch for each).  A longer row is one piece; its
#: words are found in about 5 bytes for each of its bytes, and hashed and joined in parts of this length.
CHUNK_BYTES = 1 << 20


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor loses no finished work."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- Arrow text

def buffers(text: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks() if text.num_chunks != 1 else text.chunk(0)
    if isinstance(text, pa.ChunkedArray):  # combine_chunks of no chunk
        text = pa.array([], pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_string())
    offs = np.frombuffer(text.buffers()[1] or b"\0" * 8, np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(offs: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [a, b) of at most `most` bytes, or one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word, and the first word of each row (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] & True
    last[:-1] |= space[1:]
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank after each, and where they start and end there."""
    lens = ends - starts + 1
    stop = np.cumsum(lens)
    begin = stop - lens
    total = int(stop[-1]) if len(stop) else 0
    out = np.empty(total, np.uint8)
    shift = begin - starts
    edges = np.unique([0, *np.searchsorted(begin, np.arange(CHUNK_BYTES, total, CHUNK_BYTES)).tolist(), len(begin)])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # words of about CHUNK_BYTES, or one
        low, high = int(begin[i]), int(stop[j - 1])
        if j - i == 1:
            out[low : high - 1] = data[starts[i] : ends[i]]
        else:
            out[low:high] = data[np.minimum(np.arange(low, high) - np.repeat(shift[i:j], lens[i:j]), len(data) - 1)]
    out[stop - 1] = 32
    return out.tobytes(), begin, stop - 1


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = [_random(s, 256) for s in (1, 2)]
_ODD = [int(_random(s, 1)[0]) | 1 for s in (3, 4)]
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers(which: int, n: int) -> np.ndarray:
    """Powers of the hash's base; a long word grows the table for its own call only."""
    if len(_POWERS[which]) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), _ODD[which], np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
        if n > 1 << 20:
            return p
        _POWERS[which] = p
    return _POWERS[which]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint byte spans; `which` picks one of two independent hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    if total > 2 * CHUNK_BYTES:  # parts of bounded length, or one span; the hash of a span depends on nothing else
        cut_at = np.unique(np.searchsorted(np.cumsum(lens), np.arange(CHUNK_BYTES, total, CHUNK_BYTES)) + 1)
        edges = [0, *cut_at[cut_at < len(starts)].tolist(), len(starts)]
        if len(edges) > 2:
            return np.concatenate([span_hashes(data, starts[a:b], ends[a:b], which) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        return np.array([_long_hash(data[starts[0] : ends[0]], which)]) if len(starts) == 1 else np.concatenate([span_hashes(data, starts[i : i + 1], ends[i : i + 1], which) for i in range(len(starts))])
    shift = np.cumsum(lens) - lens
    at = np.arange(total) - np.repeat(shift, lens)  # place in the span
    p = _powers(which, int(lens.max()) + 1)
    with np.errstate(over="ignore"):
        value = _BYTES[which][data[at + np.repeat(starts, lens)]] * p[at]
        total_before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        h = total_before[shift + lens] - total_before[shift]
        return mix(h + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _long_hash(span: np.ndarray, which: int) -> np.uint64:
    """As span_hashes for one span, part by part: the powers of each part go on from those of the one before."""
    h, base = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(span), CHUNK_BYTES):
            part = span[a : a + CHUNK_BYTES]
            p = _powers(which, CHUNK_BYTES + 1)
            h += (_BYTES[which][part] * p[: len(part)]).sum(dtype=np.uint64) * base
            base *= p[len(part)]
        return mix(np.array([h + np.uint64(len(span)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64))[0]


def chain(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each `width` consecutive entries (len(h) - width + 1 of them)."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = _random(16 + seed, width)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(width):
            out = mix(out + h[k : k + m] + c[k]) if k % 4 == 3 else out * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + m] ^ c[k])
        return mix(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """For rows whose words begin at `first`: where among all words a window of `width` lies inside one row."""
    n = int(first[-1])
    ok = np.zeros(max(n, 0), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            ok[a : b - width + 1] = True
    return np.flatnonzero(ok)


def union_lengths(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n entries covered by windows of `width` at `starts`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def as_arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def hex_of(parts: list[bytes]) -> list[str]:
    return [p.hex() for p in parts]


def release() -> None:
    """Give freed memory back to the system; long-lived workers otherwise keep the peak of every operator they ran."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f):
    """A function of one or two tables that gives its scratch memory back."""

    def one(table):
        try:
            return f(table)
        finally:
            release()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return one if f.__code__.co_argcount == 1 else two


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over the whole table."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("b")).first()["b"] or 0)
