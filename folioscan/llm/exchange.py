"""Batches of documents that look keys up in hash buckets, all as DataFrame operations.

Documents are dealt to batches of bounded text by a hash of their id and text, so that many rows without an id, or with
one id, spread like others.  A batch sends each of its distinct keys once to the key's bucket, packed with the others
for that bucket into one row, so a key that a third of all documents hold arrives once from each batch.  Buckets answer
every batch.  Functions that need the documents again use the same shuffle of them (Spark reuses an equal exchange
within a query).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import buffers, partitions, pieces, span_hashes, text_bytes, word_spans

#: Text of a batch; a worker needs about 30 times as much.
BATCH_BYTES = 3 << 20
#: A null doc_id counts as larger than every other.
LAST = np.iinfo(np.int64).max


def batched(docs: DataFrame, *columns: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(batch, doc_id, text, columns) and the number of batches."""
    n = max(partitions(docs.sparkSession), -(-text_bytes(docs) // batch_bytes), 1)
    batch = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n)).cast("int")
    return docs.select(batch.alias("batch"), F.col("doc_id").cast("long"), F.col("text").cast("string"), *columns), n


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a batch in an order that every pass finds again, whatever order they arrive in."""
    by = pa.table({"d": table["doc_id"], "t": table["text"]}) if len(table) else table
    return table.take(pc.sort_indices(by, sort_keys=[("d", "ascending"), ("t", "ascending")])) if len(table) else table


def ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(LAST).to_numpy().astype(np.int64)


def word_hashes(table: pa.Table, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(first word of each row with the total at the end, hashes, second hashes) of a batch's words."""
    data, offs = buffers(table["text"])
    firsts, one, two, n = [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for a, b in pieces(offs):
        d = data[offs[a] : offs[b]]
        starts, ends, first = word_spans(d, offs[a : b + 1] - offs[a])
        firsts.append(first[1:] + n)
        n += len(starts)
        one.append(span_hashes(d, starts, ends))
        if both:
            two.append(span_hashes(d, starts, ends, 1))
    return np.concatenate(firsts), np.concatenate(one), np.concatenate(two) if both else None


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the (well mixed) keys."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cut_by_bucket(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, start, stop) of each bucket present in ascending keys."""
    found, start = np.unique(bucket_of(key, n), return_index=True)
    return found, start, np.append(start[1:], len(key))[: len(start)]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as byte planes of their differences."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_places(doc: np.ndarray, row: np.ndarray, word: np.ndarray) -> bytes:
    """Where occurrences stand, in the order of their rows: byte planes of differences, compressed."""
    planes = [np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (doc, row)]
    return zstandard.compress(b"".join([*planes, word.view(np.uint8).reshape(len(word), -1).T.tobytes()]), 1)


def unpack_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(16, -1)
    part = lambda a, b, kind: np.ascontiguousarray(planes[a:b].T).view(kind).ravel()
    return np.cumsum(part(0, 8, np.int64)), np.cumsum(part(8, 12, np.int32), dtype=np.int32), part(12, 16, np.int32)
