"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide counts of linked ids.

A is a byte-level model that encodes a blank and the text, B a piece model that encodes the text and puts the blank there
itself, so both spell the same bytes.  A link is a pair of token occurrences whose byte ranges overlap; the ends of either
side's tokens cut the bytes into stretches, and each stretch is one link.  Places where tokens of both sides end cut the
tokens into groups.

Counts: a pair of ids is one 64-bit key, B's id in the upper half.  Each partition counts its keys with numpy in bounded
memory; the counts are range-partitioned and sorted by key, and each range sums its runs of equal keys to one shard, a file
of ascending keys and their counts in the folder of the checkpoints.  The documents look their keys up in the shards,
memory-mapped, by binary search.  What is known of a shard on the driver is its name, its first and last key and the largest
count of each B id in it: no more than B's vocabulary and the number of shards.

Cases: texts that are null, empty, or that either side doesn't spell back (U+2581 in B) have no tokens, zeros and an empty
groups_sha256; repeated rows count each; an empty table gives no rows; a null id is kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import bpe, piece
from folioscan.llm.common import as_arrow, buffers, checkpoint_dir, cut, partitions, pieces, release

#: Bytes of a long text that are aligned at once.
SPAN = 2 << 20
#: Keys that a partition holds before it counts them anew, and distinct ones before it sends them on.
HELD, SENT = 1 << 20, 4 << 20
LOW = (1 << 32) - 1


class Pair:
    """Both encoders, and what their ids spell."""

    def __init__(self, a: str, b: str):
        self.a, self.b = bpe.codec(a), piece.codec(b)
        self.size_a = np.zeros(max(self.a.tokens) + 1, np.int64)
        for i, t in self.a.tokens.items():
            self.size_a[i] = len(t)
        self.size_b = np.array([len(x) for x in self.b.out], np.int64)
        ids = range(max(len(self.size_a), len(self.size_b)))
        self.written = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in ids]
        self.ids = len(ids)

    def encode(self, rows: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Both sides' ids of each row; none where a side doesn't spell the row, which is where it holds B's sign for a blank."""
        fit = [r if piece.BLANK not in r else "" for r in rows]
        return self.a.encode_rows([" " + r if r else "" for r in fit]), self._pieces(fit)

    def _pieces(self, rows: list[str]) -> list[bytes]:
        """B's ids by the library; those of long texts by the table of prefixes (the library took 38 bytes a character, the table 4)."""
        short = [r if len(r) <= SPAN // 8 else "" for r in rows]
        found = self.b.model.encode(short, num_threads=1)
        return [array("I", x).tobytes() if len(r) <= SPAN // 8 else self.b.encode_rows([r])[0] for r, x in zip(rows, found, strict=True)]

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys of the links, bytes where each link ends, bytes where each group ends, marked ids in the order of groups)."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        if end_a[-1] != end_b[-1]:
            raise ValueError("the tokens of both sides spell different bytes")
        cut_a, cut_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        cut_a[end_a] = cut_b[end_b] = True
        both = cut_a & cut_b
        until_a, until_b, until_both = np.cumsum(cut_a), np.cumsum(cut_b), np.cumsum(both)  # ends at or before each byte
        ends, groups = np.flatnonzero(cut_a | cut_b), np.flatnonzero(both)
        keys = b[until_b[ends] - cut_b[ends]] << 32 | a[until_a[ends] - cut_a[ends]]
        group_a, group_b = until_both[end_a] - both[end_a], until_both[end_b] - both[end_b]
        place_a = np.arange(len(a)) + np.append(0, until_b[groups])[group_a]
        place_b = np.arange(len(b)) + until_a[groups][group_b]
        marked = np.empty(len(a) + len(b), np.int64)
        # , within a side of a group, | after its first side, ; after the group
        marked[place_a] = a + np.where(np.append(group_a[1:] == group_a[:-1], False), 0, self.ids)
        marked[place_b] = b + np.where(np.append(group_b[1:] == group_b[:-1], False), 0, 2 * self.ids)
        return keys, ends, groups, marked

    def spans(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of a row in parts of about SPAN bytes that end with a group."""
        if 4 * min(len(a), len(b)) < SPAN:
            yield a, b
            return
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        cuts = both[np.unique(np.searchsorted(both, np.arange(SPAN, both[-1], SPAN)))]
        i = j = 0
        for k, m in zip([*np.searchsorted(end_a, cuts) + 1, len(a)], [*np.searchsorted(end_b, cuts) + 1, len(b)], strict=True):
            if k > i:
                yield a[i:k], b[j:m]
            i, j = k, m


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their sums."""
    if n is None:
        return np.unique(keys, return_counts=True)
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, n)
    return found, total


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(a: str, b: str) -> Pair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def align(docs: DataFrame, a: str, b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: bool = True) -> DataFrame:
    """Rows of `keep` with n_a, n_b, n_groups, n_links, groups (if asked for), groups_sha256, pairs and times.

    `groups` is `a1,a2|b1;a3|b2,b3`; `pairs` are the distinct linked ids (B's in the upper half), ascending, `times` how many
    links of the row hold each.  `a` and `b` are paths that every executor can open.  A map over the rows.
    """
    kept = docs.select(*keep, F.col(text).alias("__text"))

    def one(p: Pair, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple:
        """A long row, span by span."""
        n_groups = n_links = 0
        keys, times, digest, written = np.zeros(0, np.int64), np.zeros(0, np.int64), hashlib.sha256(), []
        for k, (x, y) in enumerate(p.spans(ids_a, ids_b)):
            key, ends, found, marked = p.align(x, y)
            n_groups, n_links = n_groups + len(found), n_links + len(ends)
            new, n = _counted(key)
            keys, times = _counted(np.concatenate([keys, new]), np.concatenate([times, n]))
            marked[-1] += p.ids
            part = ";" * (k > 0) + "".join(map(p.written.__getitem__, marked.tolist()))
            digest.update(part.encode())
            written += [part] * groups
        return n_groups, n_links, "".join(written), digest.hexdigest(), keys, times

    def many(p: Pair, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[tuple]:
        """Short rows together."""
        key, ends, found, marked = p.align(ids_a, ids_b)
        size = np.concatenate([[0], np.cumsum(p.size_a[ids_a])])[first_a]  # bytes before each row
        last = (first_a + first_b)[1:]
        marked[np.unique(last[last > 0]) - 1] += p.ids  # a row's last token has no mark after it
        at_link, at_group = np.searchsorted(ends, size, side="right"), np.searchsorted(found, size, side="right")
        at_link[0] = at_group[0] = 0
        row = np.repeat(np.arange(len(size) - 1), np.diff(at_link))
        # rows and both ids as one number, which sorts by row and then by key
        one_key = np.sort((row * len(p.size_b) + (key >> 32)) * len(p.size_a) + (key & LOW))
        at = np.flatnonzero(np.append(True, one_key[1:] != one_key[:-1]))
        times, (row, key) = np.diff(np.append(at, len(one_key))), np.divmod(one_key[at], len(p.size_a) * len(p.size_b))
        key = key // len(p.size_a) << 32 | key % len(p.size_a)
        split = np.searchsorted(row, np.arange(len(size)))
        out, marked = [], marked.tolist()
        for i in range(len(size) - 1):
            s = "".join(map(p.written.__getitem__, marked[first_a[i] + first_b[i] : last[i]]))
            out.append((int(at_group[i + 1] - at_group[i]), int(at_link[i + 1] - at_link[i]), s if groups else "", hashlib.sha256(s.encode()).hexdigest() if s else "", key[split[i] : split[i + 1]], times[split[i] : split[i + 1]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pair(a, b)
        for batch in batches:
            _, offs = buffers(batch.column(batch.num_columns - 1))
            for i, j in pieces(offs):
                part = batch.slice(i, j - i)
                one_side, other = p.encode([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in (one_side, other))
                ids_a, ids_b = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in (one_side, other))
                if len(ids_a) == 0:
                    found = [(0, 0, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(n_a)
                elif len(n_a) == 1:
                    found = [one(p, ids_a, ids_b)]
                else:
                    found = many(p, ids_a, ids_b, np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)]))
                n_groups, n_links, written, digest, keys, times = zip(*found, strict=True)
                columns = {k: part.column(x) for x, k in enumerate(keep)}
                columns |= {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64())}
                if groups:
                    columns["groups"] = pa.array(written, pa.string())
                edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                columns |= {"groups_sha256": pa.array(digest, pa.string()), "pairs": pa.ListArray.from_arrays(edge, np.concatenate(keys)), "times": pa.ListArray.from_arrays(edge, np.concatenate(times).astype(np.int32))}
                yield as_arrow(**columns)

    types = dict(kept.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_a long", "n_b long", "n_groups long", "n_links long"] + ["groups string"] * groups + ["groups_sha256 string", "pairs array<long>", "times array<int>"])
    return kept.mapInArrow(run, schema)


# ---------------------------------------------------------------- counts

def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n) counted within each partition; a key may come several times where a partition holds very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024)
                waiting.append((rows.column(0).flatten().to_numpy(), rows.column(1).flatten().to_numpy().astype(np.int64)))
                held += len(waiting[-1][0])
                if held < max(HELD, len(keys)):
                    continue
                keys, n = _counted(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([n, *(y for _, y in waiting)]))
                waiting, held = [], 0
                if len(keys) > SENT:
                    yield as_arrow(key=keys, n=n)
                    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = _counted(np.concatenate([keys, *(x for x, _ in waiting)]), np.concatenate([n, *(y for _, y in waiting)]))
        if len(keys):
            yield as_arrow(key=keys, n=n)
        release()

    return aligned.select("pairs", "times").mapInArrow(run, "key long, n long")


@dataclass(frozen=True)
class Shards:
    """Sorted counts as files: for each its name, first and last key and rows; the largest count of each B id."""

    folder: str
    shards: list[tuple[str, int, int, int]]
    best: np.ndarray

    def path(self, name: str) -> str:
        """Where a worker opens a shard: in the shared folder, or in Spark's copy of it where only Spark can read that."""
        local = _local(self.folder)
        return posixpath.join(local or SparkFiles.get(posixpath.basename(self.folder)), name)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ascending keys; 0 for unknown ones."""
        out = np.zeros(len(keys), np.int64)
        for name, first, last, rows in self.shards:
            i, j = np.searchsorted(keys, first), np.searchsorted(keys, last, side="right")
            if i < j:
                table = np.memmap(self.path(name), np.int64, "r", shape=(2, rows))
                at = np.searchsorted(table[0], keys[i:j])
                out[i:j] = np.where(table[0][at] == keys[i:j], table[1][at], 0)
        return out


def _local(folder: str) -> str | None:
    parsed = urlparse(folder)
    return parsed.path if parsed.scheme in ("", "file") else None


def shards_of(partial: DataFrame) -> Shards:
    """Sorts the partial counts by key over all partitions and writes one shard for each range."""
    spark = partial.sparkSession
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pairs-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            keys, total = key[at], np.add.reduceat(n, at)
            if done and done[-1][0][-1] == keys[0]:  # a run goes on over the border of two batches
                done[-1][1][-1] += total[0]
                keys, total = keys[1:], total[1:]
            if len(keys):
                done.append((keys, total))
        if not done:
            return
        keys, total = (np.concatenate(x) for x in zip(*done, strict=True))
        store, path = fs.FileSystem.from_uri(folder) if not _local(folder) else (fs.LocalFileSystem(), _local(folder))
        name = f"{shard:06d}.i64"
        store.create_dir(path, recursive=True)
        unfinished = f"{path}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(unfinished) as f:  # renamed when whole, so a task that is tried again does no harm
            f.write(keys.tobytes())
            f.write(total.tobytes())
        store.move(unfinished, f"{path}/{name}")
        b = keys >> 32
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        edge = np.array([0, len(at)], np.int32)
        yield as_arrow(name=[name], first=keys[:1], last=keys[-1:], rows=np.array([len(keys)]), b=pa.ListArray.from_arrays(edge, b[at]), best=pa.ListArray.from_arrays(edge, np.maximum.reduceat(total, at)))

    sorted_ = partial.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    found = sorted(sorted_.mapInArrow(run, "name string, first long, last long, rows long, b array<long>, best array<long>").collect(), key=lambda r: r["first"])
    best = np.zeros(1 + max((r["b"][-1] for r in found), default=0), np.int64)
    for r in found:
        np.maximum.at(best, np.array(r["b"], np.int64), np.array(r["best"], np.int64))
    if found and not _local(folder):
        spark.sparkContext.addFile(folder, recursive=True)
    return Shards(folder, [(r["name"], r["first"], r["last"], r["rows"]) for r in found], best)


def scored(aligned: DataFrame, counts: Shards) -> DataFrame:
    """`aligned` without pairs and times, with n_best (links whose pair is the most frequent of its B id) and count_sum."""
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                rows = batch.slice(k, 1024)
                pairs, times = rows.column(len(kept)), rows.column(len(kept) + 1).flatten().to_numpy().astype(np.int64)
                keys, at = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
                found = counts.counts(keys)
                is_best = (found == counts.best[keys >> 32]) if len(keys) else np.zeros(0, bool)
                row = np.repeat(np.arange(rows.num_rows), pairs.value_lengths().to_numpy())
                total, n_best = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                np.add.at(total, row, found[at] * times)
                np.add.at(n_best, row, is_best[at] * times)
                yield as_arrow(**{c: rows.column(i) for i, c in enumerate(kept)}, n_best=n_best, count_sum=total)

    types = dict(aligned.dtypes)
    return aligned.select(*kept, "pairs", "times").mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in kept] + ["n_best long", "count_sum long"]))


def link_counts(docs: DataFrame, a: str, b: str, keep: tuple[str, ...] = ("doc_id",), groups: bool = False) -> DataFrame:
    """Rows of `keep` with n_a, n_b, n_groups, n_links, groups (if asked for), groups_sha256, n_best and count_sum.

    The aligned rows are written once to the folder of the checkpoints, so that texts are encoded once.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/aligned-{uuid.uuid4().hex}"
    align(docs, a, b, keep=keep, groups=groups).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    return scored(aligned, shards_of(cut(partial_counts(aligned))))
