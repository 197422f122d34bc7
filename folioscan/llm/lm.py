"""Stupid-backoff language-model scores, computed relationally.

Documents are dealt to batches.  A batch explodes its documents to n-grams of words up to `order`, counts them, and
sends each distinct one to the bucket of its hash.  A bucket holds its part of the count tables: it adds the batches'
counts and joins them back to the n-grams that asked.  A last look at the documents turns the counts into scores and
sums them per document.  What crosses the network is one packed row for each batch and bucket, with the sorted hashes
as byte planes of their differences (about six bytes for an n-gram), so that the exchange stays near the input's size.

One and two words are counted in a first pass, each further length in a pass of its own.  An n-gram occurs no more often
than its first or last n - 1 words, so a pass asks only for n-grams whose two parts occur at least `least` times; the
counts of all others are below `least`, where no score reads them.  That leaves out nothing that a score depends on.

The score of a word after its context is the count of the longest n-gram ending in it that occurs at least `least`
times, over the count of that n-gram's context, times `backoff` for each word of context given up; a single word's is
its count over all words.  N-grams don't reach over documents.  The counts are those of the scored table itself.

Cases: a null, empty or blank text has no word, log_score 0 and a null mean; repeated rows count as often as they stand
there; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import chain, tidy
from folioscan.llm.exchange import batched, cut_by_bucket, ordered, pack_sorted, unpack_sorted, word_hashes

ORDER, LEAST, BACKOFF = 3, 2, 0.4
BATCH_BYTES = 4 << 20


def pack_counts(n: np.ndarray) -> bytes:
    return zstandard.compress(n.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the noise of the five lower byte planes of their differences as it is, the upper ones compressed."""
    raw = pack_sorted(keys)
    return raw[: 5 * len(keys)] + zstandard.compress(raw[5 * len(keys) :], 1)


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return unpack_sorted(raw[: 5 * n] + zstandard.decompress(raw[5 * n :]))


def ngrams(h: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, place of its last word) of the n-grams of each length that lie within a row."""
    since = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for n in range(1, order + 1):
        last = np.flatnonzero(since >= n - 1)
        out.append((chain(h, n, 4 + 16 * n)[last - n + 1] if len(last) else np.zeros(0, np.uint64), last))
    return out


def scores(docs: DataFrame, order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, n_backed_off (words scored by less than the longest n-gram there), log_score, mean_log_score."""
    rows, n = batched(docs, batch_bytes=BATCH_BYTES)
    by_batch = rows.groupBy("batch")

    def asked(table: pa.Table, answers: pa.Table | None, passes: int, answered: int):
        """(first word of each row, counts by length and place of its last word, keys of the last pass, counts here)."""
        first, h, _ = word_hashes(table)
        grams = ngrams(h, first, min(order, passes + 1))
        known, keys, count = [], None, None
        for k in range(passes):
            lengths = grams[:2] if k == 0 else grams[k + 1 : k + 2]
            if k:
                (g, last), often = lengths[0], known[-1] >= least
                ok = often[last] & often[last - 1]
                lengths = [(g[ok], last[ok])]
            keys, place, count = np.unique(np.concatenate([g for g, _ in lengths]), return_inverse=True, return_counts=True)
            if k >= answered:
                break
            value = np.zeros(len(keys), np.int64)
            part = answers.filter(pc.equal(answers["pass"], k))
            for bucket, raw in zip(part["bucket"].to_pylist(), part["counts"].to_pylist(), strict=True):
                a, b = _bucket_span(keys, bucket, n)
                value[a:b] = unpack_counts(raw)
            for g, last in lengths:
                c = np.zeros(int(first[-1]), np.int64)
                c[last], place = value[place[: len(g)]], place[len(g) :]
                known.append(c)
        return first, known, keys, count

    def send(batch: int, keys: np.ndarray, count: np.ndarray) -> pa.Table:
        found, start, stop = cut_by_bucket(keys, n)
        spans = list(zip(start.tolist(), stop[: len(start)].tolist(), strict=True))  # no key, no bucket
        return pa.table({
            "bucket": pa.array(found, pa.int32()), "batch": pa.array([batch] * len(found), pa.int32()),
            "keys": pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array([pack_counts(count[a:b]) for a, b in spans], pa.binary()),
        })

    @tidy
    def explode(table: pa.Table) -> pa.Table:
        return send(table["batch"][0].as_py(), *asked(ordered(table), None, 1, 0)[2:])

    def explode_longer(k: int):
        def f(table: pa.Table, answers: pa.Table) -> pa.Table:
            return send(table["batch"][0].as_py(), *asked(ordered(table), answers, k + 1, k)[2:])

        return tidy(f)

    def add(k: int, often: bool):
        """Counts over all batches for pass k; with `often` only whether they reach `least`."""

        def f(table: pa.Table) -> pa.Table:
            counts = [unpack_counts(c) for c in table["counts"].to_pylist()]
            lists = [unpack_keys(raw, len(c)) for raw, c in zip(table["keys"].to_pylist(), counts, strict=True)]
            every, count = np.concatenate(lists), np.concatenate(counts)
            order_ = np.argsort(every, kind="stable")
            new = np.append(True, every[order_[1:]] != every[order_[:-1]])
            total = np.empty(len(every), np.int64)
            total[order_] = np.add.reduceat(count[order_], np.flatnonzero(new))[np.cumsum(new) - 1]
            if often:
                total = np.where(total >= least, max(least, 0), 0)
            parts = np.split(total, np.cumsum([len(x) for x in lists])[:-1])
            return pa.table({"batch": table["batch"], "bucket": table["bucket"], "pass": pa.array([k] * len(parts), pa.int32()), "counts": pa.array([pack_counts(p) for p in parts], pa.binary())})

        return tidy(f)

    asks, answer = "bucket int, batch int, keys binary, counts binary", "batch int, bucket int, pass int, counts binary"
    passes = max(order - 1, 1)
    by_bucket = by_batch.applyInArrow(explode, asks).groupBy("bucket")
    counts = by_bucket.applyInArrow(add(0, False), answer)
    often = by_bucket.applyInArrow(add(0, True), answer)
    for k in range(1, passes):
        by_bucket = by_batch.cogroup(often.groupBy("batch")).applyInArrow(explode_longer(k), asks).groupBy("bucket")
        counts = counts.unionByName(by_bucket.applyInArrow(add(k, False), answer))
        often = often.unionByName(by_bucket.applyInArrow(add(k, True), answer))
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    total = rows.agg(F.sum(words.cast("long"))).first()[0] or 0

    @tidy
    def look_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        first, by_place, *_ = asked(table, answers, passes, passes)
        words = int(first[-1])
        reach = np.minimum(np.arange(words) - np.repeat(first[:-1], np.diff(first)), order - 1)  # words of context there
        score = by_place[0] / max(total, 1) * backoff ** reach
        used = np.zeros(words, np.int64)
        for k in range(1, order):
            ok = by_place[k] >= least
            before = np.append(0, by_place[k - 1][:-1])  # the context ends one word earlier
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(ok, by_place[k] / before * backoff ** (reach - k), score)
            used[ok] = k
        log = np.log(score)
        edges = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        n_words = np.diff(first)
        log_score = np.array([log[a:b].sum() for a, b in edges], np.float64)
        less = np.concatenate([[0], np.cumsum(used < reach)])
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_backed_off": pa.array(less[first[1:]] - less[first[:-1]], pa.int64()),
            "log_score": pa.array(log_score),
        })

    found = by_batch.cogroup(counts.groupBy("batch")).applyInArrow(look_up, "doc_id long, n_words long, n_backed_off long, log_score double")
    return found.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"))


def _bucket_span(keys: np.ndarray, bucket: int, n: int) -> tuple[int, int]:
    """Where a bucket's keys stand among ascending ones: its first key has the least upper half h with h * n >> 32 == bucket."""
    edge = [-(-(b << 32) // n) << 32 for b in (bucket, bucket + 1)]
    return int(np.searchsorted(keys, np.uint64(edge[0]))), len(keys) if edge[1] >> 64 else int(np.searchsorted(keys, np.uint64(edge[1])))
