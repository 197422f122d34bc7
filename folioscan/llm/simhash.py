"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints at `bits` or fewer differing bits differ in at most that many of their eight bytes, so they share at least
8 - bits bytes at the same positions.  Postings are keyed by positional bytes; in the default case a pair shares four
of eight positions, so three of any seven, and postings keyed by three positional bytes at once stay short (2^24 values
for each of the 35 choices) where single bytes would gather a 256th of the corpus each.  Within a posting list the
shared positional bytes of a pair are tallied, pairs short of the guaranteed minimum are dropped, and the rest are
verified by their differing bits.

Copies share a fingerprint and are one entry of the index, however many there are.  A list gives the links of a
spanning forest rather than all pairs: entries that a search has reached leave the list, so a large group of close
fingerprints costs little more than its size.  No list or pair is dropped.

Cases: a null, empty or blank text has no word, fingerprint zero, and links like any other; under four words (the
shingle's width) the words there are form the one shingle; repeated rows each give a row; a null doc_id counts as the
largest (ids stay below 2^62) and a group without any other has a null component_id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_arrow, buffers, cut, joined_words, mix, partitions, pieces, release, span_hashes, word_spans
from folioscan.llm.components import components

SEED = 42
WIDTH = 4
BITS = 4
#: Up to this length all pairs of a list are compared at once.
SHORT = 16
#: Shingles that are hashed at once.
TOGETHER = 1 << 18
_LANES, _STEP = np.uint64(0x0101010101010101), np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bit_counts(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(rows, 64): how many of each row's hashes have each bit; row r's are h[edges[r]:edges[r + 1]].

    Bits are added eight at a time in the bytes of a word, over at most 255 hashes, then over a row's parts.
    """
    out = np.zeros((len(edges) - 1, 64), np.int64)
    parts = -(-np.diff(edges) // 255)
    if not parts.sum():
        return out
    first = np.cumsum(parts) - parts
    at = 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts)) + np.repeat(edges[:-1], parts)
    some = np.flatnonzero(parts)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, at)
        out[some[:, None], np.arange(j, 64, 8)[None]] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first[some], axis=0, dtype=np.int64)
    return out


def majority(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words of the bits that are set in over half of n hashes."""
    bits = (2 * ones > n[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    return np.where(words >= width, words - width + 1, np.minimum(words, 1))


def fingerprints_of(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each row."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offs)
    text, begin, stop = joined_words(data, starts, ends)
    words = np.diff(first)
    n = _shingles(words, width)
    edges = np.concatenate([[0], np.cumsum(n)])
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((len(words), 64), np.int64)
    for low in range(0, int(edges[-1]), TOGETHER):
        high = min(low + TOGETHER, int(edges[-1]))
        row = np.searchsorted(edges, np.arange(low, high), side="right") - 1
        a = np.arange(low, high) - edges[row] + first[row]
        b = a + np.minimum(words[row], width) - 1
        h = np.array([digest(text[x:y], SEED) for x, y in zip(begin[a].tolist(), stop[b].tolist(), strict=True)], np.uint64)
        some = slice(int(row[0]), int(row[-1]) + 1)
        ones[some] += bit_counts(h, np.clip(edges[some.start : some.stop + 1], low, high) - low)
    return majority(ones, n)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for a, b in pieces(offs):
                fp = fingerprints_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width)
                yield as_arrow(doc_id=batch.column(0).slice(a, b - a), fp=pa.array(fp.view(np.int64)))
            release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def shape(bits: int) -> tuple[int, int]:
    """(positions used, positional bytes in a key) that find every pair at `bits` or fewer differing bits."""
    if not 0 <= bits <= 5:
        raise ValueError("the index finds pairs at 0 to 5 differing bits")
    size = min(3, 8 - bits)
    return min(8, bits + size), size


def postings(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, fp, node) for each choice of positions."""
    used, size = shape(bits)
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(used)]
    keys = []
    for k, chosen in enumerate(combinations(range(used), size)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = key * 256 + byte[i]
        keys.append(key)
    assert len(keys) == comb(used, size)
    return entries.select(F.explode(F.array(*keys)).alias("key"), "fp", "node")


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Tally of shared positional bytes against the guaranteed minimum, then the differing bits."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
    ok = shared >= 8 - bits
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def forest(fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (node, least node of its part of the list) of a spanning forest of one posting list."""
    us, vs = [], []
    order = np.argsort(node)
    fp, node = fp[order], node[order]
    rest = np.arange(len(fp))
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        todo = np.array([seed])
        while len(todo) and len(rest):
            block = todo[: max(1, (1 << 20) // len(rest))]
            todo = todo[len(block) :]
            near = _linked(fp[block][:, None], fp[rest][None, :], bits).any(axis=0)
            if near.any():
                new = rest[near]
                us.append(node[new])
                vs.append(np.full(len(new), node[seed]))
                rest, todo = rest[~near], np.concatenate([todo, new])
    return us, vs


def links_of(key: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole posting lists, given one after another."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.repeat((size > 1) & (size <= SHORT), size)
    k, f, n = key[short], fp[short], node[short]
    for d in range(1, SHORT):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        hit = same[_linked(f[same], f[same + d], bits)]
        us.append(n[hit])
        vs.append(n[hit + d])
    for i in np.flatnonzero(size > SHORT):
        u, v = forest(fp[edge[i] : edge[i] + size[i]], node[edge[i] : edge[i] + size[i]], bits)
        us += u
        vs += v
    return np.concatenate(us), np.concatenate(vs)


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of sorted rows as (columns, rows), cut only where the first column, the key, changes."""
    held: list[np.ndarray] = []
    for batch in batches:
        part = np.stack([c.to_numpy() for c in batch.columns])
        if not part.shape[1]:
            continue
        held.append(part)
        if part[0, 0] == held[0][0, -1] == part[0, -1]:
            continue  # the list goes on
        rows = np.concatenate(held, axis=1)
        whole = int(np.searchsorted(rows[0], rows[0, -1]))
        held = [rows[:, whole:]]
        if whole:
            yield rows[:, :whole]
    if held:
        yield np.concatenate(held, axis=1)


def links(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) links between the nodes of different fingerprints; enough to connect all that are within `bits`."""
    spark = entries.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_lists(batches):
            u, v = links_of(part[0], part[1].view(np.uint64), part[2], bits)
            yield as_arrow(u=pa.array(u), v=pa.array(v))

    listed = postings(entries, bits).repartition(partitions(spark), "key").sortWithinPartitions("key")
    return listed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable by links."""
    each = cut(fingerprints(docs, width))
    # a fingerprint of rows without ids takes a number beyond all ids
    beyond = F.lit(1 << 62) + F.shiftrightunsigned("fp", 2)
    entries = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", beyond).alias("node")))
    groups = components(links(entries, bits))
    labels = entries.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    named = F.when(F.col("component_id") < 1 << 62, F.col("component_id"))
    return each.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), named.alias("component_id"))


def one_of_each(docs: DataFrame, columns: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """`columns` of the document with the smallest doc_id of each group; of rows with equal ids and texts one stays.

    Of different texts with that id the one with the least hash stays.  Rows without an id all stay.
    """
    each = near_duplicates(docs, bits).where("component_id = doc_id").select("doc_id").distinct()
    return _of_ids(docs, columns, docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("__h")).join(each, "doc_id", "left_semi"))


def _row_hash() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _of_ids(docs: DataFrame, columns: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """`columns` of one row for each doc_id of `rows` (doc_id, __h), that with the least hash, and all rows without an id."""
    first = rows.groupBy("doc_id").agg(F.min("__h").alias("__h"))
    kept = docs.where("doc_id IS NOT NULL").select(*columns, _row_hash().alias("__h")).join(first, ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"])
    return kept.select(*columns).unionByName(docs.where("doc_id IS NULL").select(*columns))


# ---------------------------------------------------------------- five words at a similarity of 0.8

#: Width of the shingles behind the wide fingerprint, and its 64-bit words.
FIVE, WORDS = 5, 4
#: Differing bits at which texts are still linked.  At a Jaccard similarity of 0.8 the shingles' vectors are 0.151 of a
#: half turn apart, so 38.7 of 256 bits differ, give or take 5.7; at 0.7 it is 49 and at 0.6 59.
ALIKE = 45
#: Positional bytes (of 8 * WORDS) that linked texts share at least; two of any three lie in one half of the positions.
#: All pairs at 29 or fewer differing bits share three, and of random ones at 38 bits 2 in 10,000 don't, at 45 bits 5 in 1,000.
LEAST = 3


def wide_fingerprints_of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(WORDS, rows): the words of each row's fingerprint over five words."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offs)
    word = span_hashes(data, starts, ends)
    words = np.diff(first)
    n = _shingles(words, FIVE)
    edges = np.concatenate([[0], np.cumsum(n)])
    ones = np.zeros((WORDS, len(words), 64), np.int64)
    for low in range(0, int(edges[-1]), TOGETHER):
        high = min(low + TOGETHER, int(edges[-1]))
        row = np.searchsorted(edges, np.arange(low, high), side="right") - 1
        a = np.arange(low, high) - edges[row] + first[row]
        h = np.full(high - low, FIVE, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(FIVE):  # words beyond a short row's end count as none
                inside = k < words[row]
                h = mix(h * _STEP + np.where(inside, word[np.where(inside, a + k, 0)], np.uint64(0)))
            some = slice(int(row[0]), int(row[-1]) + 1)
            at = np.clip(edges[some.start : some.stop + 1], low, high) - low
            for w in range(WORDS):
                ones[w, some] += bit_counts(mix(h + np.uint64(w) * _STEP), at)
    return np.stack([majority(ones[w], n) for w in range(WORDS)])


def chosen_positions() -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Pairs of positions within a half that split the lists, and the third positions that split each pair's again.

    Every three positions are a pair and one of its thirds.
    """
    half = 4 * WORDS
    pairs = [(h + i, h + j) for h in (0, half) for i, j in combinations(range(half), 2)]
    return pairs, [[k for k in range(2 * half) if k // half != i // half or k > j] for i, j in pairs]


PAIRS, THIRDS = chosen_positions()
#: Positions that key a posting, the first ones of PAIRS: a list by one byte holds those of all its pairs.
FIRSTS = sorted({i for i, _ in PAIRS})
_SECOND = np.array([j for _, j in PAIRS])
#: (pairs, positions): the n-th pair that begins at each position, -1 where there are fewer.
_PAIR = np.array([[([k for k, p in enumerate(PAIRS) if p[0] == i] + [-1] * 4 * WORDS)[n] for i in range(8 * WORDS)] for n in range(4 * WORDS - 1)])
#: (third positions, pairs): the n-th third position of each pair, -1 where it has fewer.
_THIRD = np.array([t + [-1] * (max(map(len, THIRDS)) - len(t)) for t in THIRDS]).T
_HIGH = np.uint64(0x8080808080808080)


def _alike(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows a and b of v: tally of shared positional bytes against LEAST, then the differing bits."""
    a, b = np.broadcast_arrays(a, b)
    x = v[a] ^ v[b]
    differ = np.bitwise_count((((x & ~_HIGH) + ~_HIGH) | x) & _HIGH).sum(axis=-1, dtype=np.int64)  # bytes that aren't equal
    ok = differ <= 8 * WORDS - LEAST
    ok[ok] = np.bitwise_count(x[ok]).sum(axis=-1, dtype=np.int64) <= ALIKE
    return ok


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(key)))


def _short_links(key: np.ndarray, row: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of v in lists of at most SHORT entries, given one after another: all pairs."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, SHORT):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        hit = same[_alike(v, row[same], row[same + d])]
        us.append(row[hit])
        vs.append(row[hit + d])
    return np.concatenate(us), np.concatenate(vs)


def join_trees(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of rows a and b; which of these links did it: a spanning forest, if every row was its own root.

    root holds the least row of each row's tree, before and after.
    """
    used, live = [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        x, y = root[a[live]], root[b[live]]
        apart = x != y
        live, high, low = live[apart], np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        if not len(live):
            return np.concatenate(used)
        order = np.lexsort((low, high))  # each higher root hangs on the least that it meets
        first = order[_runs(high[order])[0]]
        used.append(live[first])
        root[high[first]] = low[first]
        while (root != (up := root[root])).any():
            root[:] = up


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) for the links (u, v); the least ones themselves are left out."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    join_trees(root, at[: len(u)], at[len(u) :])
    below = np.flatnonzero(root != np.arange(len(names)))
    return names[below], names[root[below]]


def _wide_forest(rest: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one list's rows: a search takes what it reaches out of the list."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rest) > 1:
        todo, rest = rest[:1], rest[1:]
        while len(todo) and len(rest):
            block = todo[: max(1, (1 << 16) // len(rest))]
            todo = todo[len(block) :]
            near = np.concatenate([_alike(v, block[:, None], rest[None, i : i + (1 << 16)]) for i in range(0, len(rest), 1 << 16)], axis=1)
            hit = near.any(axis=0)
            if hit.any():
                us.append(rest[hit])
                vs.append(block[near[:, hit].argmax(axis=0)])
                todo, rest = np.concatenate([todo, rest[hit]]), rest[~hit]
    return np.concatenate(us), np.concatenate(vs)


def _found(key: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of v in whole posting lists, given one after another: enough to connect all that are alike.

    Each list is split by the second byte of each of its pairs, and what stays beyond SHORT by each third byte in turn,
    so that few unlike texts meet.
    """
    data = v.view(np.uint8).reshape(len(v), -1)
    for pair in _PAIR:
        at = pair[key >> 8]
        row = np.flatnonzero(at >= 0)
        if not len(row):
            break
        at = at[row]
        sub = at << 16 | (key[row] & 255) << 8 | data[row, _SECOND[at]]
        order = np.argsort(sub, kind="stable")
        sub, row = sub[order], row[order]
        edge, size = _runs(sub)
        size = np.repeat(size, size)
        few, long = (size > 1) & (size <= SHORT), size > SHORT
        yield _short_links(sub[few], row[few], v)
        sub, row = sub[long], row[long]
        for third in _THIRD if len(row) else ():
            at = third[sub >> 16]
            some = at >= 0
            if not some.any():
                break
            deep, own = sub[some] << 8 | data[row[some], at[some]], row[some]
            order = np.argsort(deep, kind="stable")
            deep, own = deep[order], own[order]
            edge, size = _runs(deep)
            few = np.repeat((size > 1) & (size <= SHORT), size)
            yield _short_links(deep[few], own[few], v)
            for i in np.flatnonzero(size > SHORT):
                yield _wide_forest(own[edge[i] : edge[i] + size[i]], v)


def alike_links(key: np.ndarray, node: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within whole posting lists, given one after another; v is (entries, WORDS)."""
    root, us, vs = np.arange(len(key)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _found(key, v):
        new = join_trees(root, a, b)
        us.append(node[a[new]])
        vs.append(node[b[new]])
    return np.concatenate(us), np.concatenate(vs)


def wide_postings(node: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, v) of each entry's postings, one for each of FIRSTS."""
    raw, at = v.view(np.uint8).reshape(len(v), -1).astype(np.int64), np.array(FIRSTS)
    return (at << 8 | raw[:, at]).ravel(), np.repeat(node, len(at)), np.repeat(v, len(at), axis=0)


def alike(entries: DataFrame) -> DataFrame:
    """(u, v) links between the nodes of entries (node, v0 ... of WORDS); enough to connect all that are alike.

    Two are alike if they share LEAST positional bytes or more and differ in at most ALIKE bits; no list or pair is dropped.
    A part's links are drawn together to stars, so no node has more of them than FIRSTS, whatever the size of its group.
    """
    names = [f"v{w}" for w in range(WORDS)]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, v = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            for i in range(0, len(node), 300):
                key, nodes, words = wide_postings(node[i : i + 300], v[i : i + 300])
                yield as_arrow(key=pa.array(key), node=pa.array(nodes), **{n: pa.array(words[:, w]) for w, n in enumerate(names)})
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_lists(batches):
            u, v = stars(*alike_links(part[0], part[1], np.ascontiguousarray(part[2:].T).view(np.uint64)))
            yield as_arrow(u=pa.array(u), v=pa.array(v))
        release()

    longs = ", ".join(f"{k} long" for k in ("key", "node", *names))
    # the table grows by the number of FIRSTS, so each task sorts a third of what it would by default
    listed = entries.select("node", *names).mapInArrow(post, longs).repartition(3 * partitions(entries.sparkSession), "key")
    return listed.sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, __h, component_id) of every row: texts whose five-word shingles are alike to 0.8 or more are linked.

    As near_duplicates, with fingerprints of 256 bits over five words: an inverted index of their positional bytes, the
    tally of shared ones against LEAST, then the differing bits against ALIKE.  Postings are keyed by FIRSTS and lists split
    by PAIRS, so every pair of texts that shares LEAST bytes meets.  Equal fingerprints are one entry; a list gives the links of a spanning forest.
    """
    names = [f"v{w}" for w in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(2))
            for a, b in pieces(offs):
                found = wide_fingerprints_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]).view(np.int64)
                yield as_arrow(doc_id=batch.column(0).slice(a, b - a), __h=batch.column(1).slice(a, b - a), **dict(zip(names, map(pa.array, found), strict=True)))
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("__h"), F.col("text").cast("string").alias("text"))
    each = cut(rows.mapInArrow(run, "doc_id long, __h long, " + ", ".join(f"{k} long" for k in names)))
    beyond = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(*names), 2)
    entries = cut(each.groupBy(*names).agg(F.min("doc_id").alias("least")).select(*names, F.coalesce("least", beyond).alias("node")))
    groups = components(alike(entries))
    labels = entries.join(groups, "node", "left").select(*names, F.coalesce("component", "node").alias("component"))
    joined = each.join(labels, names)
    return joined.select("doc_id", "__h", F.when(F.col("component") < 1 << 62, F.col("component")).alias("component_id"))


def one_of_similar(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """As one_of_each, for groups of texts whose five-word shingles are alike to 0.8 or more."""
    return _of_ids(docs, columns, similar(docs).where("component_id = doc_id").select("doc_id", "__h"))
