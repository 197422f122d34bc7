"""Approximate nearest neighbours by cosine with a hash-prefix forest.

A tree gives every vector a long hash string: each symbol is the place and the sign of the largest of `FACES` coordinates
of a random rotation of the vector, after the mean of a bounded sample is taken away (a cross-polytope's nearest corner,
which parts neighbours from others with fewer bits than sides of hyperplanes do).  The strings of a block of rows are one
sorted array.  A query descends in every tree to the longest prefix that any vector shares with it; the trees then ascend
together, a bit at a time, each adding the range of its array that shares the shorter prefix, until `wanted` candidates
of the block are reached: a number that grows more slowly than the block, not a share of it.  Candidates are scored exactly.

Rows are dealt to blocks of about `BLOCK` rows and hashed once there for each `QUERIES` queries; a block of queries and a
block of rows are one task's group, of bounded size.  Equal vectors are one entry of the index with its smallest ids, as
many as a result can show, so a vector that a third of all rows hold costs one entry.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors of different lengths are not compared; equal scores go to the smaller vec_id; a row repeated with the
same vec_id and vector counts once; fewer candidates than asked for are all returned; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import cut

#: Trees, symbols of a string (a tree's own first, then other trees' first ones) and coordinates behind a symbol.
TREES, SYMBOLS, OWN, FACES = 256, 6, 2, 16
BITS = 5
DEPTH = SYMBOLS * BITS
BLOCK, QUERIES = 16384, 65536
#: Queries of a block that are handled at once.
TOGETHER = 256
#: Vectors whose mean is the centre.
SAMPLE = 4096
NEIGHBOURS = 5


def wanted(rows: int, most: int) -> int:
    """Candidates of a block at which its trees stop ascending.

    The synthetic vectors are close to isotropic (fifth neighbours at a cosine of 0.3 to 0.45), which takes many.
    """
    return min(rows, max(8 * most, int(np.ceil(2.5 * rows**0.72))))


def rotations(dim: int, seed: int = 17) -> np.ndarray:
    """(TREES * OWN, dim, faces) random directions, orthogonal within a symbol; faces is at most the dimension."""
    r = np.random.default_rng([seed, dim])
    return np.linalg.qr(r.normal(size=(TREES * OWN, dim, min(FACES, dim))))[0]


def strings(unit: np.ndarray, directions: np.ndarray, center: np.ndarray) -> np.ndarray:
    """(TREES, rows) hash strings as integers, first symbol highest."""
    n, x = len(unit), (unit - center).astype(np.float32)
    own = np.empty((len(directions), n), np.uint32)
    for t, d in enumerate(directions.astype(np.float32)):
        y = x @ d
        at = np.abs(y).argmax(axis=1)
        own[t] = 2 * at + (y[np.arange(n), at] > 0)
    out = np.zeros((TREES, n), np.uint32)
    for k in range(SYMBOLS):
        tree = np.arange(TREES) if k < OWN else (np.arange(TREES) + 37 * (k - OWN + 1)) % TREES
        out = out << np.uint32(BITS) | own[OWN * tree + (k if k < OWN else 0)]
    return out


def candidates(sorted_keys: np.ndarray, order: np.ndarray, queries: np.ndarray, want: int) -> np.ndarray:
    """(queries, rows) mask of each query's rows: `sorted_keys` and `order` are (trees, rows), `queries` (trees, queries)."""
    trees, n = sorted_keys.shape
    asked = queries.shape[1]
    seen = np.zeros((asked, n), bool)
    low, high = np.zeros((trees, asked), np.int64), np.zeros((trees, asked), np.int64)
    near = np.zeros(asked, np.int64)
    for t in range(trees):  # the longest shared prefix is with one of the two neighbours in sorted order
        at = np.searchsorted(sorted_keys[t], queries[t])
        low[t] = high[t] = at
        for i in (np.minimum(at, n - 1), np.maximum(at - 1, 0)):
            near = np.maximum(near, _shared(sorted_keys[t][i], queries[t]))
    going = np.arange(asked)
    for depth in range(int(near.max(initial=0)), -1, -1):
        now = going[near[going] >= depth]  # others have nothing this deep
        if not len(now):
            continue
        shift = np.uint32(DEPTH - depth)
        for t in range(trees):
            first = queries[t][now] >> shift << shift
            a, b = np.searchsorted(sorted_keys[t], first), np.searchsorted(sorted_keys[t], first + ((np.uint32(1) << shift) - np.uint32(1)), side="right")
            for x, y in ((a, low[t][now]), (high[t][now], b)):  # what the shorter prefix adds on either side
                length = y - x
                total = int(length.sum())
                if total:
                    place = np.arange(total) + np.repeat(x - (np.cumsum(length) - length), length)
                    seen[np.repeat(now, length), order[t][place]] = True
            low[t][now], high[t][now] = a, b
        going = going[~((near[going] >= depth) & (np.count_nonzero(seen[going], axis=1) >= want))]
        if not len(going):
            break
    return seen


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits of the longest common prefix."""
    x = (a ^ b).astype(np.float64)
    return np.where(x == 0, DEPTH, DEPTH - 1 - np.floor(np.log2(np.maximum(x, 1)))).astype(np.int64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, with sums that don't depend on where a row stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, center: np.ndarray, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, candidate ids, scores) with the `most` nearest found candidates of each query."""
    unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    asked = queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    directions = rotations(rows.shape[1])
    keys = strings(unit, directions, center)
    order = np.empty(keys.shape, np.int32)
    for t in range(TREES):
        order[t] = np.argsort(keys[t], kind="stable")
        keys[t] = keys[t][order[t]]
    out = []
    want = wanted(len(rows), most)
    for a in range(0, len(queries), TOGETHER):
        some = asked[a : a + TOGETHER]
        seen = candidates(keys, order, strings(some, directions, center), want)
        for q in range(len(some)):
            found = np.flatnonzero(seen[q])
            rough = unit[found] @ some[q]
            if len(found) > most:  # all that could be among the best, ties included
                found = found[rough >= np.partition(rough, -most)[-most] - 1e-9]
            exact = cosines(np.broadcast_to(queries[a + q], (len(found), queries.shape[1])), rows[found])
            best = np.lexsort((ids[found], -exact))[:most]
            out.append((a + q, ids[found[best]], exact[best]))
    return out


def _normal(embedding) -> F.Column:
    return embedding.cast("array<double>")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row where `is_query` holds."""
    spark = vectors.sparkSession
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _normal(F.col(embedding)).alias("e"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", fine) & F.exists("e", lambda x: x != 0)).distinct()
    few = base.select("e", "vec_id", F.row_number().over(Window.partitionBy("e").orderBy("vec_id")).alias("n")).where(F.col("n") <= k + 1)
    members = few.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))  # k + 1 at most
    entries = cut(base.groupBy("e").agg(F.min("vec_id").alias("rep"), F.max("asks").alias("asks")).join(members, "e").withColumn("dim", F.size("e")))
    asks = base.where("asks").join(entries.select("e", "rep"), "e").select(F.col("vec_id").alias("query_id"), "rep")
    total, asked = entries.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERIES))
    sample = entries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "e").collect()
    centers = {}
    for dim in {r["dim"] for r in sample}:
        x = np.array([r["e"] for r in sample if r["dim"] == dim])
        centers[dim] = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).mean(axis=0)
    shared = spark.sparkContext.broadcast(centers)
    rows = entries.select("dim", F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "rep", "e")
    queries = entries.where("asks").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("rep"), F.lit(query_blocks)).cast("int").alias("q"), "rep", "e")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = _matrix(left["e"]), _matrix(right["e"])
        found = search_block(x, left["rep"].to_numpy(), y, shared.value.get(x.shape[1], np.zeros(x.shape[1])), k + 1)
        names = right["rep"].to_numpy()
        return pa.table({"query": np.concatenate([np.full(len(i), names[q]) for q, i, _ in found]), "rep": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    found = rows.groupBy("dim", "b", "q").cogroup(queries.groupBy("dim", "b", "q")).applyInArrow(search, "query long, rep long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    near = best.join(entries.select("rep", "members"), "rep").select(F.col("query").alias("rep"), F.explode("members").alias("vec_id"), "score")
    pairs = asks.join(near, "rep").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
