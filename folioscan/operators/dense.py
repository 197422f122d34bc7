"""Dense retrieval: hashed bags of words and exact cosine ranking within a filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscan.functions.text import let, run_lengths, tokens
from folioscan.operators.lexical import top_ranked

BUCKETS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(e: Column) -> Column:
    """A vector divided by its length, in double precision; the length is found once."""
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(length, lambda n: F.transform(e, lambda x: x.cast("double") / n))


def _cosines(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of the unit vectors q, cosine) of all that reach the k-th best of x, ties included."""
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ q.T
    best = np.argsort(-cos, axis=0, kind="stable")
    floor = cos[best[min(k, len(x)) - 1], np.arange(len(q))] - 1e-6
    r, c = np.nonzero(~(cos < floor))
    return r, c, cos[r, c]


def _rows(column: pa.Array | pa.ChunkedArray, dim: int, at: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(at))
    part = part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def retrieve(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", most: int = 1 << 20) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine, rounded to six digits; filter `vectors` first for an allow-list.

    Every vector meets every question of the batch, in Arrow batches: the questions' unit vectors are one matrix that is
    sent to the executors if it has no more than `most` components, which is counted first.  Larger batches are dealt to
    blocks of that size, and each block of vectors meets each of them in a task of its own.
    """
    types = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[id_col]
    batch_type = to_arrow_type(queries.schema["query_id"].dataType)
    some = vectors.where(F.col(embedding).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(embedding).alias("e"))
    size = queries.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    if size > most:
        return top_ranked(_in_blocks(some, queries, k, -(-size // most), types, most), k)
    by_dim: dict[int, tuple[list, np.ndarray]] = {}
    for r in queries.select("query_id", unit(F.col("embedding")).alias("q")).collect():
        if r["q"]:
            by_dim.setdefault(len(r["q"]), ([], []))  # type: ignore[arg-type]
            by_dim[len(r["q"])][0].append(r["query_id"])
            by_dim[len(r["q"])][1].append(r["q"])
    shared = vectors.sparkSession.sparkContext.broadcast({d: (ids, np.array(q)) for d, (ids, q) in by_dim.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = batch.column(0), batch.column(1)
            size = np.diff(values.offsets.to_numpy())
            for dim, (ids, q) in shared.value.items():
                rows = np.flatnonzero(size == dim)
                if not len(rows):
                    continue
                r, c, cos = _cosines(_rows(values, dim, rows), q, k)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in c.tolist()], batch_type), names.take(pa.array(rows[r])), pa.array(cos)], names=["query_id", "doc_id", "score"])

    pairs = some.mapInArrow(score, f"query_id {types[0]}, doc_id {types[1]}, score double")
    return top_ranked(pairs.select("query_id", "doc_id", F.round("score", 6).alias("score")), k)


def _in_blocks(vectors: DataFrame, queries: DataFrame, k: int, blocks: int, types: tuple[str, str], most: int) -> DataFrame:
    """(query_id, doc_id, score) of what may be among the k best, from a task for each block of vectors and of questions."""
    held = vectors.agg(F.sum(F.size("e").cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, -(-held // (4 * most)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("v", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("q", every(blocks))
    right = queries.where(F.size("embedding") > 0).select("query_id", unit(F.col("embedding")).alias("u"), F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(blocks)).alias("q")).withColumn("v", every(parts))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        none = pa.table({"query_id": y["query_id"].slice(0, 0), "doc_id": x["doc_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        found = [none]
        if x.num_rows and y.num_rows:
            size_x, size_y = (t.combine_chunks().value_lengths().to_numpy() for t in (x["e"], y["u"]))
            for dim in np.intersect1d(size_x, size_y).tolist():
                rows, asked = np.flatnonzero(size_x == dim), np.flatnonzero(size_y == dim)
                values = _rows(x["e"], dim, rows)
                for a in range(0, len(asked), 128):
                    some = asked[a : a + 128]
                    r, c, cos = _cosines(values, _rows(y["u"], dim, some), k)
                    found.append(pa.table({"query_id": y["query_id"].take(pa.array(some[c])), "doc_id": x["doc_id"].take(pa.array(rows[r])), "score": pa.array(cos)}))
        return pa.concat_tables(found)

    pairs = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(meet, f"query_id {types[0]}, doc_id {types[1]}, score double")
    return pairs.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def hash_embedding(docs: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, bucket, weight): hashed bag of words, counts divided by their Euclidean norm, one row for each entry.

    A bucket is the first 32 bits of the word's SHA-1 modulo the number of buckets.  All happens within the row.
    """
    bucket = lambda t: F.pmod(F.conv(F.substring(F.sha1(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    counts = run_lengths(F.transform(tokens(F.col(text)), bucket))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"]))
    weights = let(counts, lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.struct(x["value"].alias("bucket"), F.round(x["n"] / n, 9).alias("weight")))))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(weights).alias("x")).select("doc_id", "x.bucket", "x.weight")


def dense_array(sparse: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, embedding) from the rows of hash_embedding."""
    entries = sparse.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "weight"))).alias("m"))
    return entries.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("embedding"))
