"""A stored dense index: coarse cells as partitions, coded residuals, exact scores for what the codes leave open.

Cells are the means that Spark's k-means finds for a bounded sample (SAMPLE vectors) of the first change; later changes are
assigned to them.  A vector is kept in its cell's partition as its unit vector's residual to the cell's mean in 8 bits a
component with a step of its own, the length of what that leaves out, and the vector itself.

A question visits the cells whose means are nearest.  Their codes give each vector an interval for its cosine (the code's
value give or take the length left out), so whatever can't be among the k best of the visited cells goes without its vector
being read; the rest is scored exactly.  Within the visited cells the result is that of brute force.  How many cells to
visit is measured when the cells are made: the fewest that hold RECALL of the nearest neighbours of the sample's questions.

Changes are segments of a `Snapshots` folder as in `segments`.  A cell's vectors are dealt to tasks by parts of about PART,
each met by the questions that visit the cell, so neither a large cell nor a large batch comes to one task.

Cases: vectors that are null, zero, of another length or not finite take no part; so do such questions; an empty index and
an empty batch have no rows; ids repeated within a batch are refused; equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as X

from folioscan.operators.dense import cosine, unit
from folioscan.operators.lexical import top_ranked
from folioscan.operators.settle import settled
from folioscan.sources.tables import Snapshots

SAMPLE, MOST_CELLS, PART = 20_000, 1024, 16_384
#: Share of true neighbours that the visited cells hold, over ASKED questions of the sample with NEAR neighbours each.
RECALL, ASKED, NEAR = 0.95, 200, 10
#: Scores are rounded to six digits; intervals have room for that and for the arithmetic.
SLACK = 2e-6
MEANS = "means"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold `dim` finite components and aren't zero, their unit vectors)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fit = np.flatnonzero(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1) == dim)
    x = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return fit[good], x[good] / length[good, None]


def _nearest(unit_vectors: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The `n` cells nearest to each vector, nearest first."""
    far = (centers * centers).sum(axis=1)[None, :] - 2 * unit_vectors @ centers.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def coded(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit codes, step, length of the rest) of residuals."""
    step = np.abs(residual).max(axis=1, initial=0) / 127
    code = np.rint(residual / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
    return code, step, np.sqrt(((residual - code * step[:, None]) ** 2).sum(axis=1))


class Cells:
    """The index under a folder; `cells` (by default about the square root of the first change's vectors) and its means stay."""

    def __init__(self, spark: SparkSession, folder: str, cells: int | None = None):
        self.spark, self.store, self.cells = spark, Snapshots(spark, folder), cells

    # ------------------------------------------------------------ changes

    def upsert(self, vectors: DataFrame, doc_id: str = "vec_id", embedding: str = "embedding") -> None:
        """Add vectors, in place of those with the same ids."""
        kind = vectors.schema[embedding].dataType
        if not isinstance(kind, X.ArrayType) or not isinstance(kind.elementType, X.NumericType):
            raise TypeError(f"{embedding} must be an array of numbers")
        rows = vectors.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(embedding).cast("array<double>").alias("embedding"))
        base, now = self.store.current()
        now = now or self._made(rows)
        if now is None:
            return
        placed = self._placed(rows, now)
        self._write(base, now, placed, rows.select("doc_id"))

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        base, now = self.store.current()
        if now is not None:
            self._write(base, now, None, ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct())

    def merge(self) -> None:
        """Write the vectors that are left as one segment."""
        base, now = self.store.current()
        if now is not None:
            self._write(base, {**now, "segments": []}, self._left(now).drop("segment"), None)

    def count(self) -> int:
        """Vectors that are left."""
        now = self.store.manifest()
        return 0 if now is None else self._left(now).count()

    def _made(self, rows: DataFrame) -> dict | None:
        """Means of cells, and how many of them a question visits, from a sample."""
        sizes = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        if not sizes:
            return None
        dim, n = sizes[0]
        good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        fit = rows.where((F.size("embedding") == dim) & good)
        sample = settled(fit.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).select(unit(F.col("embedding")).alias("u")).limit(SAMPLE))
        known = np.array([r["u"] for r in sample.collect()], np.float64).reshape(-1, dim)  # no more than SAMPLE
        k = min(self.cells or round(n**0.5), MOST_CELLS, len(np.unique(known, axis=0)))
        if not k:
            return None
        if k == 1:
            centers = known.mean(axis=0, keepdims=True)
        else:
            centers = np.array(KMeans(k=k, seed=1, maxIter=10, featuresCol="v").fit(sample.select(array_to_vector("u").alias("v"))).clusterCenters())
        return {"segments": [], "tables": {}, "dim": int(dim), "means": centers, "visit": self._visit(known, centers)}

    @staticmethod
    def _visit(known: np.ndarray, centers: np.ndarray) -> int:
        asked = known[:: max(1, len(known) // ASKED)][:ASKED]
        near = np.argsort(-(asked @ known.T), axis=1, kind="stable")[:, : NEAR + 1]
        home = _nearest(known, centers, 1)[:, 0]
        place = np.argsort(_nearest(asked, centers, len(centers)), axis=1)  # a cell's place in each question's order
        return int(np.quantile(np.take_along_axis(place, home[near], axis=1), RECALL, method="higher")) + 1

    def _means(self, now: dict) -> np.ndarray:
        """The cells' means: a row for each cell."""
        if "means" in now:
            return now["means"]
        return np.array([r["mean"] for r in sorted(self.store.load_of(now, [MEANS])[MEANS].collect())], np.float64)

    def _placed(self, rows: DataFrame, now: dict) -> DataFrame:
        """(doc_id, cell, code, step, rest, embedding)."""
        centers, dim = self._means(now), now["dim"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, u = _matrix(batch.column(1), dim)
                cell = _nearest(u, centers, 1)[:, 0]
                code, step, rest = coded(u - centers[cell])
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(rest), kept.column(1)], names=["doc_id", "cell", "code", "step", "rest", "embedding"])

        return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, cell int, code binary, step double, rest double, embedding array<double>")

    def _write(self, base: int, now: dict, rows: DataFrame | None, gone: DataFrame | None) -> None:
        n = max([*now["segments"], now.get("last", 0)]) + 1
        staged: dict = {"tables": {}, "schemas": {}}

        def stage(name: str, df: DataFrame, by: str | None = None) -> DataFrame:
            done = self.store.stage({name: df}, staged.get("snapshot"), {name: by} if by else None)
            staged.update(snapshot=done["snapshot"], **{x: {**staged[x], **done[x]} for x in ("tables", "schemas")})
            return self.store.staged(done)[name]

        if "means" in now:
            stage(MEANS, self.spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(now["means"])], "cell int, mean array<double>"))
        sizes: dict[str, int] = {}
        if rows is not None:
            # a large cell is dealt to several tasks, which write a file each
            kept = stage(f"vectors-{n:06d}", rows.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("cell"), "cell")
            seen = kept.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
            if seen["n"] != seen["ids"]:
                raise ValueError("a batch must not repeat ids")
            sizes = {str(r["cell"]): r["count"] for r in kept.groupBy("cell").count().collect()}  # a row for each cell
        if gone is not None and now["segments"]:
            stage(f"dead-{n:06d}", self._left(now, gone).select("doc_id", "segment"))
        keep = [k for k in now["tables"] if k == MEANS or int(k.rpartition("-")[2]) in now["segments"]]
        before = now.get("sizes", {}) if now["segments"] else {}
        facts = {k: now[k] for k in ("dim", "visit")}
        self.store.publish(staged, keep, base, segments=[*now["segments"], n], last=n, sizes={k: before.get(k, 0) + sizes.get(k, 0) for k in {*before, *sizes}}, **facts)

    def _all(self, table: str, manifest: dict) -> DataFrame | None:
        names = [k for k in manifest["tables"] if k != MEANS and k.startswith(f"{table}-") and int(k.rpartition("-")[2]) in manifest["segments"]]
        parts = [df if table == "dead" else df.withColumn("segment", F.lit(int(k.rpartition("-")[2]))) for k, df in self.store.load_of(manifest, names).items()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _left(self, now: dict, only: DataFrame | None = None) -> DataFrame:
        rows, dead = self._all("vectors", now), self._all("dead", now)
        if only is not None:
            rows = rows.join(only, "doc_id", "left_semi")
        return rows if dead is None else rows.join(dead, ["doc_id", "segment"], "left_anti")

    # ------------------------------------------------------------ questions

    def retrieve(self, queries: DataFrame, k: int, visit: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) by cosine over the cells that each question visits; all cells give brute force."""
        now = self.store.manifest()
        vectors = None if now is None else self._all("vectors", now)
        types = {"query_id": dict(queries.dtypes)["query_id"], "doc_id": "long" if vectors is None else dict(vectors.dtypes)["doc_id"]}
        if vectors is None:
            return self.spark.createDataFrame([], f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double, rank long")
        centers, dim = self._means(now), now["dim"]
        visit = min(visit or now["visit"], len(centers))
        parts = {int(c): -(-n // PART) for c, n in now["sizes"].items()}

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each question, cell it visits, and part of that."""
            for batch in batches:
                at, u = _matrix(batch.column(1), dim)
                cells = _nearest(u, centers, visit)
                rows = [(i, c, p) for i, cs in enumerate(cells.tolist()) for c in cs for p in range(parts.get(c, 0))]
                i = np.array([r[0] for r in rows], np.int64)
                flat = pa.array(u[i].ravel())
                edge = pa.array(np.arange(len(rows) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[i])), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.ListArray.from_arrays(edge, flat)], names=["query_id", "cell", "part", "u"])

        asked = settled(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
        routed = asked.mapInArrow(route, f"query_id {types['query_id']}, cell int, part int, u array<double>")
        wanted = sorted(r["cell"] for r in routed.select("cell").distinct().collect())  # no more than there are cells
        here = vectors.where(F.col("cell").isin(wanted))
        dead = self._all("dead", now)
        if dead is not None:
            here = here.join(dead, ["doc_id", "segment"], "left_anti")
        count = F.create_map(*[F.lit(x) for c, n in sorted(parts.items()) for x in (c, n)])[F.col("cell")] if parts else F.lit(1)
        dealt = here.withColumn("part", F.pmod(F.xxhash64("doc_id"), count.cast("long")).cast("int"))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            """Vectors of a part of a cell whose interval reaches the k-th lower end there, for each question that visits it."""
            found = []
            if left.num_rows and right.num_rows:
                code = np.frombuffer(b"".join(left["code"].to_pylist()), np.int8).reshape(left.num_rows, dim)
                step, rest, mean = left["step"].to_numpy(), left["rest"].to_numpy(), centers[left["cell"][0].as_py()]
                for a in range(0, right.num_rows, 128):
                    some = right.slice(a, 128)
                    q = some["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    about = (q @ mean)[:, None] + (q @ code.T.astype(np.float64)) * step
                    low = about - rest
                    floor = np.partition(low, -k, axis=1)[:, -k] if left.num_rows > k else np.full(len(q), -np.inf)
                    i, j = np.nonzero(about + rest >= floor[:, None] - SLACK)
                    found.append((some["query_id"].combine_chunks().take(pa.array(i)), left["doc_id"].combine_chunks().take(pa.array(j)), pa.array(low[i, j]), pa.array((about + rest)[i, j])))
            names = ["query_id", "doc_id", "low", "high"]
            cell = [left["cell"][0].as_py() if left.num_rows else 0]
            out = pa.concat_tables([pa.table(dict(zip(names, f, strict=True))) for f in found]) if found else None
            if out is None:
                return pa.table({"query_id": right["query_id"].slice(0, 0), "doc_id": left["doc_id"].slice(0, 0), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64()), "cell": pa.array([], pa.int32())})
            return out.append_column("cell", pa.array(cell * out.num_rows, pa.int32()))

        slim = dealt.select("doc_id", "cell", "part", "code", "step", "rest")
        open_ = settled(slim.groupBy("cell", "part").cogroup(routed.groupBy("cell", "part")).applyInArrow(meet, f"query_id {types['query_id']}, doc_id {types['doc_id']}, low double, high double, cell int"))
        kth = top_ranked(open_, k, "low").where(F.col("rank") == k).select("query_id", F.col("low").alias("floor"))
        left = open_.join(kth, "query_id", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor") - SLACK)).select("query_id", "doc_id", "cell")
        exact = left.join(here.select("doc_id", "cell", F.col("embedding").alias("e")), ["doc_id", "cell"]).join(asked, "query_id")
        return top_ranked(exact.select("query_id", "doc_id", F.round(cosine(F.col("e"), F.col("embedding")), 6).alias("score")), k).select("query_id", "doc_id", "score", "rank")
