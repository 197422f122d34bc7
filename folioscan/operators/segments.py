"""A stored BM25 index that follows upserts and deletes.

The index is a row of immutable segments kept by `Snapshots`; a change writes one more and a manifest.  A segment has

- `postings` (term, slot, n, at, tf), laid out by `bucket`, a hash of the term: the places of a term's n documents in a slot and
  their counts; a slot that arrives in several batches has a row from each.  Bucket DOCS has rows without a term, in which `tf`
  is the lengths of a slot's documents and `docs` their ids,
- `documents` (doc_id, slot, at, dl): those rows, a document each,
- `terms` (term, df), laid out like postings: what the change adds to a term's document frequency, below zero for what it takes away,
- `dead` (doc_id, segment, slot, at): documents of earlier segments that the change replaces or deletes.

Frequencies, the number of documents and their length are sums over segments.  A change that takes documents away counts its
slots' postings whose places are among theirs, and reads nothing else of older segments but `documents` and the small
`terms`, whose mean weight goes into the manifest.

A slot is up to SLOT documents that one task wrote, so postings are counted and turned in one pass within the tasks that read
the texts, without a shuffle.  Questions send the postings of asked terms and the lengths of documents to a task for each slot,
which scores its documents for all questions and passes on the k best of each: what is shuffled doesn't grow with the number
of questions times documents.

Readers open the buckets of the asked terms alone.  Scores, ties and cuts are those of `lexical.retrieve` over the documents
that are left: the results equal those of an index built anew.

Cases: rows without doc_id are left out; ids repeated within a batch are refused; null and empty texts have the one token `_`;
deleting unknown ids changes nothing; an index without documents answers with no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscan.functions.text import index_tokens
from folioscan.operators import scoring
from folioscan.operators.lexical import FLOOR, query_terms, top_ranked
from folioscan.operators.settle import settled
from folioscan.sources.tables import Snapshots

#: Documents of a slot (a power of two), and buckets of terms.
SLOT, BUCKETS = 4096, 32
#: Segments from which a change merges them; questions that were scored first when slots were pruned, kept for callers that set it.
SEGMENTS, FIRST = 8, 4
#: Of the tables: 3 has postings by places in a slot.
FORMAT = 3
#: The bucket of a slot's own rows, and words that are turned at once.
DOCS, TURNED = -1, 1 << 22


def _known_format(manifest: dict | None) -> None:
    if manifest is not None and manifest.get("index_format") != FORMAT:
        raise ValueError("an index of another format: build it anew")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Segments:
    """The index under a folder; `buckets` holds for the first change and stays."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets = spark, Snapshots(spark, folder), buckets

    # ------------------------------------------------------------ changes

    def upsert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Add documents, in place of those with the same ids."""
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), index_tokens(F.col(text)).alias("terms"))
        self._change(rows, None)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        self._change(None, ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).distinct())

    def merge(self) -> None:
        """Write the documents that are left as one segment; the next change builds on that."""
        base, now = self.store.current()
        if now is not None:
            self._write(base, {**now, "segments": [], "n_docs": 0, "length": 0}, self._words(now), None)

    def prune(self) -> None:
        """Delete segments that no manifest needs; readers of older sets must be done."""
        self.store.prune()

    def _left(self, now: dict, only: DataFrame | None = None) -> DataFrame:
        """(doc_id, slot, at, dl, segment) of the documents that are left, or of those in `only`."""
        rows = self._all("documents", now)
        if only is not None:
            rows = rows.join(only, "doc_id", "left_semi")
        if not any(t.startswith("dead-") for t in now["tables"]):
            return rows
        return rows.join(self._all("dead", now).select("doc_id", "segment"), ["doc_id", "segment"], "left_anti")

    def _postings(self, now: dict) -> DataFrame:
        return self._all("postings", now).where(F.col("bucket") != DOCS).select("segment", "slot", "bucket", "term", "n", "at", "tf")

    def _words(self, now: dict) -> DataFrame:
        """(doc_id, words) of the documents that are left: each slot's postings turned back."""
        left = self._left(now)
        run, schema = _turned_back(left.schema["doc_id"].dataType)
        return self._postings(now).select("segment", "slot", "term", "at", "tf").groupBy("segment", "slot").cogroup(left.groupBy("segment", "slot")).applyInArrow(run, schema)

    def _taken(self, now: dict, dead: DataFrame) -> DataFrame:
        """(term, df): by how many documents each term's frequency falls, from the slots that `dead` is in.  The places that
        go are sent as bits, 512 bytes for a slot, so that no document's terms need to be listed."""
        word = dead.groupBy("segment", "slot", F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("b"))
        slots = word.groupBy("segment", "slot").agg(F.map_from_entries(F.collect_list(F.struct("i", "b"))).alias("m"), F.max("i").alias("most"))
        bits = slots.select("segment", "slot", F.expr("transform(sequence(0, most), i -> coalesce(try_element_at(m, i), 0L))").alias("bits"))
        hit = F.expr("size(filter(at, p -> (shiftright(coalesce(get(bits, shiftright(p, 6)), 0L), p & 63) & 1L) = 1L))")
        return self._postings(now).join(bits, ["segment", "slot"]).select("term", hit.cast("long").alias("n")).where("n > 0").groupBy("term").agg((-F.sum("n")).alias("df"))

    def _change(self, rows: DataFrame | None, gone: DataFrame | None) -> None:
        base, now = self.store.current()
        _known_format(now)
        now = now or {"segments": [], "buckets": self.buckets, "n_docs": 0, "length": 0, "tables": {}}
        if rows is not None:
            gone = rows.select("doc_id")
        dead = settled(self._left(now, gone).select("doc_id", "dl", "segment", "slot", "at")) if now["segments"] else None
        if rows is None and (dead is None or dead.isEmpty()):
            return
        self._write(base, now, rows, dead)
        if len(self.store.manifest()["segments"]) > SEGMENTS:
            self.merge()

    def _write(self, base: int, now: dict, rows: DataFrame | None, dead: DataFrame | None) -> None:
        n = max([*now["segments"], now.get("last", 0)]) + 1
        name, buckets = f"{n:06d}", now["buckets"]
        staged: dict = {"tables": {}, "schemas": {}}

        def stage(table: str, df: DataFrame, by: str | None = None) -> DataFrame:
            done = self.store.stage({f"{table}-{name}": df}, staged.get("snapshot"), {f"{table}-{name}": by} if by else None)
            staged.update(snapshot=done["snapshot"], **{x: {**staged[x], **done[x]} for x in ("tables", "schemas")})
            return self.store.staged(done)[f"{table}-{name}"]

        facts = {"n_docs": now["n_docs"], "length": now["length"]}
        delta = []
        if rows is not None:
            turned = _turned(rows.withColumn("row", F.monotonically_increasing_id())).withColumn("bucket", F.when(F.col("term").isNull(), DOCS).otherwise(_bucket(F.col("term"), buckets)))
            postings = stage("postings", turned.sortWithinPartitions("bucket", "term", "slot"), "bucket")
            own = postings.where(F.col("bucket") == DOCS).select("slot", F.explode(F.arrays_zip("docs", "at", "tf")).alias("x"))
            documents = stage("documents", own.select(F.col("x.docs").alias("doc_id"), "slot", F.col("x.at").alias("at"), F.col("x.tf").cast("long").alias("dl")))
            added = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.count_distinct("doc_id").alias("ids")).first()
            if added["n"] != added["ids"]:
                raise ValueError("a batch must not repeat ids")
            facts = {"n_docs": facts["n_docs"] + added["n"], "length": facts["length"] + added["length"]}
            delta.append(postings.where(F.col("bucket") != DOCS).groupBy("term").agg(F.sum("n").alias("df")))
        if dead is not None:
            stage("dead", dead.select("doc_id", "segment", "slot", "at"))
            taken = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
            facts = {"n_docs": facts["n_docs"] - taken["n"], "length": facts["length"] - taken["length"]}
            delta.append(self._taken(now, dead))
        changed = reduce(DataFrame.unionByName, delta).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", _bucket(F.col("term"), buckets))
        terms = stage("terms", changed.repartition("bucket").sortWithinPartitions("bucket", "term"), "bucket").select("term", "df")
        if now["segments"]:
            terms = terms.unionByName(self._all("terms", now).select("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = F.log(F.lit(facts["n_docs"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        facts["mean_idf"] = terms.agg(F.avg(raw)).first()[0] or 0.0
        keep = [k for k in now["tables"] if int(k.rpartition("-")[2]) in now["segments"]]
        self.store.publish(staged, keep, base, segments=[*now["segments"], n], last=n, buckets=buckets, index_format=FORMAT, **facts)

    def _all(self, table: str, manifest: dict) -> DataFrame:
        """A table of all segments, with `segment`, read only where it is there."""
        found = self.store.load_of(manifest, [k for k in manifest["tables"] if k.startswith(f"{table}-") and int(k.rpartition("-")[2]) in manifest["segments"]])
        parts = [df if table == "dead" else df.withColumn("segment", F.lit(int(k.rpartition("-")[2]))) for k, df in found.items()]
        if parts:
            return reduce(DataFrame.unionByName, parts)
        kind = "string" if table != "dead" else next((dict(df.dtypes)["doc_id"] for k, df in self.store.load_of(manifest, manifest["tables"]).items() if k.startswith("documents-")), "string")
        return self.spark.createDataFrame([], {"dead": f"doc_id {kind}, segment int, slot long, at int", "terms": "term string, df long, bucket int, segment int"}.get(table, f"doc_id {kind}, slot long, at int, dl long, segment int"))

    # ------------------------------------------------------------ questions

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): as `lexical.retrieve` over the documents that are left."""
        now = self.store.manifest()
        _known_format(now)
        postings = {} if now is None else self.store.load_of(now, [t for t in now["tables"] if t.startswith("postings-")])
        if not postings or not now["n_docs"]:
            kind = next((df.schema["docs"].dataType.elementType.simpleString() for df in postings.values()), "string")
            return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, doc_id {kind}, score double, rank long")
        asked = query_terms(queries).withColumn("bucket", _bucket(F.col("term"), now["buckets"]))
        asked = settled(asked)
        wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # no more than there are buckets
        open_ = F.col("bucket").isin(wanted)
        df = self._all("terms", now).where(open_).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = F.log(F.lit(now["n_docs"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, FLOOR * now["mean_idf"]).otherwise(raw)
        weights = settled(asked.join(df, "term").select("query_id", "term", (F.col("qf") * idf).alias("w")))
        blocks = self._postings(now).where(open_).select("segment", "slot", "term", "at", "tf")
        left = self._left(now).select("segment", "slot", "at", "doc_id", "dl")
        kind = left.schema["doc_id"].dataType.simpleString()
        parts = []
        for batch, names in scoring.passes(weights, now["length"] / now["n_docs"]):
            terms = F.broadcast(self.spark.createDataFrame([(t,) for t in batch.terms.to_pylist()], "term string"))  # one pass's terms
            groups = blocks.join(terms, "term", "left_semi").groupBy("segment", "slot")
            run = _scorer(self.spark.sparkContext.broadcast(batch), k, left.schema["doc_id"].dataType)
            found = groups.cogroup(left.groupBy("segment", "slot")).applyInArrow(run, f"q int, doc_id {kind}, score double")
            parts.append(scoring.named(found, names))
        if not parts:
            return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, doc_id {kind}, score double, rank long")
        return top_ranked(scoring.union(parts), k).select("query_id", "doc_id", "score", "rank")


def _turned(rows: DataFrame) -> DataFrame:
    """(term, slot, n, at, tf, docs) of rows (doc_id, row and terms, or words with their counts) in the tasks that read them."""
    kind, words = rows.schema["doc_id"].dataType, "words" if "words" in rows.columns else "terms"
    schema = f"term string, slot long, n int, at array<int>, tf array<int>, docs array<{kind.simpleString()}>"
    listed, ids, room = pa.list_(pa.int32()), pa.list_(to_arrow_type(kind)), SLOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, room):
                each, row = batch.column(words), batch.column("row").to_numpy()
                size = pc.fill_null(each.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat, doc = each.flatten(), np.repeat(np.arange(len(row)), size)
                weight = None
                if words == "words":
                    flat, weight = pc.struct_field(flat, [0]), pc.struct_field(flat, [1]).to_numpy(zero_copy_only=False)
                coded, at, slot = flat.dictionary_encode(), (row % room).astype(np.int32), int(row[0] - row[0] % room)
                key, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(row) + doc, np.int64(len(row))
                length = size if weight is None else np.bincount(doc, weight, len(row)).astype(np.int64)
                if weight is None:
                    key, tf = np.unique(key, return_counts=True)  # a word of a document, and how often it is there
                else:
                    order = np.argsort(key, kind="stable")
                    key, tf = key[order], weight[order]
                starts = np.flatnonzero(np.diff(key // n, prepend=-1))
                ends = np.append(starts, len(key)).astype(np.int32)
                arrays = lambda values, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                terms = coded.dictionary.take(pa.array(key[starts] // n))
                yield pa.RecordBatch.from_arrays(
                    [terms, pa.array(np.full(len(starts), slot)), pa.array(np.diff(ends), pa.int32()), arrays(at[key % n]), arrays(tf), pa.nulls(len(starts), ids)],
                    names=["term", "slot", "n", "at", "tf", "docs"],
                )
                own = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), batch.column("doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.string()), pa.array([slot]), pa.array([len(row)], pa.int32()), pa.array([at], listed), pa.array([length.astype(np.int32)], listed), own],
                    names=["term", "slot", "n", "at", "tf", "docs"],
                )

    return rows.select("doc_id", "row", words).mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, room: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one slot with at most TURNED words, or one row."""
    slots = batch.column("row").to_numpy() // room
    ends = np.cumsum(pc.fill_null(batch.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(int(np.searchsorted(slots, slots[start], "right")), int(np.searchsorted(ends, before + TURNED, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def _places(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slot's postings x and documents y, for each entry of a document that is left: the row in x, the row in y, the count."""
    lists = x["at"].combine_chunks()
    row = np.repeat(np.arange(x.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    at, here = lists.flatten().to_numpy(zero_copy_only=False), y["at"].to_numpy()
    known = np.full(max(at.max(initial=0), here.max(initial=0)) + 1, -1)
    known[here] = np.arange(len(here))
    left = known[at] >= 0
    return row[left], known[at][left], x["tf"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[left]


def _turned_back(kind):
    ids, words = to_arrow_type(kind), pa.list_(pa.struct([("value", pa.string()), ("n", pa.int64())]))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"doc_id": pa.array([], ids), "words": pa.array([], words)})
        row, doc, tf = _places(x, y)
        order = np.argsort(doc, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=y.num_rows))])
        each = pa.StructArray.from_arrays([x["term"].combine_chunks().take(pa.array(row[order])), pa.array(tf[order], pa.int64())], ["value", "n"])
        return pa.table({"doc_id": y["doc_id"].combine_chunks(), "words": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)})

    return run, f"doc_id {kind.simpleString()}, words array<struct<value: string, n: long>>"


def _scorer(known, k: int, kind):
    ids = to_arrow_type(kind)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        batch: scoring.Batch = known.value
        if not x.num_rows or not y.num_rows:
            return pa.table({"q": pa.array([], pa.int32()), "doc_id": pa.array([], ids), "score": pa.array([], pa.float64())})
        row, doc, tf = _places(x, y)
        term = pc.index_in(x["term"].combine_chunks(), batch.terms).to_numpy(zero_copy_only=False)[row]
        docs, dl = y["doc_id"].combine_chunks(), y["dl"].to_numpy().astype(np.float64)
        q, d, s = batch.best(docs, batch.scores(term, doc, tf, dl, len(docs)), k)
        return pa.table({"q": pa.array(q, pa.int32()), "doc_id": docs.take(pa.array(d, pa.int64())), "score": pa.array(s)})

    return run
