"""Which of many needles a text contains: one automaton over a batch's needles reads each text once.

Joins by `contains` compare every text with every needle; here a text costs its length and its matches.  The needles' bytes
are counted first: up to MOST they go to the executors as one list, more are dealt to blocks of that size, each of which
meets each block of texts in a task of its own.

Cases: null texts and needles match nothing; an empty needle is in every text; needles that repeat count once; texts that
repeat count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of needles in one automaton, and of texts that meet a block of needles in one task.
MOST, TEXTS = 4 << 20, 64 << 20


class _Needles:
    """An automaton for each group's needles."""

    def __init__(self, needles: list[tuple[str, str]]):
        self.empty = {g for g, n in needles if n == ""}
        self.automata: dict[str, ahocorasick.Automaton] = {}
        for g, n in needles:
            if n:
                self.automata.setdefault(g, ahocorasick.Automaton()).add_word(n, n)
        for a in self.automata.values():
            a.make_automaton()

    def match(self, groups: list, texts: list) -> tuple[list[int], list[str]]:
        rows, found = [], []
        for i, (g, t) in enumerate(zip(groups, texts, strict=True)):
            if t is None:
                continue
            here = {n for _, n in self.automata[g].iter(t)} if g in self.automata else set()
            if g in self.empty:
                here.add("")
            rows += [i] * len(here)
            found += sorted(here)
        return rows, found


def containing(texts: DataFrame, needles: DataFrame, most: int = MOST) -> DataFrame:
    """(id, grp, needle) of texts (id, grp, text) and needles (grp, needle) of the same grp that they contain."""
    texts = texts.select("id", F.col("grp").cast("string"), F.col("text").cast("string")).where("text IS NOT NULL AND grp IS NOT NULL")
    needles = needles.select(F.col("grp").cast("string"), F.col("needle").cast("string")).where("needle IS NOT NULL AND grp IS NOT NULL").distinct()
    size = needles.agg(F.sum(F.octet_length("needle").cast("long") + F.octet_length("grp") + 16).alias("n")).first()["n"] or 0
    schema = f"id {dict(texts.dtypes)['id']}, grp string, needle string"
    kind = to_arrow_type(texts.schema["id"].dataType)
    if size > most:
        return _in_blocks(texts, needles, -(-size // most), schema, kind)
    known = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in needles.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Needles(known.value)
        for batch in batches:
            rows, found = matcher.match(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string())], names=["id", "grp", "needle"])

    return texts.mapInArrow(run, schema)


def _in_blocks(texts: DataFrame, needles: DataFrame, blocks: int, schema: str, kind: pa.DataType) -> DataFrame:
    held = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, -(-held // TEXTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.withColumn("t", F.pmod(F.xxhash64("id", "text"), F.lit(parts))).withColumn("n", every(blocks))
    right = needles.withColumn("n", F.pmod(F.xxhash64("needle"), F.lit(blocks))).withColumn("t", every(parts))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        rows, found = _Needles(list(zip(y["grp"].to_pylist(), y["needle"].to_pylist(), strict=True))).match(x["grp"].to_pylist(), x["text"].to_pylist())
        at = pa.array(rows, pa.int64())
        ids = x["id"].take(at) if x.num_rows else pa.array([], kind)
        return pa.table({"id": ids, "grp": x["grp"].take(at) if x.num_rows else pa.array([], pa.string()), "needle": pa.array(found, pa.string())})

    return left.groupBy("t", "n").cogroup(right.groupBy("t", "n")).applyInArrow(meet, schema)
