"""What changed between two sets of tables, told to an outside index by the executors, part by part.

Rows are compared by key and by a digest of all their columns.  The changes are a table of their own, dealt to parts by key
and stored beside the set that they lead to, so that whoever resumes finds the same parts.  A task hands a part's changes to
a writer and marks the part as told; a part without a mark is told again, so a writer must put and delete by key.  No key
reaches the driver.

Cases: rows of a null key can't be told and are refused; repeated keys in one table are refused; a table that only one of
the sets has is all inserts or all deletes; equal sets have no changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changes of a part.
PART = 50_000
#: A writer gets a part's number and its changes: (table, operation, key, row as JSON or None); operations are insert, update, delete.
Writer = Callable[[int, Iterator[tuple[str, str, str, str | None]]], None]
COLUMNS = "table string, op string, key string, row string"


def _keyed(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame | None:
    parts = []
    for name, key in keys.items():
        if name in tables:
            df = tables[name]
            row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
            parts.append(df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), row.alias("row"), F.md5(row).alias("digest")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def changes(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(table, op, key, row) by which the tables named in `keys`, with their key columns, differ."""
    old, new = _keyed(before, keys), _keyed(after, keys)
    spark = next(iter([*after.values(), *before.values()])).sparkSession
    empty = spark.createDataFrame([], "table string, key string, row string, digest string")
    old, new = (empty if x is None else x for x in (old, new))
    new = new.groupBy("table", "key").agg(F.first("row").alias("row"), F.first("digest").alias("digest"), F.count("*").alias("n"))
    bad = F.raise_error(F.concat(F.lit("a row without a key, or with one that repeats, in "), F.col("table")))
    new = new.select("table", F.when(F.col("key").isNull() | (F.col("n") > 1), bad).otherwise(F.col("key")).alias("key"), "row", "digest")
    old = old.select("table", "key", F.col("digest").alias("old")).where("key IS NOT NULL").dropDuplicates(["table", "key"])
    op = F.when(F.col("old").isNull(), "insert").when(F.col("digest").isNull(), "delete").when(F.col("old") != F.col("digest"), "update")
    return new.join(old, ["table", "key"], "full").select("table", op.alias("op"), "key", "row").where("op IS NOT NULL")


def dealt(changed: DataFrame, part: int = PART) -> DataFrame:
    """Changes with the number of their part, a hash of the key; for a table laid out by `part`."""
    return changed.withColumn("part", F.pmod(F.xxhash64("table", "key"), F.lit(max(1, -(-changed.count() // part)))).cast("int"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(folder)
    return (fs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def told(folder: str) -> set[int]:
    """Parts that are marked in a folder."""
    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {int(x.base_name) for x in found if x.base_name.isdigit()}


def tell(changed: DataFrame, writer: Writer, marks: str) -> int:
    """Hand the parts that `marks` doesn't hold to the writer, each within a task; how many these were."""
    done = told(marks)
    rest = changed.where(~F.col("part").isin(list(done))) if done else changed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        row = next(rows, None)
        while row is not None:
            part = row[0]

            def one(first: tuple) -> Iterator[tuple[str, str, str, str | None]]:
                nonlocal row
                row = first
                while row is not None and row[0] == part:
                    yield row[1:]
                    row = next(rows, None)

            mine = one(row)
            writer(part, mine)
            for _ in mine:  # what a writer left unread is not told again
                pass
            store, path = _store(marks)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{part}"):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    sorted_ = rest.select("part", "table", "op", "key", "row").repartition("part").sortWithinPartitions("part", "table", "key")
    return sorted_.mapInArrow(run, "part int").count()
