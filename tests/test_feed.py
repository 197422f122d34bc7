"""Changes between sets, told by executors: what differs, crashes between parts, no part told twice after its mark."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscan.plans import ingest
from folioscan.sources import feed, journal, tables
from test_sync import items


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, w array<int>").repartition(3)


def test_changes(spark):
    old, new = table(spark, [("a", 1, [1]), ("b", 2, None), ("c", 3, []), ("d", None, None)]), table(spark, [("a", 1, [1]), ("b", 2, [0]), ("d", None, None), ("e", 5, None)])
    got = {(r.table, r.op, r.key): r.row for r in feed.changes({"t": old, "gone": old}, {"t": new, "fresh": new}, {"t": "k", "gone": "k", "fresh": "k"}).collect()}
    assert {k for k in got if k[0] == "t"} == {("t", "update", "b"), ("t", "delete", "c"), ("t", "insert", "e")}
    assert len([k for k in got if k[:2] == ("gone", "delete")]) == 4 and len([k for k in got if k[:2] == ("fresh", "insert")]) == 4
    assert json.loads(got["t", "update", "b"]) == {"k": "b", "v": 2, "w": [0]} and got["t", "delete", "c"] is None
    assert feed.changes({"t": new}, {"t": new}, {"t": "k"}).count() == 0 and feed.changes({}, {"t": new}, {"t": "k"}).count() == 4
    for bad in ([("a", 1, None), ("a", 2, None)], [(None, 1, None)]):
        with pytest.raises(Exception, match="key"):
            feed.changes({}, {"t": table(spark, bad)}, {"t": "k"}).collect()


def writer_to(folder):
    """Puts a file for each key into a folder, logs the parts that were told, and fails where it is told to."""
    folder = str(folder)
    os.makedirs(f"{folder}/rows", exist_ok=True)

    def tell(part, changes):
        for i, (name, op, key, row) in enumerate(changes):
            if i == 1 and part == 1 and os.path.exists(f"{folder}/fail"):
                raise ConnectionError("the index is away")
            at = Path(f"{folder}/rows/{name}-{key.replace('/', '_')}")
            if op == "delete":
                at.unlink(missing_ok=True)
            else:
                at.write_text(row)
        with open(f"{folder}/log", "a") as f:
            f.write(f"{part}\n")

    return tell


def rows_in(folder):
    return {x.name: x.read_text() for x in (folder / "rows").iterdir()}


def test_a_crash_between_parts_is_resumed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "PART", 10)
    monkeypatch.setattr(feed.dealt, "__defaults__", (10,))
    s, out = tables.Snapshots(spark, str(tmp_path / "kb")), writer_to(tmp_path / "out")
    j = journal.Journal(s)
    one = table(spark, [(f"k{i}", i, None) for i in range(60)])
    (tmp_path / "out" / "fail").touch()
    with pytest.raises(Exception, match="away"):
        j.execute("upsert", {"t": one}, [], writer=out, keys={"t": "k"})
    assert j.pending() and s.load() == {} and len(rows_in(tmp_path / "out")) < 60
    with pytest.raises(ValueError, match="writer"):
        j.recover()
    (tmp_path / "out" / "fail").unlink()
    assert j.recover(writer=out) == "remote_pending" and not j.pending()
    assert {json.loads(x)["k"] for x in rows_in(tmp_path / "out").values()} == {f"k{i}" for i in range(60)} == {r.k for r in s.load()["t"].collect()}
    assert sorted(map(int, (tmp_path / "out" / "log").read_text().split())) == list(range(6))  # each part once: the one that failed was not marked
    two = one.where("v >= 20").withColumn("v", F.when(F.col("v") < 30, -F.col("v")).otherwise(F.col("v")))
    j.execute("delete", {"t": two}, [], writer=out, keys={"t": "k"})
    assert sorted((json.loads(x)["k"], json.loads(x)["v"]) for x in rows_in(tmp_path / "out").values()) == sorted((r.k, r.v) for r in two.collect())
    assert [x for x in s.files.names() if len(x) == 32 and "feed" in tables.Files(spark, f"{s.folder}/{x}").names()] == []


def test_ingest_tells_rows_without_ids_on_the_driver(spark, tmp_path):
    s, out = tables.Snapshots(spark, str(tmp_path / "kb")), writer_to(tmp_path / "out")
    assert ingest.ingest(items(spark, ["a", "b"]), s, writer=out)["documents"] == 2
    ingest.ingest(items(spark, ["b", "c"]), s, writer=out)
    ingest.remove(s, ["a"], writer=out)
    now = s.load()
    want = {f"{t}-{r[k]}" for t, k in ingest.OUTSIDE.items() for r in now[t].collect()}
    assert set(rows_in(tmp_path / "out")) == {x.replace("/", "_") for x in want} and want
