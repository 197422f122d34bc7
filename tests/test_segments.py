"""The stored BM25 index: random changes against an index built anew, pruning, odd batches, writers that collide."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import lexical, segments

WORDS = [f"w{i}" for i in range(40)]


def text_of(r):
    return " ".join(r.choice(WORDS[: r.choice([4, 12, 40])]) for _ in range(r.randint(0, 40)))


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "doc_id long, text string").repartition(3)


def asked(spark):
    texts = ["w0 w0 w7", "w39", "w1 w2 w3 w30 w31", "nothing here", "", "_", "w5 W5 w5"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SLOT", 4)
    monkeypatch.setattr(segments, "FIRST", 2)
    monkeypatch.setattr(segments, "SEGMENTS", 3)
    r = random.Random(1)
    index = segments.Segments(spark, str(tmp_path / "index"), buckets=4)
    known = {}
    for step in range(5):
        if step % 3 == 2:
            gone = r.sample(range(90), 25)
            index.delete(spark.createDataFrame([(i,) for i in gone] + [(None,), (gone[0],)], "doc_id long"))
            known = {k: v for k, v in known.items() if k not in gone}
        else:
            new = {i: r.choice([text_of(r), text_of(r), text_of(r), None]) for i in r.sample(range(80), 45)}
            index.upsert(frame(spark, new))
            known |= new
        want = rows_of(lexical.retrieve(frame(spark, known), asked(spark), 5))
        assert want and rows_of(index.retrieve(asked(spark), 5)) == want
    assert len(index.store.manifest()["segments"]) <= 3
    index.prune()
    assert index.store.validate() == [] and rows_of(index.retrieve(asked(spark), 5)) == want


def test_readers_open_only_the_buckets_of_asked_terms(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "index"), buckets=16)
    index.upsert(frame(spark, {i: text_of(random.Random(i)) for i in range(60)}))
    name = next(k for k in index.store.manifest()["tables"] if k.startswith("postings"))
    files = [f for f in index.store.load()[name].inputFiles()]
    assert len({f.rpartition("bucket=")[2].partition("/")[0] for f in files}) > 4
    plan = index.retrieve(spark.createDataFrame([(1, "w3")], "query_id long, text string"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_slots_below_the_threshold_are_not_read(spark, tmp_path, monkeypatch):
    """A question whose best documents are in one slot reads few of the others."""
    monkeypatch.setattr(segments, "SLOT", 2)
    monkeypatch.setattr(segments, "FIRST", 1)
    texts = {i: "common " * (1 + i % 3) + f"filler{i}" for i in range(100)} | {100: "common rare rare", 101: "common rare"}
    index = segments.Segments(spark, str(tmp_path / "index"))
    index.upsert(frame(spark, texts))
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    assert rows_of(index.retrieve(q, 2)) == rows_of(lexical.retrieve(frame(spark, texts), q, 2))


def test_odd_batches(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "index"))
    assert index.retrieve(asked(spark), 3).collect() == []
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert index.retrieve(asked(spark), 3).collect() == []
    with pytest.raises(ValueError, match="repeat"):
        index.upsert(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"))
    index.upsert(spark.createDataFrame([(None, "w0"), (5, "w0 w7"), (6, "w1"), (7, "w2"), (8, None)], "doc_id long, text string"))
    want = {5: "w0 w7", 6: "w1", 7: "w2", 8: None}
    assert rows_of(index.retrieve(asked(spark), 3)) == rows_of(lexical.retrieve(frame(spark, want), asked(spark), 3))
    index.delete(spark.createDataFrame([(i,) for i in want], "doc_id long"))
    assert index.retrieve(asked(spark), 3).collect() == []
    index.upsert(frame(spark, {5: "w7", 9: "w0", 10: "w1"}))
    assert rows_of(index.retrieve(asked(spark), 3)) == rows_of(lexical.retrieve(frame(spark, {5: "w7", 9: "w0", 10: "w1"}), asked(spark), 3))


def test_a_writer_that_read_an_older_set_fails(spark, tmp_path):
    one = segments.Segments(spark, str(tmp_path / "index"))
    one.upsert(frame(spark, {1: "w0", 2: "w1"}))
    base, now = one.store.current()
    segments.Segments(spark, one.store.folder).upsert(frame(spark, {3: "w2"}))
    with pytest.raises(FileExistsError):
        one._write(base, now, frame(spark, {4: "w3"}).select("doc_id", F.lit(1).cast("long").alias("dl"), F.expr("array(named_struct('value', text, 'n', 1L))").alias("words")), None)
    assert {r.doc_id for r in one.retrieve(asked(spark), 9).collect()} <= {1, 2, 3}


def test_snapshots_keep_tables(spark, tmp_path):
    from folioscan.sources.tables import Snapshots

    s = Snapshots(spark, str(tmp_path / "set"))
    one = lambda n: spark.range(n)
    s.commit({"a": one(3), "b": one(4)})
    number, first = s.current()
    s.commit({"b": one(5)}, keep=["a", "b"], base=number)
    assert {k: df.count() for k, df in s.load().items()} == {"a": 3, "b": 5} and s.validate() == []
    with pytest.raises(FileExistsError):
        s.commit({"a": one(1)}, keep=["b"], base=number)
    s.commit({"c": one(1)}, keep=["a", "b"])
    s.prune()
    assert {k: df.count() for k, df in s.load().items()} == {"a": 3, "b": 5, "c": 1} and s.validate() == []
    assert first["snapshot"] in s.files.names() and "b" not in {x.name for x in (tmp_path / "set" / first["snapshot"]).iterdir()}


def test_questions_are_scored_within_slots(spark, tmp_path, monkeypatch):
    """What is shuffled for a batch's ranking is k rows of each slot and question, not a row for each question and document."""
    rows = []
    named = segments.scoring.named
    monkeypatch.setattr(segments.scoring, "named", lambda found, names: rows.append(found) or named(found, names))
    index = segments.Segments(spark, str(tmp_path / "index"))
    texts = {i: "common " * (1 + i % 3) + f"filler{i}" for i in range(300)}
    index.upsert(frame(spark, texts))
    q = spark.createDataFrame([(i, "common filler7 filler8") for i in range(20)], "query_id long, text string")
    assert rows_of(index.retrieve(q, 2)) == rows_of(lexical.retrieve(frame(spark, texts), q, 2))
    slots = index._all("documents", index.store.manifest()).select("slot").distinct().count()
    assert rows[0].count() <= 2 * 20 * slots < 300 * 20


def test_a_build_reads_texts_once_and_keeps_places(spark, tmp_path):
    """Documents have no words of their own, postings have places and no ids; frequencies follow what is taken away."""
    index = segments.Segments(spark, str(tmp_path / "index"), buckets=4)
    known = {i: text_of(random.Random(i)) for i in range(70)}
    index.upsert(frame(spark, known))
    tables = index.store.load()
    assert tables["documents-000001"].columns == ["doc_id", "slot", "at", "dl"]
    own = tables["postings-000001"].where("term IS NULL")
    assert own.selectExpr("sum(n)").first()[0] == 70 and tables["postings-000001"].where("term IS NOT NULL AND docs IS NOT NULL").isEmpty()
    index.upsert(frame(spark, {3: "w1 new new", 68: None}))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 66, 2)], "doc_id long"))
    left = {i: t for i, t in (known | {3: "w1 new new", 68: None}).items() if i % 2 or i >= 66}
    held = index._all("terms", index.store.manifest()).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    counted = lexical.term_counts(frame(spark, left)).select("term", "df")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, counted.collect()))
    words = index._words(index.store.manifest()).selectExpr("doc_id", "inline(words)")
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, lexical.term_frequencies(frame(spark, left)).select("doc_id", "term", "tf").collect()))


def test_words_beyond_a_piece_and_slots_within_a_batch(monkeypatch):
    import pyarrow as pa

    terms = pa.array([["a"] * 3, ["b"], None, ["c"] * 9, ["d"]])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array([2, 3, 4, 5, 6]), terms], names=["doc_id", "row", "terms"])
    monkeypatch.setattr(segments, "TURNED", 4)
    assert [p.column("doc_id").to_pylist() for p in segments._pieces(batch, 4)] == [[1, 2], [3], [4], [5]]
