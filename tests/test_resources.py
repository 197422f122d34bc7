"""Questions to stored sets by scope, upgrades of older sets, names of files, scores to judge by, grids of settings."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import evaluate, fusion
from folioscan.plans import ingest, resources
from folioscan.sources import tables
from test_sync import items


def test_scopes_and_upgrades(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    with pytest.raises(ValueError, match="论文问答"):
        resources.load(s)
    ingest.ingest(items(spark, ["a", "b"]), s)
    now = s.load()
    old = [k for k in now if k not in ("papers", "sections", "catalog", "citations")]
    first = s.commit({k: now[k] for k in old}, pages=6)
    q = spark.createDataFrame([(1, "deep residual learning"), (2, "sentence body of a")], "query_id long, text string")
    r = resources.load(s)
    assert r.scope == "main" and r.papers.count() == 2 and r.sections.count() == now["sections"].count()
    m = s.manifest()
    assert m["at"]["chunks"] == first and m["pages"] == 6 and not ingest.upgrade(s)  # kept where they were, and once
    assert sorted(map(tuple, r.papers.select("doc_id", "abstract").collect())) == sorted(map(tuple, now["papers"].select("doc_id", "abstract").collect()))
    s.files.delete(f"{first}/chunks")  # a scope of references never opens the main chunks
    got = resources.ask(q, s, " Refs ")
    assert got["chunks"].count() == 0 and got["papers"].count() == 0  # words that every reference has weigh nothing
    assert resources.load(s, "reference").chunks.count() == 2
    with pytest.raises(Exception, match="chunks|exist|PATH"):
        resources.ask(q, s)["chunks"].count()


def test_forget_makes_an_ingest_run_again(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    s.commit({"t": spark.range(3)}, signature="x", pages=2)
    s.forget("signature", "missing")
    assert "signature" not in s.manifest() and s.manifest()["pages"] == 2 and s.load()["t"].count() == 3
    s.forget("signature")
    assert len(s._numbers()) == 2


def test_upload_names(spark):
    names = ["a b.pdf", "../x/a b.PDF", "a_b.txt", "..hidden.pdf", "con.pdf", "what?:<>.pdf", "", None, "no suffix", "中文 论文.pdf"]
    up = spark.createDataFrame(list(enumerate(names)), "upload_id long, name string")
    got = {r.upload_id: r.file for r in tables.upload_names(up, spark.createDataFrame([("con.pdf",), ("no_suffix.pdf",), ("no_suffix_3.pdf",)], "file string")).collect()}
    assert got == {0: "a_b.pdf", 1: "a_b_1.pdf", 2: "a_b_2.pdf", 3: "hidden.pdf", 4: "upload_con.pdf", 5: "what____.pdf", 6: "uploaded.pdf", 7: "uploaded_1.pdf", 8: "no_suffix_4.pdf", 9: "中文_论文.pdf"}


def test_layout_files(spark):
    files = spark.createDataFrame([("/p/My Paper.pdf", 10, 5), ("/p/other.pdf", 1, 1)], "path string, length long, modificationTime long")
    jobs = tables.layout_folders(files)
    folder = {r.path: r.folder for r in jobs.collect()}
    assert folder["/p/My Paper.pdf"].startswith("My_Paper_") and len(folder["/p/My Paper.pdf"]) == len("My_Paper_") + 12
    assert tables.layout_folders(files.withColumn("length", F.lit(11))).first().folder != folder["/p/My Paper.pdf"]
    found = spark.createDataFrame([(folder["/p/My Paper.pdf"], x) for x in ("a/a_content_list.json", "b/my paper_content_list.json", "0.json")] + [(folder["/p/other.pdf"], "z_content_list.json")], "folder string, layout string")
    assert {r.path: r.layout for r in tables.layout_files(found, jobs).collect()} == {"/p/My Paper.pdf": "b/my paper_content_list.json", "/p/other.pdf": "z_content_list.json"}


def test_score_keys(spark):
    rows = [(1, 1, None, 0.5, 3.0), (1, 2, 0.1, 0.4, None), (1, 3, 0.1, None, None), (2, 1, None, None, 3.0), (2, 2, None, None, 2.0), (3, 1, 1.0, 1.0, 1.0)]
    r = spark.createDataFrame(rows, "query_id long, rank long, retrieval_score double, retrieval_rrf_score double, bm25_score double")
    assert {x.query_id: x.score_key for x in fusion.pick_score_key(r).collect()} == {1: "retrieval_rrf_score", 2: "bm25_score", 3: None}


def test_grid(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id string, rank long")
    dense, bm25 = ranked([(1, "a", 1), (1, "b", 2), (2, "c", 1)]), ranked([(1, "b", 1), (1, "c", 2)])
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    s = spark.createDataFrame([("d", "dense", 2, 60), ("l", "bm25", 1, 60), ("h", "hybrid", 1, 60)], "setting string, mode string, k int, rrf_k int")
    detail, summary = evaluate.grid(q, s, dense, bm25, ranked([(1, "b", 0), (2, "c", 0)]))
    assert {(r.setting, r.query_id): (r.n_results, r.first_rank) for r in detail.collect()} == {
        ("d", 1): (2, 2), ("d", 2): (1, 1), ("d", 3): (0, 0), ("l", 1): (1, 1), ("l", 2): (0, 0), ("l", 3): (0, 0), ("h", 1): (1, 1), ("h", 2): (1, 1), ("h", 3): (0, 0)}
    got = {r.setting: (r.n, r.hit_rate, r.mrr, r.insufficient_rate) for r in summary.collect()}
    assert got["d"] == (3, 0.666666667, 0.5, 0.333333333) and got["l"] == (3, 0.333333333, 0.333333333, 0.666666667)
