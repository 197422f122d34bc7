"""Snapshots, journal, ingest and readiness."""

import json

import pytest
from pyspark.sql import functions as F

from folioscan.plans import ingest
from folioscan.sources import journal, tables


def items(spark, ids):
    rows = []
    for d in ids:
        texts = ["A title of a paper", "Abstract", "This paper is about something that works well.", "1 Introduction", f"Body of {d} in a sentence. " * 12, "References", "[1] He, K. et al. 2016. Deep residual learning. In Proceedings of CVPR.", "Appendix A", "More words at the end of it. " * 4]
        rows += [(d, i, i // 3, "text", t, f"{d}.pdf") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, ord long, page_idx long, type string, text string, source string").withColumn("bbox", F.array().cast("array<double>"))


def test_readers_see_a_whole_set_at_any_moment(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    s.commit({"t": spark.range(3)}, batch=1)
    staged = s.stage({"t": spark.range(5)})
    assert s.load()["t"].count() == 3 and s.manifest()["batch"] == 1  # staged, not current
    (tmp_path / "kb" / "manifest-000000007.json").write_text("{ broken")
    assert s.load()["t"].count() == 3
    s.publish(staged, batch=2)
    assert s.load()["t"].count() == 5 and s.manifest()["batch"] == 2 and s.publish(staged) and len(s._numbers()) == 3
    with pytest.raises(FileExistsError):
        s.files.write("manifest-000000001.json", {})
    s.prune()
    assert s.load()["t"].count() == 5 and s.validate() == [] and len([x for x in s.files.names() if len(x) == 32]) == 1


def test_a_journal_is_finished_by_whoever_finds_it(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    j = journal.Journal(s)
    told = []

    def fails(*_):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        j.execute("upsert", {"t": spark.range(4)}, ["a", " "], fails)
    assert j.pending() and j.load()["status"] == "remote_pending" and s.load() == {}
    assert j.recover(lambda op, t, ids: told.append((op, t["t"].count(), ids))) == "remote_pending" and told == [("upsert", 4, ["a"])]
    assert s.load()["t"].count() == 4 and not j.pending() and j.recover() is None
    staged = s.stage({"t": spark.range(9)})
    j.save({"operation": "upsert", "status": "local_pending", "ids": [], "staged": staged, "facts": {}})
    assert j.recover(fails) == "local_pending" and s.load()["t"].count() == 9  # the outside index has it already
    (tmp_path / "kb" / journal.NAME).write_text("not json")
    assert j.recover(fails) == "unknown" and not j.pending()
    with pytest.raises(ValueError):
        j.execute("rename", {}, [])


def test_ingest_and_removal(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    files = spark.createDataFrame([("a.pdf", 10)], "path string, length long")
    first = ingest.ingest(items(spark, ["a", "b"]), s, files=files)
    now = s.load()
    assert not first["skipped"] and first["documents"] == 2 and first["pages"] == 6 and set(now) == {*ingest.KEYED, "quality"}
    refs = now["references"].collect()
    assert {r.doc_id for r in refs} == {"a", "b"} and all("He, K." in r.text for r in refs) and now["citations"].count() == 2
    uids = [r.chunk_uid for r in now["chunk_rows"].orderBy("chunk_id").collect()]
    assert len(set(uids)) == len(uids) == now["chunks"].count() + now["references"].count() and uids[0].startswith("a.pdf::p1::d0::b0::c0")
    assert now["sections"].where("section = '1 Introduction'").count() == 2 and now["papers"].where("n_citations = 1").count() == 2
    assert ingest.ingest(items(spark, ["a", "b"]), s, files=files)["skipped"] and ingest.ingest(items(spark, ["a"]), s)["skipped"]
    told = []
    more = ingest.ingest(items(spark, ["b", "c"]), s, remote=lambda op, t, ids: told.append((op, sorted(ids))))
    assert more["documents"] == 1 and told == [("upsert", ["c"])] and s.load()["papers"].count() == 3
    assert ingest.signature(files, ingest.IngestSettings()) != ingest.signature(files, ingest.IngestSettings(chunk_size=400))
    gone = ingest.remove(s, ["a", "zz"])
    assert gone["deleted"] == ["a"] and gone["missing"] == ["zz"] and gone["rows"]["papers"] == 1 and s.load()["papers"].count() == 2
    assert ingest.remove(s, ["zz"])["deleted"] == []


def test_documents_of_references_alone_are_main_text(spark, tmp_path):
    rows = [("r", i, 0, "text", t, "r.pdf") for i, t in enumerate(["References", "[1] He, K. et al. 2016. Deep residual learning. In Proceedings of CVPR."])]
    some = spark.createDataFrame(rows, "doc_id string, ord long, page_idx long, type string, text string, source string").withColumn("bbox", F.array().cast("array<double>"))
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    assert ingest.ingest(some, s)["chunks"] == 1
    now = s.load()
    assert now["parents"].count() == 1 and now["references"].count() == now["citations"].count() == 0 and now["chunks"].first().is_reference
    assert now["quality"].first().references == 0


def test_a_document_that_one_table_has_is_known(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    ingest.ingest(items(spark, ["a"]), s)
    now = s.load()
    s.commit({**{k: now[k].where("doc_id <> 'a'") for k in ingest.KEYED if k != "sections"}, "sections": now["sections"], "quality": now["quality"]})
    told = []
    assert ingest.ingest(items(spark, ["a"]), s, remote=lambda *x: told.append(x))["skipped"] and told == []
    assert ingest.ingest(items(spark, ["a"]), s, force=True)["documents"] == 1 and s.load()["blocks"].count() == 9


def test_the_report_of_quality_is_of_the_whole_set(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    reports = []
    for step in (["a"], ["a", "b", "c"], None):
        if step:
            ingest.ingest(items(spark, step), s)
        else:
            ingest.remove(s, ["b"])
        now, r = s.load(), s.load()["quality"].first()
        reports.append((r.total, r.references))
        assert r.total == now["chunk_rows"].count() and r.references == now["references"].count() and r.failed == now["chunk_rows"].where("NOT quality_pass").count()
    assert reports[0][0] < reports[2][0] < reports[1][0]


def test_chunks_are_numbered_alike_over_many_ranges(spark):
    counts = spark.createDataFrame([(f"d{i:03d}", 1 + i % 3) for i in range(200)], "doc_id string, n long").repartition(7)
    got = {r.doc_id: r.first for r in ingest._numbered(counts).collect()}
    n = 0
    for i in range(200):
        assert got[f"d{i:03d}"] == n
        n += 1 + i % 3


def test_readiness(spark, tmp_path):
    some = {"chunks": spark.range(1), "parents": spark.range(0)}
    assert ingest.readiness(some) == ("missing_parent_corpus", "missing_paper_corpus", "missing_section_summary_corpus", "missing_paper_catalog")
    assert ingest.readiness({}, "references") == ("missing_reference_corpus",) and ingest.readiness({"references": spark.range(2)}, "references") == ()
    text = ingest.readiness_message(("missing_parent_corpus", "other"), "main")
    assert "缺少 parent 语料缓存；other" in text and "论文问答" in text and ingest.readiness_message(()) == ""
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    s.commit({"chunks": spark.range(3), "papers": spark.range(2)})
    assert ingest.consistency(s) == {"ok": True, "repaired": False, "reasons": ()}
    calls = []
    got = ingest.consistency(s, {"chunks": None, "papers": 0, "references": None}, lambda *a: calls.append(a[0]))
    assert got["repaired"] and calls == ["upsert"] and got["reasons"] == ("missing_remote_collection:chunks", "empty_remote_collection:papers", "rebuilt_remote_indexes")
    assert not ingest.consistency(s, {"chunks": 0})["ok"] and ingest.cache_hit_state(s, {"chunks": 3, "papers": 9, "references": 0}) == ("papers_count_mismatch",)
    s.files.delete(f"{s.manifest()['snapshot']}/papers")
    assert s.validate() == ["missing_local_file:papers"]


def test_chunk_rows(spark):
    c = spark.createDataFrame([("", 4, "p1", "d", " s ", 2, "true", "x")], "chunk_uid string, chunk_id long, parent_id string, doc_id string, section_path string, page int, is_reference string, text string")
    r = ingest.chunk_rows(c).first()
    assert r.chunk_uid == "4" and r.section_paths == ["s"] and r.page_end == 2 and r.is_reference and r.quality_pass and r.block_ids == [] and json.dumps(r.title) == '""'
    b = spark.createDataFrame([("a", "1"), ("a", "1"), (" a", "2"), ("", "3"), ("b", "x"), ("b", "0"), (None, "1")], "source string, page string")
    assert ingest.pages_of(b).first().pages == 2
