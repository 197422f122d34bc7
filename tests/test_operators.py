import json

import pytest
from pyspark.sql import functions as F

from folioscan.functions import arrow
from folioscan.operators import assets, evaluate, folds, fusion, incremental, lexical
from folioscan.plans import flow
from folioscan.sources import tables
from folioscan.streaming import upserts


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def test_bm25_by_hand(spark):
    import math

    texts = ["cat sat mat", "cat cat dog", "", "bird"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "Cat dog dog")], "query_id long, text string")
    got = {r.doc_id: r.score for r in lexical.bm25(corpus, q).collect()}
    docs = [t.split() or ["_"] for t in texts]
    terms = {w for d in docs for w in d}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w in terms for n in [sum(w in d for d in docs)]}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    adl = sum(map(len, docs)) / 4
    for i, d in enumerate(docs):
        want = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / adl)) for w in ("cat", "dog", "dog") if w in d)
        assert abs(got.get(i, 0.0) - want) < 1e-6


def test_fusion_and_thresholds(spark):
    a = ranked(spark, [(1, 10, 0.9, 1), (1, 11, 0.8, 2)])
    b = ranked(spark, [(1, 11, 5.0, 1), (1, 12, 4.0, 2)])
    got = fusion.reciprocal_rank([a, b], 3, 0).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [11, 10, 12] and got[0].ranks == [2, 1] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-9
    s = ranked(spark, [(1, i, v, i) for i, v in enumerate([1.0, 0.8, 0.5, 0.2])] + [(2, 9, None, 1)])
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(fusion.keep_above(s, "relative", None, 0.7)) == [0, 1, 9]
    assert ids(fusion.keep_above(s, "quantile", 0.1, quantile=0.5)) == [0, 1, 9]
    assert ids(fusion.keep_above(s, "absolute", 0.5)) == [0, 1, 2, 9] and ids(fusion.keep_above(s, "absolute", None)) == [0, 1, 2, 3, 9]


def test_gate(spark):
    def reason(*rows):
        df = spark.createDataFrame([(1, s, i + 1, r) for i, (s, r) in enumerate(rows)], "query_id long, score double, rank long, ranks array<long>")
        return fusion.rerank_gate(df).first().reason

    assert reason((0.9, [None, None])) == "single" and reason((0.9, [1, 1]), (0.8, [3, 4])) == "consensus" and reason((0.5, [1, 3]), (0.5, [4, 2])) == "rank_gap"
    assert reason((0.9, [1, 3]), (0.2, [2, 1])) == "confident" and reason((0.5, [1, 3]), (0.49, [2, 1])) == "uncertain" and reason((None, [1, 3]), (None, [2, 1])) == "no_score"


def by_hand(rows, k):
    seen, full, out = set(), set(), []
    for bucketed in (True, False):
        for rank, identity, bucket in rows:
            if len(out) < k and identity not in seen and not (bucketed and bucket in full):
                out.append(rank)
                seen.add(identity)
                full.add(bucket)
    return out


def test_evidence_and_coverage(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "y"), (5, "d", "x"), (6, "d", "z")]
    df = spark.createDataFrame([(7, *r) for r in rows], "query_id long, rank long, identity string, bucket string")
    for k in range(1, 7):
        assert [r["rank"] for r in fusion.select_evidence(df, k).orderBy("position").collect()] == by_hand(rows, k)
    c = spark.createDataFrame([(1, i, s, ["resnet", "vgg"], t) for i, s, t in ((1, "p", "x"), (2, "p", "about VGG"), (3, "p", "y"), (4, "q", "ResNet here"))], "query_id long, rank long, source string, entities array<string>, text string")
    assert [r["rank"] for r in fusion.cover_entities(c, 4).orderBy("position").collect()] == [4, 2, 1, 3]


def test_layout_blocks(spark):
    items = [(0, 0, "1 Introduction"), (1, 0, "Plain body text of the paper that goes on for a while."), (2, 4, "References"), (3, 4, "[1] He, K., Zhang, X. et al. Deep residual learning. CVPR 2016."), (4, 5, "Appendix A"), (5, 5, "Appendix body text without any year, but with a sentence.")]
    got = folds.annotate_blocks(spark.createDataFrame([("d", o, p, "text", t) for o, p, t in items], "doc_id string, ord long, page long, type string, text string")).orderBy("ord").collect()
    assert [r.is_reference for r in got] == [False, False, True, True, False, False]
    assert got[1].section_path == "1 Introduction" and got[3].section_path == "References" and got[0].block_id == "d::b000000"


def test_structure_blocks(spark):
    text = "1 Title\n\nshort\n\n- item\n\n" + "long " * 100 + "\n\nnext\n\n2 Other\n\nend"
    got = spark.createDataFrame([(text,)], "t string").select(folds.structure_blocks(F.col("t"), 50).alias("b")).first().b
    assert got[0].startswith("1 Title\n\nshort\n- item") and got[1] == "next" and got[2] == "2 Other\n\nend"


def test_packing_and_abstract(spark):
    blocks = [("d", i, "s", False, i // 3, "text", "x" * 700, "") for i in range(6)]
    df = spark.createDataFrame(blocks, "doc_id string, ord long, section_path string, is_reference boolean, page long, block_type string, text string, title string")
    assert [r.grp for r in folds.pack_groups(df).orderBy("ord").collect()] == [0, 0, 1, 1, 2, 2]
    lines = ["A Title", "Abstract", "Thanks to the recent developments we can.", "It works.", "1 Introduction", "Body"]
    ab = spark.createDataFrame([("d", i, t, False, "Abstract" if 0 < i < 4 else "Front") for i, t in enumerate(lines)], "doc_id string, ord long, text string, is_reference boolean, section_path string")
    assert folds.abstract(ab).first().abstract == "Thanks to the recent developments we can It works"  # marks at either end of a text go


def test_arrow_functions():
    assert arrow.normal_text("ﬁne\tveri\x1bcation\n x") == "fine verification x"
    assert arrow.clean_text("a\nb{c}&d\\textcircled x_y") == "ab c & d x y" and json.loads(arrow.first_json_object('text {bad} ```{"a": {"b": 1}}``` x')) == {"a": {"b": 1}} and arrow.first_json_object("no") is None
    text = "Sentence one. Sentence two is longer. " * 40
    parts = arrow.split_recursively(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and set("".join(parts)) == set(text) and parts[0].startswith("Sentence one.")


def test_assets(spark):
    refs = spark.createDataFrame([("d", "He, K. 2016. Deep residual learning. CVPR"), ("d", "He, K. 2016. Deep  residual learning. CVPR"), ("d", "short")], "doc_id string, text string")
    edges = assets.citation_edges(refs).collect()
    assert len(edges) == 1 and edges[0].year == "2016" and len(edges[0].edge_id) == 16
    chunks = spark.createDataFrame([(i, f"Running head\nbody {i}\nend {i}", ["a"], [], ["text"]) for i in range(3)] + [(9, "tiny", ["a", "b"], ["t"], ["image"])], "chunk_uid long, text string, section_paths array<string>, table_ids array<string>, block_types array<string>")
    flags = {r.chunk_uid: r.flags for r in assets.quality_flags(chunks).collect()}
    assert flags[0] == ["header_footer_repetition"] and flags[9] == ["cross_section_chunk", "media_without_context"]
    report = assets.quality_report(assets.quality_flags(chunks)).first()
    assert (report.total, report.failed, report.flag_counts["header_footer_repetition"]) == (4, 4, 3)


def test_incremental(spark):
    old = {"t": spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")}
    new = {"t": spark.createDataFrame([("b", 2), ("c", 2), (" ", 3)], "doc_id string, v int")}
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(incremental.upsert(old, new)["t"]) == [("a", 1), ("b", 1), ("c", 2)] and rows(incremental.upsert(old, new, True)["t"]) == [("a", 1), ("b", 2), ("c", 2)]
    left, known = incremental.delete(old, new["t"])
    assert rows(left["t"]) == [("a", 1)] and rows(known) == [("b",)]


def test_snapshots_and_stream(spark, tmp_path):
    s = tables.Snapshots(spark, str(tmp_path / "kb"))
    assert s.manifest() is None and s.validate() == ["manifest_missing"] and s.load() == {}
    s.commit({"papers": spark.createDataFrame([("a", 1)], "doc_id string, v int")})
    spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, v int").parquet(str(tmp_path / "in"))
    upserts.upsert_stream(stream, s, "papers", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in s.load()["papers"].collect()) == [("a", 2), ("b", 2)] and s.validate() == []
    upserts.delete_keys(s, spark.createDataFrame([("a",)], "doc_id string"))
    assert [tuple(r) for r in s.load()["papers"].collect()] == [("b", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"page_content": "a", "metadata": {"k": "v"}}\nnot json\n[1]\n\n{"page_content": "b"}\n')
    d = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), tables.DOCUMENT)
    assert sorted(r.page_content for r in d.where("page_content IS NOT NULL").collect()) == ["a", "b"]
    assert tables.deserialise(tables.serialise(d)).where("page_content = 'a'").first().metadata == {"k": "v"}
    (tmp_path / "layout").mkdir()
    (tmp_path / "layout" / "p_content_list.json").write_text(json.dumps([{"page_idx": 0, "type": "text", "text": "T"}, {"type": "table", "table_body": "<td>1</td>", "table_caption": ["Cap"]}, {"type": "text", "text": " "}]))
    got = tables.read_layouts(spark, str(tmp_path / "layout")).orderBy("ord").collect()
    assert [(r.doc_id, r.ord, r.text.split()) for r in got] == [("p", 0, ["T"]), ("p", 1, ["Cap", "1"])]
    (tmp_path / "a b.pdf").write_bytes(b"%PDF")
    assert tables.discover_pdfs(spark, str(tmp_path)).first().doc_id.startswith(("a_b_", "a_20b_"))
    q = spark.createDataFrame([("Q: why? Text: because\nof",), ("none",)], "text string")
    assert tables.question_rows(q).first().context == "because\nof"


def test_trace(spark, tmp_path):
    from folioscan.sources.trace import Trace

    t = Trace(spark, str(tmp_path / "log"), "ask")
    with t.stage("route"):
        pass
    t.field("n", 3)
    t.finish()
    row = json.loads(spark.read.text(str(tmp_path / "log")).first().value)
    assert row["operation"] == "ask" and row["n"] == 3 and row["status"] == "ok" and "route" in row["stages_ms"]


def test_evaluation(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = ranked(spark, [(1, 5, 1.0, 1), (1, 6, 0.5, 2)])
    rel = spark.createDataFrame([(1, 6), (2, 7)], "query_id long, doc_id long")
    m = evaluate.hit_and_mrr(evaluate.first_ranks(q, r, rel)).first()
    assert (m.n, m.hit_rate, m.mrr) == (2, 0.5, 0.25) and evaluate.insufficient_rate(q, r).first()[0] == 0.5


def test_a_kept_index_ranks_as_the_corpus_does(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b b d", "", None, "a d e f", "the the the"])], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b b"), (2, "the zzz"), (3, "")], "query_id long, text string")
    want = sorted(map(tuple, lexical.retrieve(docs, q, 3).collect()))
    assert want
    s = tables.Snapshots(spark, str(tmp_path / "index"))
    s.commit(lexical.Index.of(docs).tables())
    assert sorted(map(tuple, lexical.retrieve_indexed(lexical.Index(**s.load()), q, 3).collect())) == want
    assert {(r.term, r.df, r.cf) for r in lexical.term_counts(docs).collect()} >= {("a", 2, 3), ("b", 2, 3), ("_", 2, 2), ("the", 1, 3)}


def test_flow(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"p{i % 3}", ["attention heads", "residual learning", "other words"][i % 3] + f" part {i}", i, "s") for i in range(24)], "chunk_uid string, doc_id string, text string, page long, section_path string")
    papers = spark.createDataFrame([("p0", "attention is all you need"), ("p1", "deep residual learning"), ("p2", "unrelated words"), ("p3", "other things"), ("p4", "more things")], "doc_id string, summary string")
    q = spark.createDataFrame([(1, "residual learning"), (2, "nothing fits qqq")], "query_id long, text string")
    got = flow.ask(q, chunks, papers)
    e = got["evidence"].collect()
    assert {r.query_id for r in e} == {1} and all(r.paper_id == "p1" for r in e) and sorted(r.position for r in e) == [1, 2, 3, 4, 5]
    assert got["plan"].count() == 2 and got["gate"].count() == 1


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_hybrid", "quality_flags", "upsert_merge"])
def test_registered_queries_match_sql(spark, name):
    import duckdb

    from folioscan.plans import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "orders", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    a = con.sql(registry.ORACLES[name]).df()
    b = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    c = sorted(a.columns)
    assert c == sorted(b.columns)
    assert sorted(map(tuple, a[c].astype(str).values)) == sorted(map(tuple, b[c].astype(str).values))


def test_reference_features_by_the_class_of_words(spark):
    """The SQL ends a word before any letter beyond ASCII."""
    from folioscan.functions import text as T

    d = spark.createDataFrame([("ESJALL DE. ÑDOI",), ("see doi: 10.1",)], "text string")
    signal = lambda *word: [r.signal for r in T.reference_features(d, "text", *word).select("ref.signal").collect()]
    assert signal() == [0, 1] and signal(T.ASCII_WORD) == [1, 1]
