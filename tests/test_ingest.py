"""Blocks, parents and chunks against plain Python over whole lists."""

import json
import random

from pyspark.sql import functions as F

from folioscan.functions import arrow
from folioscan.functions import text as T
from folioscan.operators import chunks, folds
from folioscan.sources import tables


def test_heading_levels(spark):
    cases = {
        "2.1.3 Training details": 3, "4 Results": 1, "I propose a method.": None, "1. He, K., Zhang, X. et al. Deep residual learning. CVPR 2016.": None, "iv. Proof": 1, "appendix B": 1, "Appendixes": None,
        "References": 1, " bibliography: ": 1, "OUR METHOD": 1, "OUR METHOD " * 12: None, "": None, "123": None, "Chapter": 1, "\n3.2 After a line break\nbody": 2, "第三章 方法": 1, "x" * 141: None,
    }
    got = spark.createDataFrame(list(cases.items()), "t string, level int").select("t", "level", T.heading_level(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.level) for r in got]


def test_references_end_where_the_text_goes_on(spark):
    entry = "He, K. et al. 2016. Deep residual learning for everyone. In Proceedings of CVPR."
    items = [
        (0, 0, "text", "Reference implementations are easy to find, and this paragraph about them is far too long to be any heading at all, as it has well over the limit of characters."),
        (1, 0, "text", "References"), (2, 0, "text", f"1. {entry}"), (3, 0, "text", f"2. {entry}"), (4, 2, "text", f"[3] {entry}"), (5, 2, "table", "References"), (6, 2, "text", "Plain words without any mark of a sentence or a year in them at all"),
        (7, 2, "text", ""), (8, 11, "discarded", f"[9] {entry}"), (9, 0, "text", f"[8] {entry} 2017"),
    ]
    df = spark.createDataFrame([("d", *i) for i in items] + [("e", 0, 3, None, None)], "doc_id string, ord long, page_idx long, type string, text string")
    got = {(r.doc_id, r.ord): r for r in folds.annotate_blocks(df).collect()}
    assert [got["d", i].is_reference for i in range(10)] == [False, True, True, True, True, False, False, False, True, True]
    assert got["d", 0].section_path == "正文" and got["d", 3].section_path == "References" and got["d", 4].page == 3 and got["e", 0].text == "" and got["e", 0].block_type == "text"


def test_packing_joins_trimmed_texts_and_keeps_ids(spark):
    rows = [("d", 0, "s", False, 1, "text", " one ", ["f1"], [1.0, 2.0, 3.0, 4.0]), ("d", 1, "s", False, 1, "image", "  ", ["f9"], []), ("d", 2, "s", False, 2, "image", "two", ["f0", "f1"], []), ("d", 3, "t", False, 2, "text", "three", [], [])]
    df = spark.createDataFrame(rows, "doc_id string, ord long, section_path string, is_reference boolean, page long, block_type string, text string, figure_ids array<string>, bbox array<double>").withColumn("block_id", F.concat_ws("::", "doc_id", "ord"))
    got = folds.packed_documents(df).orderBy("grp").collect()
    assert [r.text for r in got] == ["one\n\ntwo", "three"] and got[0].figure_ids == ["f0", "f1"] and got[0].block_ids == ["d::0", "d::2"] and got[0].last_block == "d::2"
    assert [(b.page, b.bbox) for b in got[0].bboxes] == [(1, [1.0, 2.0, 3.0, 4.0])] and got[0].block_types == ["image", "text"] and got[0].page_range == "1-2"


def test_layout_files(spark, tmp_path):
    items = [
        {"type": "text", "text": " A title ", "page_idx": 0, "bbox": [1, 2, 3, 4, 5]}, {"type": "image", "img_path": "images/ab cd.x.png", "image_caption": ["Fig 1", " "], "image_footnote": "note", "page_idx": "1", "bbox": "none"},
        {"type": "table", "table_caption": "Tab", "table_body": "<td>1</td><td>2</td>", "bbox": [1, 2]}, {"page_idx": -3, "html": "<p></p>"},
    ]
    (tmp_path / "paper_content_list.json").write_text(json.dumps(items))
    got = tables.read_layouts(spark, str(tmp_path), blank=True).orderBy("ord").collect()
    assert [r.text for r in got] == ["A title", "Fig 1\nnote", "Tab\n1 2", ""] and [r.page_idx for r in got] == [0, 1, 0, 0] and {r.doc_id for r in got} == {"paper"}
    assert got[0].bbox == [1.0, 2.0, 3.0, 4.0] and got[1].bbox == got[2].bbox == [] and got[1].figure_ids == ["fig_ab_cd.x"] and got[2].table_ids == ["tab_unknown"] and got[3].type == "text"


def test_recursive_splitter():
    r = random.Random(3)
    text = "\n\n".join(". ".join(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 6))) for _ in range(12)) + "\n\n" + "x" * 260
    for size, overlap in ((100, 20), (500, 100), (60, 0)):
        parts = arrow.split_recursively(text, size, overlap)
        assert all(p and len(p) <= size and p in text for p in parts)
        found = iter(" ".join(parts).replace(".", " ").split())
        assert all(any(w == x for x in found) for w in text.replace(".", " ").split() if len(w) < 20)  # no word is lost, and they stay in order
        assert overlap or sum(len("".join(p.split())) for p in parts) == len("".join(text.split()))
    assert arrow.split_recursively("a b", 500, 100) == ["a b"] and arrow.split_recursively("ab", 2, 0) == ["ab"] and arrow.split_recursively("abc", 2, 1) == ["ab", "bc"]
    assert arrow.split_recursively("one. two. three", 9, 5) == ["one. two", ". three"] or arrow.split_recursively("one. two. three", 9, 5)[0] == "one"


def chunks_by_hand(docs, strategy, hard):
    out, n = [], 0
    for i, source, page, text in docs:
        text = (text or "").strip()
        if not text:
            continue
        parts = [text] if strategy == "semantic_paper" and len(text) <= hard else arrow.split_recursively(text, 500, 100)
        for k, p in enumerate(parts):
            parent = f"{source or 'unknown'}::p{'?' if page is None else page}::d{i}::b0"
            out.append((n, f"{parent}::c{n}", p, k if strategy == "semantic_paper" and len(text) > hard else None))
            n += 1
    return out


def test_chunks_are_numbered_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(chunks, "RANGE", 3)  # several ranges
    docs = [(i, None if i == 4 else f"s{i}", None if i == 5 else i, t) for i, t in enumerate(["alpha beta " * 300, " ", "short", None, "word. " * 200, "x", "y " * 2000, "tail"])]
    df = spark.createDataFrame(docs, "doc_idx long, source string, page int, text string").repartition(3)
    got, parents = chunks.chunks_with_parents(df, "other")
    assert sorted((r.chunk_id, r.chunk_uid, r.text, r.semantic_child_id) for r in got.collect()) == chunks_by_hand(docs, "semantic_paper", 2400)
    assert sorted(r.doc_idx for r in parents.collect()) == [0, 2, 4, 5, 6, 7]
    token, _ = chunks.chunks_with_parents(df, " TOKEN ", structure=False)
    assert sorted((r.chunk_id, r.chunk_uid, r.text, r.semantic_child_id) for r in token.collect()) == chunks_by_hand(docs, "token", 0)
    assert chunks.chunks_with_parents(df.limit(0))[0].count() == 0


def test_blocks_as_parents(spark):
    df = spark.createDataFrame([(0, "s", 1, "1 Intro\n\n" + "a " * 90 + "\n\n" + "b " * 90 + "\n\n- item"), (1, "s", 2, "plain")], "doc_idx long, source string, page int, text string")
    got, parents = chunks.chunks_with_parents(df, "token", least=50)
    assert [r.parent_id for r in parents.orderBy("doc_idx", "structure_block_id").collect()] == ["s::p1::d0::b0", "s::p1::d0::b1", "s::p2::d1::b0"]
    assert [r.chunk_uid for r in got.orderBy("chunk_id").collect()] == ["s::p1::d0::b0::c0", "s::p1::d0::b1::c1", "s::p2::d1::b0::c2"]


def test_front_matter_and_names(spark):
    df = spark.createDataFrame([("Article in Press Some Title A. Author: The text begins.", "Some Title", "A. Author", "Main"), ("We are providing an unedited version of this manuscript to x legal disclaimers apply. Body", None, "", "3 Results"), (None, "", None, "")], "t string, title string, authors string, name string")
    c = T.squeeze(F.col("t"))
    got = df.select(T.without_front_matter(c, F.col("title"), F.col("authors")).alias("a"), T.section_text(c, F.col("name")).alias("s"), T.is_skipped_section(F.col("name"), c, F.col("title")).alias("k"), T.name_list(F.lit("A. B, C D and E; et al")).alias("n"), T.keyword_list(F.lit("x, y/z|  w")).alias("w")).collect()
    assert [r.a for r in got] == ["The text begins", "Body", ""] and [r.k for r in got] == [True, False, True] and got[1].s.startswith("We are") and got[0].s.startswith("Some Title")
    assert got[0].n == ["A. B", "C D", "E"] and got[0].w == ["x", "y", "z", "w"]
