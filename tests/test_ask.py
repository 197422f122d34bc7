"""Whole questions: constraints, known titles, entities, what the model gets."""

from pyspark.sql import functions as F

from folioscan.operators import evaluate, fusion
from folioscan.plans import answers, flow
from folioscan.plans.analysis import Settings


def corpus(spark):
    papers = [("p0", "attention is all you need", "transformer attention heads encoder", "A. Vaswani", "2017", "NeurIPS", "a.pdf", ""), ("p1", "deep residual learning for image recognition", "residual learning of deep layers", "K. He", "2016", "CVPR", "b.pdf", ""), ("p2", "squeeze-and-excitation networks", "channel excitation of layers", "J. Hu", "2018", "CVPR", "c.pdf", "")]
    chunks = [(f"{d}-{i}", d, f"{t} word{i} {s}", i, f"s{i % 2}", src, f"{d}-par{i % 2}") for d, t, s, *_, src, _ in papers for i in range(6)]
    p = spark.createDataFrame(papers, "doc_id string, title string, summary string, authors string, year string, venue string, source string, keywords string")
    c = spark.createDataFrame(chunks, "chunk_uid string, doc_id string, text string, page int, section_path string, source string, parent_id string")
    parents = c.groupBy("parent_id").agg(F.concat_ws(" / ", F.sort_array(F.collect_list("text"))).alias("text"))
    return p, c, parents


def test_constraints_and_titles_narrow_the_papers(spark):
    papers, chunks, parents = corpus(spark)
    q = spark.createDataFrame([(1, "layers venue: CVPR 2016"), (2, "who proposed ResNet layers"), (3, "layers venue: nowhere"), (4, "qqq zzz"), (5, "channel excitation")], "query_id long, text string")
    got = flow.ask(q, chunks, papers, Settings(variants=1), parents=parents, current_year=2026)
    recalled = {(r.query_id, r.doc_id) for r in got["papers"].collect()}
    assert {d for i, d in recalled if i == 1} == {"p1"} and {d for i, d in recalled if i == 2} == {"p1"} and {d for i, d in recalled if i == 3} == {"p1", "p2"} and not {d for i, d in recalled if i == 4}
    e = got["evidence"].collect()
    assert {r.paper_id for r in e if r.query_id in (1, 2)} == {"p1"} and {r.query_id for r in e} == {1, 2, 3, 5}
    assert all(len({(r.position) for r in e if r.query_id == i}) == sum(r.query_id == i for r in e) <= 5 for i in (1, 2, 3, 5))
    made = got["generation"].collect()
    assert {r.kind for r in made if r.query_id == 2} == {"paper"} and {r.kind for r in made if r.query_id == 5} == {"parent"} and not any(r.query_id == 4 for r in made)


def test_comparisons_get_each_entity(spark):
    papers, chunks, _ = corpus(spark)
    more = spark.createDataFrame([("x-0", "p2", "论文 SENet is named here", 9, "s9", "c.pdf", "x")], chunks.schema)
    q = spark.createDataFrame([(1, "compare attention and SENet"), (2, "residual layers")], "query_id long, text string")
    s = Settings(variants=1, retriever_k=2, final_k=2)
    got = flow.ask(q, chunks.unionByName(more), papers, s, use_reranker=False)
    one = [r.doc_id for r in got["evidence"].where("query_id = 1").orderBy("position").collect()]
    assert one == ["p0-0", "p0-1"]  # SENet's paper is not recalled, and chunks of one parent count once
    docs = spark.createDataFrame([(1, "p0-1", "p0", 2.0, 1, [None, 1])], "query_id long, doc_id string, paper_id string, score double, rank long, ranks array<long>")
    entities = spark.createDataFrame([(1, 0, "attention"), (1, 1, "SENet"), (1, 2, "residual")], "query_id long, e int, entity string")
    full = flow.supplement(docs, entities, chunks.unionByName(more), s, None).orderBy("rank").collect()
    assert [r.doc_id for r in full][:2] == ["p0-1", "x-0"] and full[2].paper_id == "p1" and [r["rank"] for r in full] == [1, 2, 3] and full[1].score is None


def test_survey_questions_get_papers_and_sections(spark):
    papers, chunks, _ = corpus(spark)
    sections = spark.createDataFrame([("p1", "Method", "layers method"), ("p2", "Results", "layers results"), ("p9", "Other", "layers"), *[(f"q{i}", "More", f"words {i}") for i in range(9)]], "doc_id string, section string, summary string")
    q = spark.createDataFrame([(1, "survey of layers")], "query_id long, text string")
    made = flow.ask(q, chunks, papers, Settings(variants=3), sections=sections)["generation"].orderBy("place").collect()
    assert [r.kind for r in made] == ["paper", "paper", "section", "section"] and {r.id for r in made[2:]} == {"p1::Method", "p2::Results"}


def test_evaluation_helpers(spark, tmp_path):
    rows = spark.createDataFrame([(i, "" if i % 2 else "named", ["a", "b", " "][i % 3]) for i in range(12)], "qid long, context_doc_id string, context string")
    got = {r.context_doc_id: (r.qid, r.n) for r in evaluate.distinct_contexts(rows).collect()}
    assert got["named"][0] == 0 and len(got) == 3
    a = [r.qid for r in evaluate.sample_rows(rows, 5, 1).collect()]
    assert len(a) == 5 == len(set(a)) and a == [r.qid for r in evaluate.sample_rows(rows.repartition(3), 5, 1).collect()] and a != [r.qid for r in evaluate.sample_rows(rows, 5, 2).collect()]
    assert [r.qid for r in evaluate.sample_rows(rows, 2, shuffle=False).collect()] == [0, 1] and evaluate.sample_rows(rows, 0).count() == 12
    h = spark.createDataFrame([("x", 2), ("y", 1)], "route string, n long")
    assert {r.route: r.n for r in evaluate.add_route_counts([h, h.where("route = 'x'")]).collect()} == {"x": 4, "y": 1}
    evaluate.save_results(rows.withColumn("l", F.array("qid")), h, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "rows_jsonl")).count() == spark.read.option("header", True).csv(str(tmp_path / "out" / "rows_csv")).count() == 12


def test_answers_cite_what_they_rest_on(spark):
    papers, chunks, _ = corpus(spark)
    q = spark.createDataFrame([(1, "who proposed ResNet layers"), (2, "channel excitation"), (3, "qqq zzz")], "query_id long, text string")
    found = flow.ask(q, chunks, papers, Settings(variants=1))

    def model(batch):
        return ['{"conclusion": "It is so.", "evidence_points": ["a", " "], "uncertainties": []}' if "excitation" in p else "plain words [doc:x|source:y]" for p in batch]

    got = {r.query_id: r for r in answers.answer_questions(q, found, model).collect()}
    assert sorted(got) == [1, 2] and got[1].shown == "plain words" and "It is so." in got[2].shown and got[2].parsed.evidence_points[0] == "a"
    assert [(c.kind, c.id) for c in got[1].citations] == [("paper", "p1")] and {c.kind for c in got[2].citations} == {"chunk"}
    one = spark.range(1).select(answers.scope_hint(F.lit("references"), F.lit("survey")).alias("a"), answers.scope_hint(F.lit("main"), F.lit("factual")).alias("b"), answers.retrieval_scope(F.lit(" Refs ")).alias("c"), answers.retrieval_scope(F.lit(None).cast("string")).alias("d")).first()
    assert "参考文献" in one.a and (one.b, one.c, one.d) == ("", "references", "main")


def test_decisions_and_entities_of_few_rows(spark):
    r = spark.createDataFrame([(1, "a", 0.9, 1, [None, 1]), (1, "b", 0.2, 2, [None, 2]), (2, "c", 0.5, 1, [None, 1])], "query_id long, doc_id string, score double, rank long, ranks array<long>")
    got = {(x.query_id, x.doc_id): x for x in fusion.attach_decision(r, fusion.rerank_gate(r)).collect()}
    assert got[1, "a"].decision == "high_confidence_skip" and not got[1, "b"].should_rerank and round(got[1, "a"].score_gap, 6) == 0.7 and got[2, "c"].decision == "single_candidate"
    assert {x.query_id: x.similar for x in fusion.similarity_scores(r.withColumn("score", F.when(F.col("query_id") == 1, F.col("score")))).collect()} == {1: True, 2: False}
