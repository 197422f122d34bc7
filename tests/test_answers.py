import json

from folioscan.operators import rerank
from folioscan.plans import answers


def test_answers(spark):
    raw = ['x ```json\n{"conclusion": "Yes", "evidence_points": ["a", " "], "uncertainties": ["u"]}```', "Plain [doc:a|p:1] text\nreferences:\n[1] x\n[2] y\n\nEnd", None]
    got = answers.readable_answers(spark.createDataFrame(list(enumerate(raw)), "i long, answer string")).orderBy("i").collect()
    assert got[0].shown == "结论：\nYes\n\n证据点：\n1. a\n\n不确定项：\n- u" and got[1].shown == "Plain text\nEnd" and got[1].parsed is None and got[2].shown == ""


def test_prompts_and_records(spark):
    e = spark.createDataFrame([(1, 1, "p", "p.pdf", 2, "Method", "b1", " some  text ", "Title", "2016")], "query_id long, rank long, doc_id string, source string, page long, section_path string, block_id string, text string, title string, year string")
    q = spark.createDataFrame([(1, "why?", "survey"), (2, "no", "factual")], "query_id long, text string, route string")
    p = answers.prompts(q, e).collect()
    assert len(p) == 1 and "[doc:p|source:p.pdf|p:2|section:Method|block:b1]" in p[0].prompt and answers.MODE_HINTS["survey"] in p[0].prompt
    r = answers.evidence_records(e).first().record
    assert r.citation_text == "[Title, 2016, p.2, Method]" and r.snippet == "some text"
    a = answers.generate(answers.prompts(q, e), lambda ps: [json.dumps({"conclusion": str(len(x))}) for x in ps]).first()
    assert json.loads(a.answer)["conclusion"] == str(len(p[0].prompt))


def test_rerank(spark):
    c = spark.createDataFrame([(1, 1, 1, "dogs bark"), (1, 2, 2, "cats purr softly"), (2, 3, 1, "x"), (2, 4, 2, "birds")], "query_id long, doc_id long, rank long, text string")
    q = spark.createDataFrame([(1, "cats purr"), (2, "birds")], "query_id long, text string")
    gate = spark.createDataFrame([(1, True), (2, False)], "query_id long, should_rerank boolean")
    order = lambda df: [(r.query_id, r.doc_id) for r in df.orderBy("query_id", "rank").collect()]
    assert order(rerank.rerank(c, q, 5)) == [(1, 2), (1, 1), (2, 4), (2, 3)]
    assert order(rerank.rerank(c, q, 5, gate)) == [(1, 2), (1, 1), (2, 3), (2, 4)]
    assert order(rerank.rerank(c, q, 1, scorer=lambda qs, ts: [float(len(t)) for t in ts])) == [(1, 2), (2, 4)]
