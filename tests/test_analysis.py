from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.plans import analysis


def one(spark, text, *columns):
    return spark.createDataFrame([(0, text)], "query_id long, text string").select(*columns).first()


def test_routes(spark):
    asked = {"这篇论文的参考文献有哪些": "references", "author: He venue: CVPR 2016": "metadata", "谁提出的ResNet? 谁提出": "metadata", "survey of retrieval": "survey", "ResNet vs VGG": "comparison", "compare BERT and GPT": "comparison", "how does attention work": "factual"}
    df = analysis.route(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"))
    got = {r.text: r for r in df.collect()}
    assert {k: r.route for k, r in got.items()} == asked
    r = got["survey of retrieval"]
    assert (r.mode, r.paper_k, r.chunk_k, r.final_k, r.use_parents, r.prefers_papers) == ("hybrid", 9, 36, 6, False, True)
    assert analysis.route(df.select("query_id", "text"), scope="refs").where("route <> 'references'").count() == 0


def test_years(spark):
    asked = {
        "author: He 2020-2023": ["2020", "2021", "2022", "2023"], "last 5 years transformer survey": ["2022", "2023", "2024", "2025", "2026"], "近三年": ["2024", "2025", "2026"], "between 2001 and 2003": ["2001", "2002", "2003"],
        "after 2024": ["2025", "2026"], "after 2030": ["2026", "2027", "2028", "2029", "2030", "2031"], "since 2025": ["2025", "2026"], "before 1952": ["1950", "1951"], "in 2016 or 2018": ["2016", "2018"], "no year 12345": [], "2020年": [],
    }
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").select("text", analysis.years(F.col("text"), 2026).alias("y"))
    assert {r.text: r.y for r in df.collect()} == asked


def test_fields_and_filter(spark):
    q = spark.createDataFrame([(0, "author: He venue: CVPR 2016"), (1, "author: He 2015"), (2, "anything"), (3, "title: nothing like it")], "query_id long, text string")
    parsed = analysis.constraints(q, 2026)
    rows = {r.query_id: r for r in parsed.collect()}
    assert rows[0].author_terms == ["He"] and rows[0].venue_terms == ["CVPR"] and rows[0].years == ["2016"] and rows[1].author_terms == ["He"]
    papers = spark.createDataFrame([("he", "a.pdf", "Deep Residual", "Kaiming He", "2015", "CVPR", ""), ("va", "b.pdf", "Attention", "Vaswani", "2017", "NeurIPS", "")], "doc_id string, source string, title string, authors string, year string, venue string, keywords string")
    fits = analysis.allowed_documents(parsed, papers)
    assert [tuple(r) for r in fits.collect()] == [(1, "he")]  # the others are open: no constraint, or none that anything fits
    assert "NestedLoop" not in fits._jdf.queryExecution().toString()
    both = spark.createDataFrame([(0, "author: he; venue: cvpr since 2015"), (1, "venue: c venue: n 2017"), (2, "author: e title: res")], "query_id long, text string")
    assert sorted(tuple(r) for r in analysis.allowed_documents(analysis.constraints(both, 2026), papers).collect()) == [(0, "he"), (1, "va"), (2, "he")]


def test_variants(spark):
    q = spark.createDataFrame([(0, "what is ResNet?"), (1, "  "), (2, "多模态 检索")], "query_id long, text string")
    got = {r.query_id: r.variants for r in analysis.variants(q, 6).collect()}
    assert got[0][0] == "what is ResNet?" and got[0][1] == "ResNet" and "kaiming he" in got[0][2] and got[1] == []
    assert any("multimodal" in v for v in got[2]) and len(analysis.variants(q, 2).first().variants) == 2


def test_entities(spark):
    assert one(spark, "ResNet和DenseNet的区别", analysis.comparison_entities(F.col("text")).alias("e")).e == ["ResNet", "DenseNet"]
    assert one(spark, "BERT and GPT: common points", analysis.comparison_entities(F.col("text")).alias("e")).e == ["BERT", "GPT"]
    assert one(spark, "how does it work", analysis.comparison_entities(F.col("text")).alias("e")).e == []


def test_references(spark):
    texts = ["References", "[1] He, K., Zhang, X. et al. Deep residual learning. CVPR 2016.", "Smith, J. and Doe, A. Some title. Journal of X, 2014, pp. 1-2.", "Appendix A. More results follow in this section of text.", "The method works well on all of the data. It is fast and simple."]
    df = T.reference_features(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text")
    got = [r.ref for r in df.orderBy("i").collect()]
    assert got[0].opens and [r.entry for r in got] == [False, True, False, False, False] and [r.goes_on for r in got] == [False, True, True, False, False] and [r.body for r in got] == [False, False, False, True, True]
    p = one(spark, "He, K. 2016. Deep residual learning. CVPR", T.parsed_reference(F.col("text")).alias("p")).p
    assert (p.authors, p.year, p.title) == ("He, K", "2016", "Deep residual learning")


def test_text_functions(spark):
    r = one(spark, "  A　b\tc  ", T.squeeze(F.col("text")).alias("s"), T.tokens(F.lit("naïve 图像 X_1")).alias("t"), T.truncate(F.lit("abcdefghij"), 8).alias("c"), T.string_list(F.lit('["a", " b "]')).alias("j"), T.string_list(F.lit("x| y |")).alias("p"), T.distinct_terms(F.array(F.lit("A"), F.lit("a "), F.lit("b"))).alias("d"), T.language(F.lit("图像分类")).alias("l"), T.top_section(F.lit("A > B")).alias("top"))
    assert (r.s, r.t, r.c, r.j, r.p, r.d, r.l, r.top) == ("A b c", ["na", "ve", "图", "像", "x_1"], "abcde...", ["a", "b"], ["x", "y"], ["A", "b"], "zh", "A")


def test_constraints_meet_papers_by_distinct_sets(spark, monkeypatch):
    """What is joined to papers, and may be sent to executors, are the sets of constraints and not the questions."""
    sizes = []
    settled = analysis.settled
    monkeypatch.setattr(analysis, "settled", lambda df: (lambda d: sizes.append((d.columns, d.count())) or d)(settled(df)))
    q = spark.range(300).selectExpr("id AS query_id", "CASE id % 3 WHEN 0 THEN 'author: Lee' WHEN 1 THEN 'papers 2001-2003' ELSE 'open' END AS text")
    papers = spark.createDataFrame([(1, "Ann Lee", 2002), (2, "Bo", 2003), (3, "Cy", 2010)], "doc_id long, authors string, year int")
    got = analysis.allowed_documents(analysis.constraints(q, 2026), papers)
    assert sorted(map(tuple, got.collect())) == sorted([(i, 1) for i in range(0, 300, 3)] + [(i, d) for i in range(1, 300, 3) for d in (1, 2)])
    assert [n for c, n in sizes if "query_id" not in c] == [4, 3]
