"""Ranked rows meet their documents where these are read: no text is shuffled, sorted or read twice."""

import duckdb
from pyspark.sql import functions as F

from folioscan.operators import assets, lexical
from folioscan.operators.settle import detailed
from folioscan.plans import flow, registry, registry_ask

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def without_sizes(spark, make):
    """Plans as for tables whose size Spark doesn't know to be small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        return plan(df), sorted(map(repr, df.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ranked_rows_go_to_their_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    ranked = spark.createDataFrame([(q, (q * 7 + r) % 30, r) for q in range(5) for r in range(1, 4)], "query_id long, doc_id long, rank long")
    text, rows = without_sizes(spark, lambda: detailed(ranked, docs).select("query_id", "doc_id", "rank", "text"))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert rows == sorted(map(repr, ranked.join(docs, "doc_id").select("query_id", "doc_id", "rank", "text").collect()))


def test_diversified_and_single_rows_join_no_shuffled_documents(spark):
    for name in ("diversify_by_source", "dedupe_by_key", "evidence_select"):
        text, rows = without_sizes(spark, lambda name=name: registry.QUERIES[name](spark, SF))
        assert rows and not any("SortMergeJoin" in line and "doc_id" in line and "rank" not in line for line in text.splitlines()), name


def test_entities_are_looked_for_in_texts_read_once(spark):
    for name in ("entity_coverage", "entity_fill"):
        df = registry.QUERIES[name](spark, SF)
        assert "documents.parquet" not in plan(df) and df.count() > 0


def test_entities_are_looked_for_in_whole_texts(spark, tmp_path):
    """The only row that names an entity does so far behind the beginning of its text."""
    filler = " river" * 2000
    rows = [(i, "s", "en", f"delta delta{filler}") for i in range(1, 8)] + [(8, "s", "en", f"delta{filler} eau")] + [(i, "s", "en", "other") for i in range(9, 40)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "delta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.query_id, r.doc_id, r["rank"]) for r in registry.QUERIES["entity_fill"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert (1, 8, 4) in got and len(got) == 6 and got == sorted(con.sql(registry.ORACLES["entity_fill"]).fetchall())


def test_first_texts(spark):
    rows = [("a", 3, "third"), ("a", 1, "first"), ("a", None, "none"), (None, 2, "second"), (None, 5, "x"), ("b", None, "no id"), ("c", 1, None), ("c", 2, "later")]
    t = spark.createDataFrame(rows, "source string, doc_id long, text string")
    want = {(r.source, r.text) for r in t.groupBy("source").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    got = assets.first_texts(t, "source")
    assert got.count() == len(want) and {(r.source, r.text) for r in got.collect()} == want
    assert assets.first_texts(t.where("false"), "source").collect() == []
    again = assets.first_texts(t.unionByName(t), "source")
    assert again.count() == len(want)


def test_a_corpus_is_counted_once(spark):
    t = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "doc_id long, text string")
    words = lexical.vocabulary(t)
    assert "regexp_extract_all" not in plan(words)
    assert {(r.term, r.df, r.n_docs, r.mean_length) for r in words.collect()} == {("a", 1, 3, 2.0), ("b", 2, 3, 2.0), ("c", 1, 3, 2.0), ("_", 1, 3, 2.0)}


def test_papers_are_asked_for_without_chunks(spark, monkeypatch):
    asked = []
    recall = flow.recall
    monkeypatch.setattr(flow, "recall", lambda corpus, *a, **b: asked.append(corpus.columns) or recall(corpus, *a, **b))
    assert registry_ask.ask_papers(spark, SF).count() > 0
    assert len(asked) == 1
