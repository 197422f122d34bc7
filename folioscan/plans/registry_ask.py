"""Registered queries of whole questions: variants, fused variants, evidence, entities, constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import vocabulary as V
from folioscan.operators import assets, evaluate, fusion
from folioscan.operators.settle import detailed, settled
from folioscan.plans import analysis, flow
from folioscan.plans.registry import OUT, TOK, WS, bm25_sql, docs, query, questions, ranked, table


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _words(x: str) -> str:
    return "[" + ", ".join(map(_text, x.split(" "))) + "]"


def _distinct(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda y: trim(y)), lambda x, i: x <> '' AND list_position(list_transform({x}, lambda z: lower(trim(z))), lower(x)) = i)"


def _mapped(low: str, entries: dict[str, str]) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN contains({low}, {_text(k.lower())}) THEN {_words(v)} ELSE [] END" for k, v in entries.items()) + "])"


def _bare(x: str) -> str:
    for p in V.BOILERPLATE:
        x = f"regexp_replace({x}, {_text(p)}, '', 'g')"
    return WS.format(x)


_STOP = ", ".join(map(_text, V.STOPWORDS))
_FILL = ", ".join(map(_text, V.FILLERS))
_ACRONYMS = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(low, '\\b{k}\\b') THEN {_words(v)} ELSE [] END, CASE WHEN contains(low, {_text(v)}) THEN [{_text(k.upper())}] ELSE [] END" for k, v in V.ACRONYMS.items()) + "])"
_INTENTS = "flatten([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, {_text(t)})" for t in ts) + f" THEN {_words(v)} ELSE [] END" for ts, v in V.INTENTS) + "])"
_WITH = "CASE WHEN len({0}) > 0 THEN core || ' ' || array_to_string({0}, ' ') ELSE '' END"


def variants_sql(most: int) -> str:
    """CTE v of (item_id, variant, text)."""
    return f"""v0 AS (SELECT item_id, {WS.format('text')} AS plain, {_bare(WS.format('text'))} AS bare FROM benchmark),
v1 AS (SELECT *, CASE WHEN bare <> '' THEN bare ELSE plain END AS core FROM v0),
v2 AS (SELECT *, lower(core) AS low FROM v1),
v3 AS (SELECT *, {_mapped('low', V.ALIASES)} AS al, list_filter(regexp_extract_all(core, {_text(V.KEYWORD_TOKEN)}), lambda w: lower(w) NOT IN ({_STOP}) AND w NOT IN ({_FILL})) AS kw, {_INTENTS} AS it, {_ACRONYMS} AS ac,
 CASE WHEN regexp_matches(core, '[一-鿿]') THEN {_mapped('low', V.ZH_TO_EN)} ELSE [] END AS zh, CASE WHEN regexp_matches(core, '[A-Za-z]') THEN {_mapped('low', V.EN_TO_ZH)} ELSE [] END AS en FROM v2),
v4 AS (SELECT *, {_distinct('al')} AS alias, {_distinct('kw')} AS words, {_distinct('it')} AS intent, {_distinct('ac')} AS short, {_distinct('zh')} AS zh1, {_distinct('en')} AS en1 FROM v3),
v5 AS (SELECT *, list_concat(zh1, en1) AS oth, list_concat(words, intent, short, alias) AS al2 FROM v4),
v6 AS (SELECT *, {_distinct('oth')} AS other, {_distinct('al2')} AS every FROM v5),
v7 AS (SELECT item_id, [plain, bare, {_WITH.format('alias')}, array_to_string(words, ' '), {_WITH.format('other')}, array_to_string(every, ' ')] AS each FROM v6),
v8 AS (SELECT item_id, ({_distinct('each')})[1:{most}] AS l FROM v7),
v AS (SELECT item_id, unnest(range(len(l))) AS variant, unnest(l) AS text FROM v8)"""


@query(f"WITH {variants_sql(6)} SELECT item_id AS query_id, CAST(variant AS INTEGER) AS variant, text FROM v")
def query_variants(spark, sf_dir):
    return analysis.variants(questions(spark, sf_dir), 6).select("query_id", F.posexplode("variants").alias("variant", "text"))


def _chunks(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_uid"), F.col("source").alias("doc_id"), "source", "text", (F.col("doc_id") % 5).alias("page"), F.col("lang").alias("section_path"))


@query(f"""WITH {variants_sql(3)}, vq AS (SELECT item_id * 10 + variant AS item_id, text FROM v), r AS (WITH {bm25_sql(k=20, asked='vq')} {OUT}),
f AS (SELECT query_id // 10 AS query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min((query_id % 10) * 1000000 + rank) AS seen FROM r GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_multi_variant(spark, sf_dir):
    corpus = docs(spark, sf_dir).select("doc_id", F.col("source").alias("paper_id"), "text")
    return flow.recall(corpus, questions(spark, sf_dir), 10, analysis.Settings(variants=3)).select("query_id", "doc_id", "score", "rank")


def _papers(spark, sf_dir):
    first = assets.first_texts(docs(spark, sf_dir), "source")
    return first.select(F.col("source").alias("doc_id"), F.col("text").alias("summary"))


ROUTE = """SELECT item_id AS query_id, CASE WHEN contains(l, 'cite') OR contains(l, 'references') OR contains(l, 'reference list') THEN 'references'
 WHEN regexp_matches(l, 'author:|title:|venue|year:|source:|keyword:|metadata|who proposed|proposed by|who introduced|introduced by|which paper proposed') THEN 'metadata'
 WHEN regexp_matches(l, 'survey|overview|state of the art|landscape|roadmap|history|trend') THEN 'survey' ELSE 'factual' END AS route FROM (SELECT item_id, lower(text) AS l FROM benchmark)"""
ASK = f"""WITH plan AS (SELECT query_id, route, CASE route WHEN 'references' THEN 0 WHEN 'survey' THEN 9 ELSE 7 END AS paper_k, CASE route WHEN 'references' THEN 12 WHEN 'metadata' THEN 16 WHEN 'survey' THEN 36 ELSE 8 END AS chunk_k,
 CASE route WHEN 'survey' THEN 6 ELSE 5 END AS final_k FROM ({ROUTE})),
pap AS (SELECT source AS doc_id, min_by(text, doc_id) AS text FROM documents GROUP BY 1),
pr AS (WITH {bm25_sql('pap', 9)} {OUT}), rec AS (SELECT query_id, doc_id AS paper_id FROM pr JOIN plan USING (query_id) WHERE rank <= paper_k),
cs AS (WITH {bm25_sql(k=1000000)} {OUT}),
c AS (SELECT cs.query_id, cs.doc_id, source AS paper_id, doc_id % 5 AS page, lang, row_number() OVER (PARTITION BY cs.query_id ORDER BY cs.score DESC, doc_id) AS rank FROM cs JOIN documents USING (doc_id) JOIN rec ON rec.query_id = cs.query_id AND rec.paper_id = source),
k AS (SELECT c.*, final_k, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS n FROM c JOIN plan USING (query_id) WHERE rank <= chunk_k AND rank <= greatest(3 * final_k, final_k + 4)),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 2 THEN 1 ELSE 0 END, rank) AS pos FROM k QUALIFY pos <= final_k),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id, page, lang ORDER BY pos) AS b FROM d)"""


@query(ASK + " SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN b > 1 THEN 1 ELSE 0 END, pos) AS position, doc_id, paper_id FROM e")
def ask_evidence(spark, sf_dir):
    """Whole flow with papers by summaries, chunks within them, selection by source and evidence by page and section."""
    got = flow.ask(questions(spark, sf_dir), _chunks(spark, sf_dir), _papers(spark, sf_dir), analysis.Settings(variants=1), use_reranker=False)
    return got["evidence"].select("query_id", "position", "doc_id", "paper_id")


@query(ASK + " SELECT query_id, rank, doc_id AS paper_id FROM pr JOIN plan USING (query_id) WHERE rank <= paper_k")
def ask_papers(spark, sf_dir):
    """The flow's first step alone: chunks are ranked after it."""
    return flow.recall_papers(questions(spark, sf_dir), _papers(spark, sf_dir), analysis.Settings(variants=1))[1].select("query_id", "rank", "paper_id")


@query(f"""WITH {bm25_sql(k=15)}, b AS ({OUT}), qe AS (SELECT item_id AS query_id, list_sort(list_distinct({TOK.format('text')}))[1:2] AS es FROM benchmark),
c AS (SELECT b.query_id, b.rank, b.doc_id, source, text FROM b JOIN documents USING (doc_id)),
n AS (SELECT c.query_id, rank, e FROM c JOIN (SELECT query_id, unnest(es) AS entity, unnest(range(len(es))) AS e FROM qe) x ON x.query_id = c.query_id AND contains(lower(c.text), entity)),
f AS (SELECT query_id, rank, min(e) AS e FROM (SELECT query_id, e, min(rank) AS rank FROM n GROUP BY ALL) GROUP BY ALL),
j AS (SELECT c.*, e FROM c LEFT JOIN f USING (query_id, rank)),
t AS (SELECT *, CASE WHEN e IS NOT NULL THEN 0 WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY e IS NULL, e, rank) <= 2 THEN 1 ELSE 2 END AS tier FROM j)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, coalesce(e, 0), rank) AS position, rank, doc_id FROM t QUALIFY position <= 6""")
def entity_coverage(spark, sf_dir):
    q = questions(spark, sf_dir).select("query_id", F.slice(F.array_sort(F.array_distinct(T.tokens(F.col("text")))), 1, 2).alias("entities"))
    r = settled(detailed(ranked(spark, sf_dir, 15), docs(spark, sf_dir).select("doc_id", "source", "text")))
    return fusion.cover_entities(r.join(q, "query_id"), 6).select("query_id", "position", "rank", "doc_id")


@query("""WITH q AS (SELECT c_custkey AS query_id, c_custkey % 4 AS k, c_nationkey FROM customer), p AS (SELECT n_nationkey AS doc_id, n_name, 1990 + n_nationkey AS year, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT query_id, doc_id FROM q JOIN p ON CASE k WHEN 0 THEN doc_id = c_nationkey WHEN 1 THEN year BETWEEN 1992 AND 1990 + c_nationkey OR year BETWEEN 1990 + c_nationkey AND 1992 WHEN 2 THEN contains(lower(r_name), 'asia') AND year > 2000 ELSE false END""")
def constrained_papers(spark, sf_dir):
    """Nations stand for papers: authors by name, years by a range, venue and years; a fourth of the questions is open."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    papers = n.select(F.col("n_nationkey").alias("doc_id"), F.lit("").alias("source"), F.col("n_name").alias("title"), F.concat(F.lit("nr"), F.col("n_nationkey").cast("string"), F.lit("x ")).alias("authors"), (F.col("n_nationkey") + 1990).alias("year"), F.col("r_name").alias("venue"), F.lit("").alias("keywords"))
    k, key = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("author: NR"), key, F.lit("X"))).when(k == 1, F.concat(F.lit("papers 1992-"), (F.col("c_nationkey") + 1990).cast("string"))).when(k == 2, "venue: Asia after 2000").otherwise("anything at all")
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), text.alias("text"))
    return analysis.allowed_documents(analysis.constraints(q, 2026), papers)


@query("SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type, user_id % 3) GROUP BY event_type")
def suite_route_counts(spark, sf_dir):
    """Histograms of several evaluations added up."""
    e = table(spark, sf_dir, "events")
    each = [e.where(F.col("user_id") % 3 == i).groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n")) for i in range(3)]
    return evaluate.add_route_counts(each).withColumnRenamed("route", "event_type")


@query("""WITH c AS (SELECT md5(text) AS context_doc_id, text AS context, source, doc_id FROM documents WHERE trim(text) <> '')
SELECT context_doc_id, min(doc_id) AS first_row, count(*) AS n FROM c GROUP BY context_doc_id""")
def dedupe_contexts(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.lit("").alias("context_doc_id"), F.col("text").alias("context"))
    return evaluate.distinct_contexts(rows).select("context_doc_id", F.col("qid").alias("first_row"), "n")


@query(f"""WITH {bm25_sql()}, b AS ({OUT}), t AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM b WHERE rank <= 2 GROUP BY 1)
SELECT b.query_id, doc_id, rank, CASE WHEN n <= 1 THEN 'single_candidate' WHEN s1 >= CASE WHEN abs(s1) <= 0.1 THEN 0.015 ELSE 0.55 END AND (s1 - s2 >= CASE WHEN abs(s1) <= 0.1 THEN 0.001 ELSE 0.08 END OR (s1 - s2) / greatest(abs(s1), 1e-8) >= 0.1) THEN 'high_confidence_skip' ELSE 'low_confidence_need_rerank' END AS decision,
 round(s1 - s2, 6) AS score_gap FROM b JOIN t USING (query_id)""")
def rerank_decisions(spark, sf_dir):
    r = ranked(spark, sf_dir).withColumn("ranks", F.array(F.lit(None).cast("long"), "rank"))
    return fusion.attach_decision(r, fusion.rerank_gate(r)).select("query_id", "doc_id", "rank", "decision", F.round("score_gap", 6).alias("score_gap"))


@query("SELECT c_custkey % 100 AS query_id, min(c_acctbal / 10000) >= 0 AND max(c_acctbal / 10000) <= 1 AS similar FROM customer GROUP BY 1")
def similarity_scale(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("query_id"), (F.col("c_acctbal") / 10000).alias("score"))
    return fusion.similarity_scores(c)


@query("SELECT doc_id, sha1(len(source) || ':' || source || '|' || len(lang) || ':' || lang || '|' || left(text, 1200)) AS fingerprint FROM documents")
def row_fingerprints(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", fusion.fingerprint(F.col("text"), F.col("source"), F.col("lang")).alias("fingerprint"))


@query(f"""WITH {bm25_sql(k=12)}, b AS ({OUT}), c AS (SELECT b.*, lower(text) AS hay FROM b JOIN documents USING (doc_id)), p AS (SELECT * FROM c WHERE rank <= 3), r AS (SELECT * FROM c WHERE rank > 3),
e AS (SELECT item_id AS query_id, unnest(['the', 'zzz', 'eau', 'und']) AS entity, unnest([0, 1, 2, 3]) AS e FROM benchmark),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = e.query_id AND contains(hay, entity))),
f AS (SELECT query_id, doc_id, min(e) AS e FROM (SELECT r.query_id, m.e, min_by(doc_id, rank) AS doc_id FROM r JOIN m ON m.query_id = r.query_id AND contains(hay, entity) GROUP BY ALL) GROUP BY ALL),
x AS (SELECT query_id, doc_id, 0 AS tier, rank AS o FROM p UNION ALL SELECT r.query_id, r.doc_id, CASE WHEN f.e IS NULL THEN 2 ELSE 1 END, coalesce(f.e, r.rank) FROM r LEFT JOIN f ON f.query_id = r.query_id AND f.doc_id = r.doc_id)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, o) AS rank FROM x QUALIFY rank <= 6""")
def entity_fill(spark, sf_dir):
    """The three best rows, with entities that they lack from the next nine; a row keeps which entities its whole text names."""
    names = ("the", "zzz", "eau", "und")
    r = detailed(ranked(spark, sf_dir, 12), docs(spark, sf_dir).select("doc_id", "text"))
    hay = F.array_join(F.filter(F.array(*map(F.lit, names)), lambda x: F.contains(F.lower("text"), x)), "\n")
    r = settled(r.select("query_id", "doc_id", "rank", hay.alias("hay")))
    e = questions(spark, sf_dir).select("query_id", F.posexplode(F.array(*map(F.lit, names))).alias("e", "entity"))
    return fusion.fill_entities(r.where("rank <= 3"), r.where("rank > 3"), e, 6)
