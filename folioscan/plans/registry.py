"""Registered queries of the library's own operators over the driver's tables, each with the SQL that checks it.

`documents` stands for chunks with `source` as the paper and lines as blocks, `benchmark` for questions,
`embeddings` for vectors, `pages` for mark-up, `conversations` for ordered blocks and `labels` for graded metadata.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import assets, cells, dense, evaluate, folds, fusion, incremental, lexical, matching, segments
from folioscan.operators.settle import detailed, shared_folder
from folioscan.plans import analysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Pieces of SQL that several checks share.
TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\x{{4e00}}-\x{{9fff}}]|[a-z0-9_]+')"
WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_TOKENS = TOK.format("text")


def bm25_sql(corpus: str = "documents", k: int = K, name: str = "ranked", asked: str = "benchmark") -> str:
    return f"""
d AS (SELECT doc_id, CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} ELSE ['_'] END AS terms FROM {corpus}),
tf AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d),
tfs AS (SELECT doc_id, term, dl, count(*) AS tf FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(terms)) AS adl FROM d),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tfs, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM {asked}),
qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / adl))), 6) AS score
       FROM qf JOIN idf USING (term) JOIN tfs USING (term) CROSS JOIN st GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})"""


DENSE_Q = "SELECT item_id AS query_id, embedding AS e FROM benchmark JOIN embeddings ON vec_id = item_id"


def dense_sql(where: str = "true", k: int = K, name: str = "dense") -> str:
    return f"""
dq AS ({DENSE_Q}),
{name} AS (SELECT query_id, vec_id AS doc_id,
           round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[]))), 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
           FROM embeddings CROSS JOIN dq WHERE {where} QUALIFY rank <= {k})"""


def version_of(df: DataFrame) -> str:
    """A name for the files that a table is read from as they are now: their paths, sizes and times."""
    spark = df.sparkSession
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    found = [(f, s.getLen(), s.getModificationTime()) for f in sorted(df.inputFiles()) for s in (path(f).getFileSystem(conf).getFileStatus(path(f)),)]
    return hashlib.sha1(repr(found).encode()).hexdigest()[:16]


def stored_index(spark: SparkSession, sf_dir: str) -> segments.Segments:
    """The BM25 index of `documents`, built once for its files as they are in the session's shared folder, then read from there."""
    corpus = docs(spark, sf_dir)
    index = segments.Segments(spark, f"{shared_folder(spark)}/bm25-{version_of(corpus)}")
    if index.store.manifest() is None:
        index.upsert(corpus)
    return index


def ranked(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return stored_index(spark, sf_dir).retrieve(questions(spark, sf_dir), k)


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, sf_dir).join(v, "query_id").select("query_id", "embedding")


def dense_ranked(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return dense.retrieve(table(spark, sf_dir, "embeddings"), asked_vectors(spark, sf_dir), k)


def stored_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The dense index of `embeddings`, built once for its files as they are."""
    vectors = table(spark, sf_dir, "embeddings")
    index = cells.Cells(spark, f"{shared_folder(spark)}/cells-{version_of(vectors)}")
    if index.store.manifest() is None:
        index.upsert(vectors)
    return index


OUT = "SELECT query_id, doc_id, score, rank FROM ranked WHERE score > 0"


@query(f"WITH {bm25_sql()} {OUT}")
def bm25_topk(spark, sf_dir):
    return ranked(spark, sf_dir)


@query(f"""WITH {bm25_sql().replace('ranked AS', 'unused AS')} SELECT n AS n_docs, (SELECT CAST(sum(len(terms)) AS BIGINT) FROM d) AS length, (SELECT count(*) FROM raw) AS n_terms,
 (SELECT count(*) FROM tfs) AS n_postings, round((SELECT avg(r) FROM raw), 9) AS mean_idf FROM st""")
def bm25_index(spark, sf_dir):
    """What the stored index says of itself; built here unless it is there."""
    index = stored_index(spark, sf_dir)
    m, tables = index.store.manifest(), index.store.load()
    postings = next(df for name, df in tables.items() if name.startswith("postings"))
    terms = next(df for name, df in tables.items() if name.startswith("terms"))
    found = postings.where("term IS NOT NULL").agg(F.sum("n").alias("n_postings")).crossJoin(terms.agg(F.count("*").alias("n_terms")))  # one row each
    return found.select(F.lit(m["n_docs"]).cast("long").alias("n_docs"), F.lit(m["length"]).cast("long").alias("length"), "n_terms", "n_postings", F.round(F.lit(m["mean_idf"]), 9).alias("mean_idf"))


@query(f"WITH c AS (SELECT * FROM documents WHERE coalesce(source, '') <> 'src1'), {bm25_sql('c')} {OUT}")
def bm25_after_upsert(spark, sf_dir):
    """An index of all documents, French ones by their sources' names at first; then these get their texts, and one source goes."""
    d = docs(spark, sf_dir)
    index = segments.Segments(spark, f"{shared_folder(spark)}/changed-{uuid.uuid4().hex}")
    index.upsert(d.withColumn("text", F.when(F.col("lang") == "fr", F.col("source")).otherwise(F.col("text"))))
    index.upsert(d.where("lang = 'fr'"))
    index.delete(d.where("source = 'src1'"))
    return index.retrieve(questions(spark, sf_dir), K)


@query(f"WITH c AS (SELECT * FROM documents WHERE lang = 'fr'), {bm25_sql('c')} {OUT}")
def bm25_filtered_corpus(spark, sf_dir):
    """Statistics follow the filter."""
    return lexical.retrieve(docs(spark, sf_dir).where("lang = 'fr'"), questions(spark, sf_dir), K)


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(CASE WHEN len({_TOKENS}) > 0 THEN {_TOKENS} ELSE ['_'] END) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def token_stats(spark, sf_dir):
    return lexical.term_counts(docs(spark, sf_dir))


@query(f"SELECT source, count(*) AS n, round(avg(len({_TOKENS})), 6) AS mean_tokens, CAST(max(len({_TOKENS})) AS BIGINT) AS most FROM documents GROUP BY source")
def doc_length_stats(spark, sf_dir):
    n = F.size(T.tokens(F.col("text")))
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_tokens"), F.max(n).cast("long").alias("most"))


@query(f"WITH {dense_sql()} SELECT * FROM dense")
def dense_topk(spark, sf_dir):
    return dense_ranked(spark, sf_dir)


@query(f"WITH {dense_sql('label < 5')} SELECT * FROM dense")
def dense_filtered_topk(spark, sf_dir):
    return dense.retrieve(table(spark, sf_dir, "embeddings").where("label < 5"), asked_vectors(spark, sf_dir), K)


@query(f"WITH {dense_sql('label <> 7')} SELECT * FROM dense")
def dense_after_upsert(spark, sf_dir):
    """A stored index in which some vectors had other signs at first and some are deleted; questions visit all cells."""
    v = table(spark, sf_dir, "embeddings")
    index = cells.Cells(spark, f"{shared_folder(spark)}/changed-{uuid.uuid4().hex}")
    index.upsert(v.withColumn("embedding", F.when(F.col("label") < 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))))
    index.upsert(v.where("label < 3"))
    index.delete(v.where("label = 7").select(F.col("vec_id").alias("doc_id")))
    return index.retrieve(asked_vectors(spark, sf_dir), K, visit=cells.MOST_CELLS)


@query("SELECT count(*) AS n_questions, true AS enough FROM benchmark JOIN embeddings ON vec_id = item_id")
def dense_index_recall(spark, sf_dir):
    """Whether the cells that the stored index visits hold nine tenths of the true neighbours."""
    found, true = stored_cells(spark, sf_dir).retrieve(asked_vectors(spark, sf_dir), K), dense_ranked(spark, sf_dir)
    both = true.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_questions"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


@query()
def dense_index_topk(spark, sf_dir):
    return stored_cells(spark, sf_dir).retrieve(asked_vectors(spark, sf_dir), K)


def _fused(a: str, b: str) -> str:
    return f"""e AS (SELECT query_id, doc_id, rank, 0 AS l FROM {a} UNION ALL SELECT query_id, doc_id, rank, 1 FROM {b}),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(l * 1000000 + rank) AS seen FROM e GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, doc_id) AS rank FROM f QUALIFY rank <= 10"""


@query(f"WITH {bm25_sql()}, {dense_sql()}, b AS ({OUT}), {_fused('dense', 'b')}")
def rrf_hybrid(spark, sf_dir):
    return fusion.reciprocal_rank([dense_ranked(spark, sf_dir), ranked(spark, sf_dir)], K).select("query_id", "doc_id", "score", "rank")


def _threshold(value: str) -> str:
    return f"WITH {bm25_sql()}, b AS ({OUT}) SELECT query_id, doc_id, score, rank FROM b QUALIFY score >= {value}"


@query(f"WITH {bm25_sql()} {OUT} AND score >= 40.0")
def threshold_absolute(spark, sf_dir):
    return fusion.keep_above(ranked(spark, sf_dir), "absolute", 40.0)


@query(_threshold("greatest(max(score) OVER w - (max(score) OVER w - min(score) OVER w) * (1 - 0.7::DOUBLE), 0.35) ").replace(" QUALIFY", " WINDOW w AS (PARTITION BY query_id) QUALIFY"))
def threshold_relative(spark, sf_dir):
    return fusion.keep_above(ranked(spark, sf_dir), "relative", 0.35, 0.7)


@query(_threshold("greatest(quantile_cont(score, 0.6) OVER w, 0.35) ").replace(" QUALIFY", " WINDOW w AS (PARTITION BY query_id) QUALIFY"))
def threshold_quantile(spark, sf_dir):
    return fusion.keep_above(ranked(spark, sf_dir), "quantile", 0.35, quantile=0.6)


@query(f"""WITH {bm25_sql(k=30)}, b AS ({OUT}), s AS (SELECT b.*, source, CASE WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 THEN 1 ELSE 0 END AS o FROM b JOIN documents USING (doc_id))
SELECT query_id, doc_id, source, rank, row_number() OVER (PARTITION BY query_id ORDER BY o, rank) AS position FROM s QUALIFY position <= 8""")
def diversify_by_source(spark, sf_dir):
    r = detailed(ranked(spark, sf_dir, 30), docs(spark, sf_dir).select("doc_id", "source"))
    return fusion.diversify(r, 8).select("query_id", "doc_id", "source", "rank", "position")


@query(f"""WITH {bm25_sql(k=30)}, b AS ({OUT}) SELECT query_id, source, doc_id, rank FROM b JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1""")
def dedupe_by_key(spark, sf_dir):
    r = detailed(ranked(spark, sf_dir, 30), docs(spark, sf_dir).select("doc_id", "source"))
    return fusion.one_per_key(r, "source").select("query_id", "source", "doc_id", "rank")


@query(f"""WITH {bm25_sql()}, b AS ({OUT}), t AS (SELECT query_id, count(*) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM b WHERE rank <= 2 GROUP BY 1),
r AS (SELECT query_id, CASE WHEN n <= 1 THEN 'single' WHEN s1 >= CASE WHEN abs(s1) <= 0.1 THEN 0.015 ELSE 0.55 END AND (s1 - s2 >= CASE WHEN abs(s1) <= 0.1 THEN 0.001 ELSE 0.08 END OR (s1 - s2) / greatest(abs(s1), 1e-8) >= 0.1) THEN 'confident' ELSE 'uncertain' END AS reason FROM t)
SELECT query_id, reason = 'uncertain' AS should_rerank, reason FROM r""")
def rerank_gate(spark, sf_dir):
    return fusion.rerank_gate(ranked(spark, sf_dir).withColumn("ranks", F.array(F.lit(None).cast("long"), "rank")))


@query("""SELECT doc_id, CASE WHEN r.d THEN 'references' WHEN m THEN 'metadata' WHEN s THEN 'survey' WHEN c THEN 'comparison' ELSE 'factual' END AS route FROM (SELECT doc_id,
 contains(l, 'cite') OR contains(l, 'references') OR contains(l, 'reference list') AS d,
 regexp_matches(l, 'author:|title:|venue|year:|source:|keyword:|metadata|who proposed|proposed by|who introduced|introduced by|which paper proposed') AS m,
 regexp_matches(l, 'survey|overview|state of the art|landscape|roadmap|history|trend') AS s,
 regexp_matches(l, 'compare|comparison|difference|vs') AND (regexp_matches(l, 'vs|/|&|\\band\\b') OR len(list_distinct(list_filter(regexp_extract_all(l, '[a-z][a-z0-9._+-]{1,30}'), lambda x: len(x) >= 3))) >= 2) AS c
 FROM (SELECT doc_id, lower(text) AS l FROM documents)) r""")
def route_types(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", analysis.route_type(F.col("text")).alias("route"))


@query(f"SELECT route, count(*) AS n FROM ({ORACLES['route_types']}) GROUP BY route")
def route_counts(spark, sf_dir):
    return route_types(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, quality, toxic FROM documents d JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND (contains(lower(source), 'src1') OR contains(lower(source), 'src3')) AND quality = 1")
def metadata_filter(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.col("lang").isin("en", "fr")).where(T.contains_any(T.norm(F.col("source")), F.array(F.lit("src1"), F.lit("src3"))))
    return d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "quality", "toxic")


@query("""WITH p AS (SELECT item_id AS query_id, d.source, d.lang, contains(d.text, b.text) AS m, d.doc_id FROM benchmark b CROSS JOIN documents d),
f AS (SELECT query_id, bool_or(m) AS fits FROM p GROUP BY 1) SELECT query_id, count(*) AS allowed FROM p JOIN f USING (query_id) WHERE m OR NOT fits GROUP BY 1""")
def fail_open_filter(spark, sf_dir):
    """A constraint that nothing fits is dropped."""
    q = questions(spark, sf_dir)
    d = docs(spark, sf_dir)
    hits = _containing(d, q).groupBy("query_id").agg(F.count("*").alias("n"))
    return q.join(hits, "query_id", "left").select("query_id", F.coalesce("n", F.lit(d.count()).cast("long")).alias("allowed"))


@query(r"""WITH w AS (SELECT doc_id, unnest(x) AS term, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9\-]{2,}') AS x FROM documents)),
c AS (SELECT doc_id, term, count(*) AS n, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rank FROM c QUALIFY rank <= 20""")
def keyword_topn(spark, sf_dir):
    return assets.keyword_counts(docs(spark, sf_dir))


EDGE = r"""SELECT doc_id, n, CASE WHEN n > 0 THEN left(regexp_replace(trim(ls[1]), '\s+', ' ', 'g'), 160) ELSE '' END AS first, CASE WHEN n > 0 THEN left(regexp_replace(trim(ls[-1]), '\s+', ' ', 'g'), 160) ELSE '' END AS last
FROM (SELECT doc_id, ls, len(ls) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))"""


@query(f"SELECT doc_id, first, last FROM ({EDGE})")
def edge_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.edge_lines(F.col("text")).alias("e")).select("doc_id", "e.first", "e.last")


REPEATED = f"SELECT line, count(*) AS n FROM (SELECT unnest([first, last]) AS line FROM ({EDGE})) WHERE len(line) BETWEEN 4 AND 140 AND regexp_matches(line, '[A-Za-z]{{2,}}') GROUP BY line HAVING count(*) >= 3"


@query(REPEATED)
def edge_line_repetition(spark, sf_dir):
    return assets.repeated_edge_lines(docs(spark, sf_dir))


def _chunks(spark, sf_dir):
    """A third of each column is hand-made from lang and source, so that every flag occurs."""
    d = docs(spark, sf_dir)
    kinds = F.when(F.col("lang") == "fr", F.array(F.lit("equation"))).when(F.col("lang") == "de", F.array(F.lit("image"))).otherwise(F.array(F.lit("text")))
    paths = F.when(F.col("lang") == "es", F.array(F.lit("A"), F.lit("B"))).otherwise(F.array("source"))
    tables = F.when(F.col("source") == "src1", F.array(F.lit("t1"))).otherwise(F.array(F.concat(F.lit("own"), F.col("doc_id").cast("string"))))
    return d.select(F.col("doc_id").alias("chunk_uid"), "text", paths.alias("section_paths"), tables.alias("table_ids"), kinds.alias("block_types"))


FLAGS = f"""SELECT d.doc_id AS chunk_uid, concat_ws(',', CASE WHEN e.first IN (SELECT line FROM r) OR e.last IN (SELECT line FROM r) THEN 'header_footer_repetition' END,
 CASE WHEN lang = 'es' THEN 'cross_section_chunk' END, CASE WHEN source = 'src1' THEN 'table_split_risk' END,
 CASE WHEN lang = 'fr' AND len({WS.format('text')}) < 120 THEN 'equation_without_context' END, CASE WHEN lang = 'de' AND len({WS.format('text')}) < 120 THEN 'media_without_context' END) AS flags
FROM documents d JOIN e USING (doc_id)"""


@query(f"WITH e AS ({EDGE}), r AS ({REPEATED}) {FLAGS}")
def quality_flags(spark, sf_dir):
    return assets.quality_flags(_chunks(spark, sf_dir)).select("chunk_uid", F.array_join("flags", ",").alias("flags"))


@query(f"WITH e AS ({EDGE}), r AS ({REPEATED}), f AS ({FLAGS}) SELECT count(*) AS total, count(*) FILTER (flags <> '') AS failed, count(*) FILTER (flags <> '') / count(*) AS failed_rate FROM f")
def quality_report(spark, sf_dir):
    return assets.quality_report(assets.quality_flags(_chunks(spark, sf_dir))).select("total", "failed", "failed_rate")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT doc_id, CASE WHEN len(s) > 200 THEN rtrim(left(s, 197)) || '...' ELSE s END AS text FROM (SELECT doc_id, {WS.format('text')} AS s FROM documents)")
def truncate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.truncate(F.col("text"), 200).alias("text"))


@query("SELECT source || ' > ' || lang AS path, source AS top, count(*) AS n FROM documents GROUP BY ALL")
def top_section(spark, sf_dir):
    p = docs(spark, sf_dir).select(F.concat_ws(" > ", "source", "lang").alias("path"))
    return p.groupBy("path", T.top_section(F.col("path")).alias("top")).agg(F.count("*").alias("n"))


@query("SELECT source AS doc_id, lang AS section, min(doc_id) AS page, max(doc_id) AS page_end, min(doc_id) || '-' || max(doc_id) AS page_range, count(*) AS n_blocks FROM documents GROUP BY ALL")
def page_range(spark, sf_dir):
    return _sections(spark, sf_dir).drop("summary")


def _sections(spark, sf_dir):
    p = docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("lang").alias("section_path"), F.col("doc_id").alias("page"), F.lit(0).alias("ord"), "text")
    return assets.section_summaries(p)


@query(f"""WITH t AS (SELECT source AS doc_id, lang AS section, string_agg({WS.format('text')}, ' ' ORDER BY doc_id) FILTER ({WS.format('text')} <> '') AS s FROM documents GROUP BY ALL),
u AS (SELECT doc_id, section, CASE WHEN len(s) > 700 THEN rtrim(left(s, 697)) || '...' ELSE s END AS summary FROM t) SELECT doc_id, section, CAST(len(summary) AS BIGINT) AS n, summary FROM u""")
def section_summary(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section", F.length("summary").cast("long").alias("n"), "summary")


@query()
def paper_catalog(spark, sf_dir):
    d = docs(spark, sf_dir)
    blocks = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("page"), F.split("text", "\n")[0].alias("title"), F.lit("").alias("year"), F.lit("").alias("authors"), F.lit("").alias("venue"), F.lit(False).alias("is_reference"), "text")
    abstracts = folds.abstract(blocks)
    return assets.papers(blocks, _sections(spark, sf_dir), citation_edges(spark, sf_dir), abstracts)


@query(f"SELECT substr(sha1(source || '::' || t), 1, 16) AS edge_id, source AS doc_id, left(t, 1200) AS cited_text FROM (SELECT DISTINCT source, {WS.format('text')} AS t FROM documents) WHERE len(t) >= 12")
def citations(spark, sf_dir):
    return citation_edges(spark, sf_dir).select("edge_id", "doc_id", "cited_text")


def citation_edges(spark, sf_dir):
    return assets.citation_edges(docs(spark, sf_dir), "source")


@query(f"""WITH {bm25_sql()}, b AS ({OUT}), p AS (SELECT b.query_id, b.rank, source AS parent_id FROM b JOIN documents USING (doc_id)), t AS (SELECT source AS parent_id, min_by(text, doc_id) AS text FROM documents GROUP BY 1),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1)
SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, CASE WHEN len(text) > 2200 THEN left(text, 2200) || chr(10) || '...[truncated]' ELSE text END AS text FROM f LEFT JOIN t USING (parent_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f.rank) <= 3""")
def parent_expand(spark, sf_dir):
    d = docs(spark, sf_dir).withColumnRenamed("source", "parent_id")
    return assets.expand_to_parents(detailed(ranked(spark, sf_dir), d.select("doc_id", "parent_id")), assets.first_texts(d, "parent_id"))


def _old_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_totalprice")
    return o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'").withColumn("o_totalprice", -F.col("o_totalprice"))


_UP = "o AS (SELECT o_custkey AS doc_id, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'), n AS (SELECT o_custkey AS doc_id, o_orderkey, -o_totalprice AS o_totalprice FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_UP} SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def upsert_merge(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return incremental.upsert({"t": old}, {"t": new})["t"]


@query(f"WITH {_UP} SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def upsert_force(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return incremental.upsert({"t": old}, {"t": new}, force=True)["t"]


@query(f"WITH {_UP} SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def delete_by_id(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return incremental.delete({"t": old}, new)[0]["t"]


@query(f"WITH {_UP} SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM n INTERSECT SELECT CAST(doc_id AS VARCHAR) FROM o")
def known_ids(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return incremental.delete({"t": old}, new)[1]


@query(f"WITH {_UP} SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM n EXCEPT SELECT CAST(doc_id AS VARCHAR) FROM o")
def new_ids(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return incremental.new_ids(new, old)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey")
    return incremental.orphans(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")), "doc_id").withColumnRenamed("doc_id", "c_custkey")


def _containing(d: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that hold a question's whole text."""
    needles = q.select("query_id", F.lit("").alias("grp"), F.col("text").alias("needle"))
    return matching.containing(d.select(F.col("doc_id").alias("id"), F.lit("").alias("grp"), "text"), needles).join(needles, ["grp", "needle"]).select("query_id", F.col("id").alias("doc_id"))


def _qrels(spark, sf_dir):
    return _containing(docs(spark, sf_dir), questions(spark, sf_dir))


EVAL = f"""WITH {bm25_sql()}, b AS ({OUT}), j AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT query_id, min(rank) AS r FROM b JOIN j USING (query_id, doc_id) GROUP BY 1), f AS (SELECT item_id AS query_id, coalesce(r, 0) AS first_rank FROM benchmark LEFT JOIN h ON query_id = item_id)"""


@query(f"{EVAL} SELECT * FROM f")
def first_match_rank(spark, sf_dir):
    return evaluate.first_ranks(questions(spark, sf_dir), ranked(spark, sf_dir), _qrels(spark, sf_dir))


@query(f"{EVAL} SELECT count(*) AS n, round(avg(CASE WHEN first_rank > 0 THEN 1.0 ELSE 0 END), 9) AS hit_rate, round(avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0 END), 9) AS mrr FROM f")
def eval_hit_mrr(spark, sf_dir):
    return evaluate.hit_and_mrr(first_match_rank(spark, sf_dir))


_SETTINGS = (("bm25", "bm25", 5, 60), ("dense", "dense", 10, 60), ("fused", "hybrid", 10, 60), ("sharp", "hybrid", 3, 5))


@query(f"""WITH {bm25_sql()}, {dense_sql()}, b AS ({OUT}), j AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
set_ AS (SELECT * FROM (VALUES {", ".join(map(str, _SETTINGS))}) AS v(setting, mode, k, rrf_k)),
e AS (SELECT query_id, doc_id, rank, 'dense' AS side, 0 AS l FROM dense UNION ALL SELECT query_id, doc_id, rank, 'bm25', 1 FROM b),
f AS (SELECT setting, k, query_id, doc_id, round(sum(1.0::DOUBLE / (rrf_k + rank)), 12) AS score, min(l * 1000000 + rank) AS seen FROM e JOIN set_ ON mode = 'hybrid' OR mode = side GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, seen, doc_id) AS rank FROM f QUALIFY rank <= k),
h AS (SELECT setting, query_id, count(*) AS n_results, min(rank) FILTER ((query_id, doc_id) IN (SELECT (query_id, doc_id) FROM j)) AS r FROM g GROUP BY ALL),
all_ AS (SELECT setting, item_id AS query_id, coalesce(n_results, 0) AS n_results, coalesce(r, 0) AS r FROM set_ CROSS JOIN benchmark LEFT JOIN h ON h.setting = set_.setting AND query_id = item_id)
SELECT setting, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 9) AS hit_rate, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END), 9) AS mrr,
 round(avg(CASE WHEN n_results = 0 THEN 1.0 ELSE 0 END), 9) AS insufficient_rate FROM all_ GROUP BY setting""".replace("SELECT setting, item_id", "SELECT set_.setting, item_id"))
def benchmark_run(spark, sf_dir):
    """A grid of settings over all questions, from one list of each kind."""
    settings = spark.createDataFrame(list(_SETTINGS), "setting string, mode string, k int, rrf_k int")
    return evaluate.grid(questions(spark, sf_dir), settings, dense_ranked(spark, sf_dir), ranked(spark, sf_dir), _qrels(spark, sf_dir))[1]


@query(f"""WITH {bm25_sql()}, b AS ({OUT}), t AS (SELECT query_id, rank, score, CASE WHEN doc_id % 3 > 0 THEN 1.0 / rank END AS fused FROM b WHERE rank <= 2)
SELECT query_id, CASE WHEN count(fused) = 2 THEN 'retrieval_rrf_score' WHEN count(score) = 2 THEN 'bm25_score' END AS score_key FROM t GROUP BY query_id""")
def score_keys(spark, sf_dir):
    """Results whose fused score is missing for some."""
    r = ranked(spark, sf_dir).withColumn("retrieval_rrf_score", F.when(F.col("doc_id") % 3 > 0, 1.0 / F.col("rank")))
    return fusion.pick_score_key(r.withColumnRenamed("score", "bm25_score"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value", "event_type")


@query("WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS v FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(v * n) / sum(n), 9) AS v FROM m")
def weighted_suite(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return evaluate.weighted_suite(m, "v")


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), c AS (SELECT doc_id, ('0x' || substr(sha1(t), 1, 8))::BIGINT % 1024 AS bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM c""")
def hash_embedding(spark, sf_dir):
    return dense.hash_embedding(docs(spark, sf_dir))


@query(f"""WITH {bm25_sql(k=15)}, b AS ({OUT}), s AS (SELECT b.*, CASE WHEN row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 1 THEN 1 ELSE 0 END AS o FROM b JOIN documents USING (doc_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, rank) AS position, rank, doc_id FROM s QUALIFY position <= 5""")
def evidence_select(spark, sf_dir):
    r = detailed(ranked(spark, sf_dir, 15), docs(spark, sf_dir).select("doc_id", "source"))
    return fusion.select_evidence(r.withColumn("identity", F.col("doc_id")).withColumn("bucket", F.col("source")), 5).select("query_id", "position", "rank", "doc_id")
