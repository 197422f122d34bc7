"""The registered query of each operator: production parameters, the whole table, the full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import alignment, bpe, forest, licences, lm, outliers, packing, piece, quality, simhash, substring, variants, warc
from folioscan.llm.common import documents
from folioscan.llm.licence_texts import SPELLINGS, TEXTS


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rules(documents(spark, sf_dir))


def op5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir)).withColumn("notices", F.array_join("notices", ","))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_substring, op3_warc, op4_outliers, op5_forest, op6_licences, op7_bpe, op8_packing, op9_backoff, op10_simhash, op11_alignment, op12_variants, op13_pieces)
}


def _licences_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEXTS)
    spelled = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS)
    return rf"""
WITH raw AS (
  SELECT 'd' AS kind, doc_id, '' AS licence, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'l', doc_id, '', t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)
            WHERE regexp_matches(lower(t), '{licences.ASKS}')
  UNION ALL SELECT 'k', 0, licence, t FROM (VALUES {texts}) AS v(licence, t)),
plain AS (SELECT kind, doc_id, licence, trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '{licences.COPYRIGHT}', ' ', 'g'), '{licences.RIGHTS}', ' ', 'g'), '{licences.OTHER}', ' ', 'g')) AS p FROM raw),
form AS (SELECT kind, doc_id, licence, array_to_string(list_transform(string_split(p, ' '), lambda w: coalesce(MAP {{{spelled}}}[w], w)), ' ') AS f FROM plain),
k AS (SELECT sha256(f) AS h, min(licence) AS licence_id FROM form WHERE kind = 'k' GROUP BY 1),
n AS (SELECT doc_id, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notices FROM form JOIN k ON h = sha256(f) WHERE kind = 'l' GROUP BY 1)
SELECT form.doc_id, CAST(CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ' ')) END AS BIGINT) AS n_words, sha256(f) AS canonical_sha256,
       licence_id, coalesce(notices, '') AS notices
FROM form LEFT JOIN k ON h = sha256(f) LEFT JOIN n ON n.doc_id = form.doc_id WHERE kind = 'd'
"""


ORACLES: dict[str, str] = {
    "op6_licences": _licences_sql(),
    "op9_backoff": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS c, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, c, lag(c, 1) OVER d AS b, lag(c, 2) OVER d AS a FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT c AS w1, count(*) AS n1 FROM g GROUP BY ALL),
c2 AS (SELECT b AS w1, c AS w2, count(*) AS n2 FROM g WHERE b IS NOT NULL GROUP BY ALL),
c3 AS (SELECT a AS w1, b AS w2, c AS w3, count(*) AS n3 FROM g WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT g.doc_id, least(g.i - 1, 2) AS reach,
             CASE WHEN n3 >= 2 THEN 2 WHEN e.n2 >= 2 THEN 1 ELSE 0 END AS used,
             CASE WHEN n3 >= 2 THEN n3 / f.n2 WHEN e.n2 >= 2 THEN e.n2 / h.n1 ELSE k.n1 / n.n END AS ratio
      FROM g CROSS JOIN n
      LEFT JOIN c3 ON c3.w1 = a AND c3.w2 = b AND c3.w3 = c
      LEFT JOIN c2 e ON e.w1 = b AND e.w2 = c
      LEFT JOIN c2 f ON f.w1 = a AND f.w2 = b
      LEFT JOIN c1 h ON h.w1 = b
      LEFT JOIN c1 k ON k.w1 = c),
z AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (used < reach) AS n_backed_off,
             sum(ln(ratio * pow(0.4, reach - used))) AS log_score FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backed_off, 0) AS BIGINT) AS n_backed_off,
       round(coalesce(log_score, 0), 6) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM w LEFT JOIN z USING (doc_id)
""",
    "op2_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
p AS (SELECT doc_id, j AS i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d || ' ' || lead(word, 5) OVER d || ' ' || lead(word, 6) OVER d || ' ' || lead(word, 7) OVER d || ' ' || lead(word, 8) OVER d || ' ' || lead(word, 9) OVER d || ' ' || lead(word, 10) OVER d || ' ' || lead(word, 11) OVER d || ' ' || lead(word, 12) OVER d AS words FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS least FROM p WHERE words IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k WHERE least < doc_id),
s AS (SELECT t.doc_id, list(word ORDER BY t.j) AS kept FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.j = g.j GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(coalesce(kept, [])) AS BIGINT) AS n_removed,
       sha256(array_to_string(coalesce(kept, []), ' ')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
""",
}
