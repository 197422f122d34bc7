"""Retrieval evaluation: hit rate, reciprocal rank, latency, route histograms, weighted suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(queries: DataFrame, ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, first_rank): the best rank of a relevant document, 0 where none was found."""
    hits = ranked.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("r", F.lit(0)).cast("long").alias("first_rank"))


def hit_and_mrr(ranks: DataFrame) -> DataFrame:
    """One row: n, hit_rate, mrr over all questions."""
    r = F.col("first_rank")
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg((r > 0).cast("double")), 9).alias("hit_rate"), F.round(F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)), 9).alias("mrr"))


def insufficient_rate(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """The share of questions without any result."""
    none = queries.select("query_id").join(ranked.select("query_id").distinct().withColumn("some", F.lit(1)), "query_id", "left")
    return none.agg(F.avg(F.col("some").isNull().cast("double")).alias("insufficient_rate"))


def latency(df: DataFrame, ms: str, *by: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean_ms"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})").alias("p95_ms"))


def weighted_suite(results: DataFrame, *metrics: str) -> DataFrame:
    """Means of dataset metrics, weighted by their numbers of questions `n`."""
    return results.agg(F.sum("n").cast("long").alias("n"), *[F.round(F.sum(F.col(m) * F.col("n")) / F.sum("n"), 9).alias(m) for m in metrics])


def failures(detail: DataFrame) -> DataFrame:
    """Rows where either hit is false."""
    return detail.where(~F.col("paper_hit") | ~F.col("evidence_hit"))


def add_route_counts(each: list[DataFrame]) -> DataFrame:
    """(route, n): the histograms of several evaluations added up."""
    every = None
    for one in each:
        every = one if every is None else every.unionByName(one)
    return every.groupBy("route").agg(F.sum("n").cast("long").alias("n"))


def distinct_contexts(rows: DataFrame) -> DataFrame:
    """Evaluation rows (qid, context_doc_id, context) as a corpus: one row for each context, the first by qid, with how many
    rows share it; a context without an id is named by its digest, and blank ones go."""
    named = rows.where(F.trim(F.coalesce("context", F.lit(""))) != "").withColumn("context_doc_id", F.when(F.trim(F.coalesce("context_doc_id", F.lit(""))) != "", F.trim("context_doc_id")).otherwise(F.md5(F.col("context").cast("binary"))))
    return named.groupBy("context_doc_id").agg(F.min("qid").alias("qid"), F.min_by("context", "qid").alias("context"), F.count("*").alias("n"))


def sample_rows(rows: DataFrame, limit: int, seed: int = 42, shuffle: bool = True, key: str = "qid") -> DataFrame:
    """At most `limit` rows: the first in a hash order that the seed gives, or by key; all of them for a limit of 0 or less."""
    if limit <= 0:
        return rows
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string")) if shuffle else F.col(key)
    return rows.orderBy(order, key).limit(limit)


def save_results(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """Rows as JSON lines and CSV, and the summary as JSON, in one folder."""
    rows.write.mode("overwrite").json(f"{folder}/rows_jsonl")
    flat = rows.select([F.to_json(c).alias(c) if dict(rows.dtypes)[c].startswith(("array", "struct", "map")) else F.col(c) for c in rows.columns])
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/rows_csv")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def grid(queries: DataFrame, settings: DataFrame, dense: DataFrame, lexical: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) of all settings (setting, mode, k, rrf_k) over all questions, from two ranked lists found once.

    Modes are dense, bm25 and hybrid (reciprocal ranks of both lists, the dense one first where scores are equal).  The lists
    must reach the largest k.  detail: a row for each setting and question with n_results and first_rank (0: no relevant
    document); summary: a row for each setting with n, hit_rate, mrr and insufficient_rate (questions without a result).
    """
    each = dense.select("query_id", "doc_id", "rank", F.lit("dense").alias("side"), F.lit(0).alias("place")).unionByName(lexical.select("query_id", "doc_id", "rank", F.lit("bm25").alias("side"), F.lit(1).alias("place")))
    sides = settings.select("*", F.explode(F.when(F.col("mode") == "hybrid", F.array(F.lit("dense"), F.lit("bm25"))).otherwise(F.array("mode"))).alias("side"))
    rows = each.join(sides, "side").groupBy("setting", "k", "query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (F.col("rrf_k") + F.col("rank"))), 12).alias("score"), F.min(F.struct("place", "rank")).alias("seen"),
    )
    place = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "seen", "doc_id"))
    found = rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= F.col("k"))
    good = qrels.select("query_id", "doc_id").distinct().withColumn("good", F.lit(True))
    best = found.join(good, ["query_id", "doc_id"], "left").groupBy("setting", "query_id").agg(F.count("*").alias("n_results"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first_rank"))
    none = F.lit(0).cast("long")
    every = settings.select("setting").join(queries.select("query_id"))  # a row for each: what is asked for
    detail = every.join(best, ["setting", "query_id"], "left").select("setting", "query_id", F.coalesce("n_results", none).alias("n_results"), F.coalesce("first_rank", none).alias("first_rank"))
    r = F.col("first_rank")
    summary = detail.groupBy("setting").agg(
        F.count("*").alias("n"), F.round(F.avg((r > 0).cast("double")), 9).alias("hit_rate"), F.round(F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)), 9).alias("mrr"),
        F.round(F.avg((F.col("n_results") == 0).cast("double")), 9).alias("insufficient_rate"),
    )
    return detail, summary
