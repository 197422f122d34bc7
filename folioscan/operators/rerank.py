"""Reranking with a scorer that the caller gives; without one, by the share of the question's words in a text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X

from folioscan.functions import text as T
from folioscan.operators.fusion import keep_above
from folioscan.operators.lexical import top_ranked


def overlap(question, text):
    asked = F.array_distinct(T.tokens(question))
    return F.size(F.array_intersect(asked, T.tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(candidates: DataFrame, queries: DataFrame, k: int, gate: DataFrame | None = None, scorer: Callable[[list[str], list[str]], list[float]] | None = None, mode: str = "absolute", least: float | None = None) -> DataFrame:
    """Candidates (query_id, doc_id, rank, text) with `rerank_score` and a new rank, cut to k; questions that the gate
    lets pass keep their order."""
    joined = candidates.join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    if scorer is None:
        score = overlap(F.col("question"), F.col("text"))
    else:

        @F.pandas_udf(X.DoubleType())
        def scored(q: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(scorer(q.tolist(), t.tolist()), index=q.index)

        score = scored("question", "text")
    out = joined.withColumn("rerank_score", F.round(score.cast("double"), 9)).withColumnRenamed("rank", "first_rank")
    if gate is not None:
        out = out.join(gate.select("query_id", "should_rerank"), "query_id", "left")
        kept = out.where(~F.coalesce("should_rerank", F.lit(False))).withColumn("rerank_score", F.lit(None).cast("double"))
        out = out.where("should_rerank").unionByName(kept).drop("should_rerank")
    out = keep_above(out, mode, least, score="rerank_score")
    return top_ranked(out, k, "rerank_score", F.col("first_rank")).drop("question")
