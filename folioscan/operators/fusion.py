"""Fusion of ranked lists, score thresholds and selection of results, keyed by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.vocabulary import DECISIONS

RRF = 60


def reciprocal_rank(lists: list[DataFrame], k: int, rrf_k: int = RRF) -> DataFrame:
    """(query_id, doc_id, score, rank, ranks): the sum of 1 / (rrf_k + rank) over lists; rrf_k of 0 or less is 60.

    Ties keep the first appearance: the earlier list, then the better rank.  `ranks` has the last rank in each list.
    """
    rrf_k = rrf_k if rrf_k > 0 else RRF
    every = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("list", "rank")).alias("seen"),
        F.array(*[F.max(F.when(F.col("list") == i, F.col("rank"))) for i in range(len(lists))]).alias("ranks"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("seen")


def threshold(mode: str = "relative", absolute: float | None = 0.35, ratio: float = 0.7, quantile: float = 0.6, score: str = "score") -> Column:
    """A question's least score, as a window expression; null keeps everything.

    absolute: the number itself; relative: top - (top - bottom) * (1 - ratio); quantile: linear interpolation.  In the
    last two the absolute number is a floor.
    """
    group = Window.partitionBy("query_id")
    if mode == "relative":
        r = min(max(ratio, 0.0), 1.0)
        found = F.max(score).over(group) - (F.max(score).over(group) - F.min(score).over(group)) * (1 - r)
    elif mode == "quantile":
        found = F.percentile(F.col(score), F.lit(min(max(quantile, 0.0), 1.0))).over(group)
    else:
        return F.lit(absolute).cast("double")
    return found if absolute is None else F.greatest(found, F.lit(float(absolute)))


def keep_above(ranked: DataFrame, mode: str = "relative", absolute: float | None = 0.35, ratio: float = 0.7, quantile: float = 0.6, score: str = "score") -> DataFrame:
    """Rows at or above the threshold; a row without a score goes, unless its question has no score at all."""
    least = threshold(mode, absolute, ratio, quantile, score)
    none = F.max(score).over(Window.partitionBy("query_id")).isNull()
    return ranked.withColumn("__keep", least.isNull() | none | F.coalesce(F.col(score) >= least, F.lit(False))).where("__keep").drop("__keep")


#: The scores that a result may have, the one to judge by first.
SCORE_KEYS = ("retrieval_score", "retrieval_multi_rrf_score", "retrieval_rrf_score", "bm25_score")


def pick_score_key(ranked: DataFrame, keys: tuple[str, ...] = SCORE_KEYS) -> DataFrame:
    """(query_id, score_key): the first of the score columns that a question's two best results both have as a number; null
    where there is none, or only one result."""
    here = [c for c in keys if c in ranked.columns]
    top = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("__n <= 2")
    both = top.groupBy("query_id").agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in here])
    return both.select("query_id", (F.coalesce(*[F.when(F.col(c) == 2, F.lit(c)) for c in here]) if here else F.lit(None).cast("string")).alias("score_key"))


def one_per_key(ranked: DataFrame, *keys: str, order: str = "rank") -> DataFrame:
    """The first row for each question and key."""
    return ranked.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(order))).where("__n = 1").drop("__n")


def diversify(ranked: DataFrame, k: int, per_source: int = 2, source: str = "source") -> DataFrame:
    """At most `per_source` of each source, then the rest in rank order up to k.  Adds `position`."""
    n = F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))
    capped = ranked.withColumn("__over", (n > per_source).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("__over", "rank"))
    return capped.withColumn("position", place.cast("long")).where(F.col("position") <= k).drop("__over")


def rerank_gate(
    ranked: DataFrame, enabled: bool = True, least: float = 0.55, gap: float = 0.08, relative_gap: float = 0.1, score: str = "score", ranks: str = "ranks"
) -> DataFrame:
    """(query_id, should_rerank, reason) from the two best of each question.

    Small-scale scores (0.1 or less) are held against 0.015 and 0.001.  The gate lets a question skip reranking when both
    lists agree on the best, when the best leads by three ranks in one list, or when its score is high and clear.
    """
    top = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    t = ranked.where("rank <= 2").groupBy("query_id").agg(top(1, score).alias("s1"), top(2, score).alias("s2"), top(1, ranks).alias("r1"), top(2, ranks).alias("r2"), F.count("*").alias("n"))
    strong = lambda r: F.size(F.filter(F.col(r), lambda x: x <= 2))
    small = F.abs("s1") <= 0.1
    need, margin = F.when(small, 0.015).otherwise(least), F.when(small, 0.001).otherwise(gap)
    ahead = F.exists(F.zip_with("r1", "r2", lambda a, b: (a == 1) & (b >= 4)), lambda x: F.coalesce(x, F.lit(False)))
    clear = (F.col("s1") - F.col("s2") >= margin) | ((F.col("s1") - F.col("s2")) / F.greatest(F.abs("s1"), F.lit(1e-8)) >= relative_gap)
    reason = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.col("n") <= 1, "single")
        .when(F.col("s1").isNull() | F.col("s2").isNull(), "no_score")
        .when((strong("r1") >= 2) & (strong("r2") == 0), "consensus")
        .when(ahead, "rank_gap")
        .when((F.col("s1") >= need) & clear, "confident")
        .otherwise("uncertain")
    )
    return t.select("query_id", reason.isin("no_score", "uncertain").alias("should_rerank"), reason.alias("reason"))


def select_evidence(candidates: DataFrame, k: int, identity: str = "identity", bucket: str = "bucket") -> DataFrame:
    """Up to k per question: first unseen identities from unfilled buckets (one each), then unseen identities in rank order.

    An identity counts as seen only when chosen, so the rules meet in a fold over the (bounded) candidates of a question.
    """
    row = F.struct("rank", F.col(identity).cast("string").alias("id"), F.col(bucket).cast("string").alias("b"))
    folded = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.expr("struct(cast(array() as array<string>) AS ids, cast(array() as array<string>) AS bs, cast(array() as array<bigint>) AS picks)")

    def step(bucketed: bool):
        def one(s: Column, x: Column) -> Column:
            full = F.array_contains(s["bs"], x["b"]) if bucketed else F.lit(False)
            take = (F.size(s["picks"]) < k) & ~F.array_contains(s["ids"], x["id"]) & ~full
            return F.when(take, F.struct(F.concat(s["ids"], F.array(x["id"])).alias("ids"), F.concat(s["bs"], F.array(x["b"])).alias("bs"), F.concat(s["picks"], F.array(x["rank"].cast("long"))).alias("picks"))).otherwise(s)

        return one

    first = folded.select("query_id", "rows", F.aggregate("rows", empty, step(True)).alias("s"))
    both = first.select("query_id", F.aggregate("rows", F.col("s"), step(False))["picks"].alias("picks"))
    return both.select("query_id", F.posexplode("picks").alias("i", "rank")).select("query_id", (F.col("i") + 1).cast("long").alias("position"), "rank").join(candidates, ["query_id", "rank"])


def cover_entities(candidates: DataFrame, k: int, per_source: int = 2, source: str = "source", entities: str = "entities", text: str = "text") -> DataFrame:
    """Up to k per question: the best document that names each entity, then rank order under the source cap, then the rest."""
    named = candidates.select("query_id", "rank", F.posexplode(entities).alias("e", "entity"), text).where(F.contains(F.lower(text), F.lower("entity")))
    firsts = named.groupBy("query_id", "e").agg(F.min("rank").alias("rank")).groupBy("query_id", "rank").agg(F.min("e").alias("e"))
    joined = candidates.join(firsts, ["query_id", "rank"], "left")
    n = F.row_number().over(Window.partitionBy("query_id", source).orderBy(F.col("e").isNull(), "e", "rank"))
    tier = F.when(F.col("e").isNotNull(), 0).when(n <= per_source, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.coalesce("e", F.lit(0)), "rank"))
    return joined.withColumn("tier", tier).withColumn("position", place.cast("long")).where(F.col("position") <= k).drop("tier", "e")


def similarity_scores(ranked: DataFrame, score: str = "score") -> DataFrame:
    """(query_id, similar): whether all of a question's scores lie between 0 and 1; false for one without a score."""
    return ranked.groupBy("query_id").agg(F.coalesce((F.min(score) >= 0) & (F.max(score) <= 1), F.lit(False)).alias("similar"))


def attach_decision(ranked: DataFrame, gate: DataFrame, score: str = "score") -> DataFrame:
    """Ranked rows with their question's decision: reason, whether to rerank, the two best scores and their gaps.

    A question with one candidate or none has nothing to rerank.
    """
    top = lambda i: F.max(F.when(F.col("rank") == i, F.col(score).cast("double")))
    best = ranked.groupBy("query_id").agg(top(1).alias("top1_score"), top(2).alias("top2_score"))
    gap = F.col("top1_score") - F.col("top2_score")
    names = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    found = gate.join(best, "query_id").select("query_id", names[F.col("reason")].alias("decision"), "should_rerank", "top1_score", "top2_score", gap.alias("score_gap"), (gap / F.greatest(F.abs("top1_score"), F.lit(1e-8))).alias("relative_gap"))
    filled = F.coalesce("decision", F.lit(DECISIONS["single"])), F.coalesce("should_rerank", F.lit(False))
    return ranked.join(found, "query_id", "left").withColumns({"decision": filled[0], "should_rerank": filled[1]})


def fill_entities(primary: DataFrame, backup: DataFrame, entities: DataFrame, k: int, text: str = "hay") -> DataFrame:
    """Primary rows (query_id, doc_id, rank, text), then for each entity (query_id, e, entity) that none of them names the
    best backup row that does, then other backup rows in order, up to k; ranks are numbered anew."""
    named = primary.join(entities, "query_id").where(F.contains(text, F.lower("entity"))).select("query_id", "e").distinct()
    missing = entities.join(named, ["query_id", "e"], "left_anti")
    rest = backup.join(primary.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    hits = rest.join(missing, "query_id").where(F.contains(text, F.lower("entity")))
    first = hits.groupBy("query_id", "e").agg(F.min_by("doc_id", "rank").alias("doc_id")).groupBy("query_id", "doc_id").agg(F.min("e").alias("e"))
    every = primary.select("query_id", "doc_id", F.lit(0).alias("tier"), F.col("rank").alias("o")).unionByName(
        rest.join(first, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.when(F.col("e").isNotNull(), 1).otherwise(2).alias("tier"), F.coalesce(F.col("e").cast("long"), F.col("rank")).alias("o"))
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "o"))
    return every.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def fingerprint(text: Column, *meta: Column) -> Column:
    """SHA-1 of a row's stable fields and the first 1,200 characters of its text; scores and ranks are left out by the caller."""
    parts = [F.concat(F.length(F.coalesce(m.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(m.cast("string"), F.lit(""))) for m in meta]
    return F.sha1(F.concat_ws("|", *parts, F.substring(F.coalesce(text, F.lit("")), 1, 1200)).cast("binary"))
