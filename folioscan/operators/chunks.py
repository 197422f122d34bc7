"""Parents and chunks of packed documents, numbered over the whole corpus without gathering it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions.arrow import sized_splitter, splitter
from folioscan.operators.folds import structure_blocks

SIZE, OVERLAP, HARD_MAX, LEAST_BLOCK = 500, 100, 2400, 120
#: Rows of a range of document numbers that are numbered in one task.
RANGE = 1 << 16


def running_total(rows: DataFrame, order: str, amount: str, name: str, span: int = RANGE) -> DataFrame:
    """`rows` with the sum of `amount` over all rows of a smaller `order`, which is a distinct number from 0.

    Totals of ranges of `span` numbers are summed first, so that no task sees more than a range and the table of ranges.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / span))
    totals = ranged.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    before = totals.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__within", within).join(before, "__range").withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__range", "__within", "__before")


def _parent_id(block: Column) -> Column:
    or_ = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    return F.concat(or_("source", "unknown"), F.lit("::p"), or_("page", "?"), F.lit("::d"), F.col("doc_idx").cast("string"), F.lit("::b"), block.cast("string"))


def semantic_parents(documents: DataFrame) -> DataFrame:
    """Packed documents (doc_idx, source, page, text and further columns) as parents: one each, blank ones go."""
    kept = documents.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    block = F.coalesce("structure_block_id", F.lit(0)) if "structure_block_id" in documents.columns else F.lit(0)
    parent = F.coalesce("parent_id", _parent_id(F.lit(0))) if "parent_id" in documents.columns else _parent_id(F.lit(0))
    return kept.withColumns({"structure_block_id": block.cast("int"), "parent_id": parent, "chunk_strategy": F.lit("semantic_paper")})


def block_parents(documents: DataFrame, structure: bool = True, least: int = LEAST_BLOCK) -> DataFrame:
    """Packed documents as parents by their structure: a row for each block, or for each document without `structure`."""
    kept = documents.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    blocks = structure_blocks(F.col("text"), least) if structure else F.array("text")
    each = kept.select(*[c for c in kept.columns if c not in ("text", "structure_block_id", "parent_id", "chunk_strategy")], F.posexplode(blocks).alias("structure_block_id", "text"))
    return each.withColumns({"parent_id": _parent_id(F.col("structure_block_id")), "chunk_strategy": F.lit("token")})


def sized_parts(parents: DataFrame, tokenizer: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Parents with the texts of all their chunks by tokens (parts) and these texts' tokens (sizes): nothing is moved or numbered."""
    return parents.withColumn("__cut", sized_splitter(size, overlap, tokenizer)("text")).withColumns({"parts": F.col("__cut.parts"), "sizes": F.col("__cut.sizes")}).drop("__cut")


def chunks(parents: DataFrame, strategy: str = "semantic_paper", size: int = SIZE, overlap: int = OVERLAP, hard_max: int = HARD_MAX, tokenizer: str | None = None) -> DataFrame:
    """Chunks of parents with chunk_id, their number in the order of documents and blocks, and chunk_uid.

    semantic_paper: a parent is a chunk, and only one longer than `hard_max` (800 at least) is split; token: all are split.
    A part of a split semantic parent has its number in semantic_child_id.  `size` and `overlap` are tokens of the tokenizer in
    a JSON file if one is named, else characters.
    """
    whole = F.length("text") <= max(hard_max, 800) if strategy == "semantic_paper" else F.lit(False)
    # Python is sent what is to be split and nulls for the rest, as a function's rows are not chosen by the branch that it is in
    parts = F.when(whole, F.array("text")).otherwise(splitter(size, overlap, tokenizer)(F.when(~whole, F.col("text"))))
    cut = parents.withColumn("__parts", parts).withColumn("__split", ~whole)
    cut = cut.withColumn("__parts", F.when(F.size("__parts") > 0, F.col("__parts")).otherwise(F.array("text"))) if strategy == "semantic_paper" else cut
    counts = cut.groupBy("doc_idx").agg(F.sum(F.size("__parts")).cast("long").alias("__n"))
    first = running_total(counts, "doc_idx", "__n", "__first").select("doc_idx", "__first")
    each = cut.select(*[c for c in cut.columns if c not in ("text", "__parts")], F.posexplode("__parts").alias("__i", "text"))
    place = F.row_number().over(Window.partitionBy("doc_idx").orderBy("structure_block_id", "__i")) - 1
    numbered = each.withColumn("__place", place).join(first, "doc_idx").withColumn("chunk_id", F.col("__first") + F.col("__place"))
    uid = F.when(F.trim(F.coalesce("parent_id", F.lit(""))) != "", F.concat(F.trim("parent_id"), F.lit("::c"), F.col("chunk_id").cast("string"))).otherwise(F.concat(F.lit("chunk::"), F.col("chunk_id").cast("string")))
    child = F.when(F.col("__split"), F.col("__i")) if strategy == "semantic_paper" else F.lit(None).cast("int")
    return numbered.withColumns({"chunk_uid": uid, "semantic_child_id": child}).drop("__i", "__split", "__place", "__first")


def chunks_with_parents(documents: DataFrame, strategy: str = "semantic_paper", structure: bool = True, least: int = LEAST_BLOCK, size: int = SIZE, overlap: int = OVERLAP, hard_max: int = HARD_MAX, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) of packed documents; an unknown strategy is semantic_paper."""
    name = strategy.strip().lower()
    name = name if name in ("semantic_paper", "token") else "semantic_paper"
    parents = semantic_parents(documents) if name == "semantic_paper" else block_parents(documents, structure, least)
    return chunks(parents, name, size, overlap, hard_max, tokenizer), parents
