"""Derived tables: sections, papers, catalog, citation edges, reference keywords, quality flags, purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators.folds import fit_texts
from folioscan.operators.settle import settled, side


def section_summaries(parents: DataFrame, limit: int = 700) -> DataFrame:
    """(doc_id, section, page, page_end, page_range, n_blocks, summary) by top section; references and noise go."""
    top = parents.withColumn("section", T.top_section(F.col("section_path")))
    kept = top.where(~T.is_reference_section(F.col("section")) & ~T.is_noise_section(F.col("section")))
    rows = F.array_sort(F.collect_list(F.struct("page", "ord", F.substring(T.squeeze(F.col("text")), 1, limit + 2).alias("text"))))  # no summary reads more of a text; one blank may go
    return kept.groupBy("doc_id", "section").agg(
        F.min("page").alias("page"), F.max("page").alias("page_end"), F.concat_ws("-", F.min("page"), F.max("page")).alias("page_range"), F.count("*").alias("n_blocks"),
        fit_texts(F.transform(rows, lambda x: x["text"]), limit).alias("summary"),
    )


def citation_edges(references: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(edge_id, doc_id, cited_text, authors, year, title): one edge for each distinct entry of 12 characters or more."""
    s = references.select(F.col(doc_id).cast("string").alias("doc_id"), T.squeeze(F.col(text)).alias("t")).where(F.length("t") >= 12)
    one = s.select("doc_id", "t", T.citation_edge_id(F.col("doc_id"), F.col("t")).alias("edge_id")).dropDuplicates(["edge_id"])
    return one.select("edge_id", "doc_id", F.substring("t", 1, 1200).alias("cited_text"), T.parsed_reference(F.col("t")).alias("p")).select("edge_id", "doc_id", "cited_text", "p.*")


def keyword_counts(docs: DataFrame, n: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, n, rank): most frequent words of three letters or more and CJK runs; ties to the first seen."""
    low = F.lower(T.text_or_empty(F.col(text)))
    words = F.concat(F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9\-]{2,})"), F.lit(1)), F.regexp_extract_all(low, F.lit("([一-鿿]{2,6})"), F.lit(1)))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words).alias("i", "term"))
    counts = each.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "i"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).drop("i")


def repeated_edge_lines(chunks: DataFrame, least: int = 3, text: str = "text") -> DataFrame:
    """(line, n): first and last lines seen `least` times or more over all chunks; a one-line chunk counts twice."""
    e = chunks.select(T.edge_lines(F.col(text)).alias("e")).select(F.explode(F.array("e.first", "e.last")).alias("line"))
    return e.where(T.meaningful_line(F.col("line"))).groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, least))


def quality_flags(chunks: DataFrame, least: int = 3) -> DataFrame:
    """Chunks (chunk_uid, text, section_paths, table_ids, block_types) with `flags` and `passes`.

    The repeated lines and split tables are aggregated over the corpus and joined back by line and table.
    """
    edges = chunks.select("chunk_uid", T.edge_lines(F.col("text")).alias("e")).select("chunk_uid", F.explode(F.array("e.first", "e.last")).alias("line"))
    repeated = edges.join(repeated_edge_lines(chunks, least), "line").select("chunk_uid").distinct().withColumn("repeats", F.lit(True))
    tables = chunks.select("chunk_uid", F.explode("table_ids").alias("table_id")).distinct()
    split = tables.join(tables.groupBy("table_id").agg(F.count("*").alias("n")).where("n > 1"), "table_id").select("chunk_uid").distinct().withColumn("splits", F.lit(True))
    short = F.length(T.squeeze(F.col("text"))) < 120
    sections = F.size(F.array_distinct(F.filter("section_paths", lambda x: x != "")))
    marks = [
        ("header_footer_repetition", F.coalesce("repeats", F.lit(False))), ("cross_section_chunk", sections > 1), ("table_split_risk", F.coalesce("splits", F.lit(False))),
        ("equation_without_context", F.array_contains("block_types", "equation") & short),
        ("media_without_context", (F.array_contains("block_types", "image") | F.array_contains("block_types", "table")) & short),
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in marks]))
    return chunks.join(repeated, "chunk_uid", "left").join(split, "chunk_uid", "left").withColumn("flags", flags).withColumn("passes", F.size("flags") == 0).drop("repeats", "splits")


def quality_report(flagged: DataFrame) -> DataFrame:
    """One row: total, failed, failed_rate, and the histogram of flags."""
    one = flagged.agg(F.count("*").alias("total"), F.count_if(~F.col("passes")).alias("failed"))
    counts = flagged.select(F.explode("flags").alias("flag")).groupBy("flag").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "count")))).alias("flag_counts"))
    return one.crossJoin(counts).withColumn("failed_rate", F.col("failed") / F.greatest(F.col("total"), F.lit(1)))


def reference_purity(chunks: DataFrame, examples: int = 8, word: str = T._WORD) -> DataFrame:
    """One row: total, suspicious, rate and a few examples of reference chunks that don't look like references."""
    c, path = F.col("text"), F.col("section_path")
    odd = T.reference_features(chunks, "text", word).withColumn("odd", ~(F.col("ref.opens") | (T.is_reference_section(path) & F.col("ref.chunk"))))
    shown = odd.where("odd").orderBy("chunk_uid").limit(examples).agg(F.collect_list(F.struct("chunk_uid", F.substring(T.squeeze(c), 1, 180).alias("preview"))).alias("examples"))
    return odd.agg(F.count("*").alias("total"), F.count_if("odd").alias("suspicious"), F.coalesce(F.avg(F.col("odd").cast("int")), F.lit(0.0)).alias("rate")).crossJoin(shown)


def first_value(value: Column, order: Column) -> Column:
    """The first non-blank value in order, as an aggregate."""
    return F.min_by(F.when(F.trim(value) != "", value), F.when(F.trim(value) != "", order))


def papers(blocks: DataFrame, sections: DataFrame, citations: DataFrame, abstracts: DataFrame, limit: int = 2400) -> DataFrame:
    """(doc_id, title, year, authors, venue, pages, sections, n_citations, abstract, summary), from a full join by doc_id."""
    meta = blocks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(
        *[first_value(F.col(k), F.col("ord")).alias(k) for k in ("title", "year", "authors", "venue")], F.max("page").alias("pages")
    )
    secs = sections.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page", "section", "summary"))).alias("s"))
    cites = citations.where(~F.lower("title").rlike("https?://|doi") & (F.length("title") >= 12)).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("title")), 1, 10).alias("c"))
    counts = citations.groupBy("doc_id").agg(F.count("*").alias("n_citations"))
    joined = meta.join(secs, "doc_id", "full_outer").join(cites, "doc_id", "full_outer").join(counts, "doc_id", "full_outer").join(abstracts.select(F.col("doc_id").cast("string").alias("doc_id"), "abstract"), "doc_id", "left")
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    parts = F.concat_ws(
        " ", *[line(k, F.col(k.lower())) for k in ("Title", "Year", "Authors", "Venue")], line("Abstract", F.col("abstract")),
        F.array_join(F.transform(F.slice(F.coalesce("s", F.array().cast("array<struct<page:bigint,section:string,summary:string>>")), 1, 8), lambda x: F.concat_ws(": ", x["section"], x["summary"])), " "),
        line("Cites", F.array_join("c", "; ")),
    )
    return joined.select("doc_id", "title", "year", "authors", "venue", "pages", F.transform("s", lambda x: x["section"]).alias("sections"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"), "abstract", T.truncate(parts, limit).alias("summary"))


def first_texts(rows: DataFrame, key: str, order: str = "doc_id") -> DataFrame:
    """(key, text) of the row with the smallest `order` of each key; without one the text is null.  The smallest is found
    first, so that texts are read where they are and not sorted or shuffled."""
    firsts = settled(rows.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first")))
    mine = rows.select(key, order, "text").join(side(firsts), F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) == F.col("__first")))
    found = mine.groupBy("__key").agg(F.any_value("text").alias("text")).withColumnRenamed("__key", "__k")
    return firsts.join(found, F.col("__key").eqNullSafe(F.col("__k")), "left").select(F.col("__key").alias(key), "text")


def expand_to_parents(ranked: DataFrame, parents: DataFrame, n: int = 3, chars: int = 2200) -> DataFrame:
    """(query_id, parent_id, rank, text): the parents of ranked chunks, first chunk each, n per question, cut to `chars`."""
    joined = ranked.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    first = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    kept = joined.withColumn("__n", first).where("__n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    t = F.col("parent_text")
    text = F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("\n...[truncated]"))).otherwise(t)
    return kept.select("query_id", "parent_id", place.alias("rank"), text.alias("text")).where(F.col("rank") <= n)
