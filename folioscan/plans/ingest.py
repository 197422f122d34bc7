"""From layout items to the ten tables that questions are answered from, and their upkeep.

blocks, chunks (of the main text), parents, references (chunks of reference sections), chunk_rows (all chunks with their
quality), papers (with summaries), catalog (papers without them), sections, citations, reference_keywords; and a report
of the set's quality of one row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import vocabulary as V
from folioscan.operators import assets, chunks, folds, incremental
from folioscan.operators.settle import settled
from folioscan.sources.feed import Writer
from folioscan.sources.journal import Journal, Remote
from folioscan.sources.tables import Snapshots

KEYED = ("blocks", "chunks", "parents", "references", "chunk_rows", "papers", "catalog", "sections", "citations", "reference_keywords")
#: Tables that an outside index is told of, with the keys of their rows.
OUTSIDE = {"chunks": "chunk_uid", "papers": "doc_id", "references": "chunk_uid"}


@dataclass(frozen=True)
class IngestSettings:
    """Defaults of the pipeline; all of them are part of a signature."""

    chunk_size: int = chunks.SIZE
    chunk_overlap: int = chunks.OVERLAP
    chunk_strategy: str = "semantic_paper"
    hard_max_chars: int = chunks.HARD_MAX
    tokenizer: str | None = None  # a JSON file that every executor can open; sizes are characters without one
    structure_split: bool = True
    min_block_chars: int = chunks.LEAST_BLOCK
    header_footer_min_freq: int = 3
    paper_summary_chars: int = 2400
    section_summary_chars: int = 700
    schema_version: int = 1


def signature(files: DataFrame, settings: IngestSettings) -> str:
    """A digest of the settings and of the files' (path, length, modificationTime), from which a repeated ingest is known.

    The files' rows are hashed where they are and combined by sums, whatever their number and order.
    """
    columns = [c for c in ("path", "length", "modificationTime") if c in files.columns]
    one = files.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(json.dumps([asdict(settings), one["n"], str(one["a"]), str(one["b"])], sort_keys=True).encode()).hexdigest()


def chunk_rows(flagged: DataFrame) -> DataFrame:
    """Chunks as rows with every field of a structured export; missing fields are blank."""
    has = set(flagged.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    items = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in has else F.array().cast("array<string>")
    paths = F.when(F.size(items("section_paths")) > 0, items("section_paths")).when(F.trim(text("section_path")) != "", F.array(F.trim(text("section_path")))).otherwise(F.array().cast("array<string>"))
    flags = items("flags")
    uid = F.coalesce(*[F.when(text(c) != "", text(c)) for c in ("chunk_uid", "chunk_id", "parent_id")], F.lit(""))
    return flagged.select(
        uid.alias("chunk_uid"), (F.col("chunk_id") if "chunk_id" in has else F.lit(None).cast("long")).alias("chunk_id"), *[text(c).alias(c) for c in ("doc_id", "source", "title", "section_path")], paths.alias("section_paths"),
        "page", (F.coalesce("page_end", "page") if "page_end" in has else F.col("page")).alias("page_end"), text("page_range").alias("page_range"), items("block_types").alias("block_types"), items("figure_ids").alias("figure_ids"),
        items("table_ids").alias("table_ids"), text("year").alias("year"), text("authors").alias("authors"), T.truthy(text("is_reference")).alias("is_reference"), text("parent_id").alias("parent_id"), items("block_ids").alias("block_ids"),
        flags.alias("quality_flags"), (F.size(flags) == 0).alias("quality_pass"), text("text").alias("text"),
    )


def pages_of(blocks: DataFrame) -> DataFrame:
    """One row: the distinct pages (source and page above 0) of the blocks."""
    page = F.col("page").try_cast("int") if dict(blocks.dtypes)["page"] == "string" else F.col("page").cast("int")
    return blocks.select(F.trim(T.text_or_empty(F.col("source"))).alias("source"), page.alias("page")).where("source <> '' AND page > 0").distinct().agg(F.count("*").alias("pages"))


def split_references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main text, references) by the flag is_reference, which may be a text."""
    flag = F.coalesce(T.truthy(F.col("is_reference").cast("string")), F.lit(False))
    return rows.where(~flag), rows.where(flag)


def build(items: DataFrame, settings: IngestSettings | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """The ten tables from layout items (doc_id, ord, page_idx, type, text, bbox, ids, and papers' source, title, ...).

    `keep` may write what several tables are made of, and return what it reads back.
    """
    s = settings or IngestSettings()
    blocks = folds.annotate_blocks(items)
    for c in ("source", "title", "year", "authors", "venue"):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.col("doc_id").cast("string") if c == "source" else F.lit(""))
    for c in ("figure_ids", "table_ids"):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.array().cast("array<string>"))
    blocks = keep("blocks", blocks)
    packed = keep("packed", folds.packed_documents(blocks))
    # document numbers: by doc_id, then group, over ranges of ids
    counts = packed.groupBy("doc_id").agg(F.count("*").alias("n"))
    order = _numbered(counts)
    numbered = packed.join(order, "doc_id").withColumn("doc_idx", F.col("first") + F.col("grp")).drop("first", "grp")
    cut, parents = chunks.chunks_with_parents(numbered, s.chunk_strategy, s.structure_split, s.min_block_chars, s.chunk_size, s.chunk_overlap, s.hard_max_chars, s.tokenizer)
    cut = keep("cut", cut)
    flagged = keep("flagged", assets.quality_flags(cut, s.header_footer_min_freq))
    main, references = split_references(flagged)
    main_parents, _ = split_references(parents)
    if main.isEmpty():  # documents of references alone are asked as main text
        main, references, main_parents = flagged, flagged.limit(0), parents
    sections, citations, papers = derived(blocks, main_parents, references, s, keep)
    return {
        "blocks": blocks, "chunks": main, "parents": main_parents, "references": references, "chunk_rows": chunk_rows(flagged), "papers": papers, "catalog": papers.drop("summary"), "sections": sections, "citations": citations,
        "reference_keywords": assets.keyword_counts(references, doc_id="chunk_uid").withColumnRenamed("doc_id", "chunk_uid").join(references.select("chunk_uid", "doc_id"), "chunk_uid"),
    }


def derived(blocks: DataFrame, parents: DataFrame, references: DataFrame, s: IngestSettings, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, citations, papers) from the tables that they are made of."""
    sections = keep("sections", assets.section_summaries(parents.withColumn("ord", F.col("doc_idx")), s.section_summary_chars))
    citations = keep("citations", assets.citation_edges(references))
    return sections, citations, keep("papers", assets.papers(blocks, sections, citations, folds.abstract(blocks, sections=sections), s.paper_summary_chars))


def upgrade(snapshots: Snapshots, settings: IngestSettings | None = None) -> bool:
    """Give a set from before papers, sections and catalog these tables; whether it was done.

    They are made of the set's blocks, parents and references, and committed beside the tables that the set has, which stay
    where they are.  A set that has them, or lacks blocks or parents, is left alone.
    """
    number, m = snapshots.current()
    now = snapshots.load()
    filled = lambda k: k in now and m["tables"][k] > 0
    if m is None or all(map(filled, ("papers", "sections", "catalog"))) or not all(map(filled, ("blocks", "parents"))):
        return False
    references = now["references"] if "references" in now else now["chunks"].limit(0)
    sections, citations, papers = (settled(x) for x in derived(now["blocks"], now["parents"], references, settings or IngestSettings()))
    made = {"papers": papers, "catalog": papers.drop("summary"), "sections": sections, "citations": citations}
    facts = {k: v for k, v in m.items() if k not in ("snapshot", "tables", "schemas", "at")}
    snapshots.commit(made, keep=[k for k in m["tables"] if k not in made], base=number, **facts)
    return True


def quality(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: chunks, those with a flag and their share, references and suspicious ones, over a whole set of tables."""
    purity = assets.reference_purity(tables["references"]).select(F.col("total").alias("references"), F.col("suspicious").alias("suspicious_references"))
    return assets.quality_report(tables["chunk_rows"].withColumnsRenamed({"quality_flags": "flags", "quality_pass": "passes"})).select("total", "failed", "failed_rate").crossJoin(purity)


def _numbered(counts: DataFrame) -> DataFrame:
    """(doc_id, first): how many packed documents stand before each doc_id in the order of ids.

    Sorted ranges of ids are counted, and a range's documents are numbered within it: no task sees more than a range and
    the table of ranges.
    """
    # two branches read the ranges, whose bounds would be sampled anew for each
    sorted_ = settled(counts.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("range", F.spark_partition_id()))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sorted_.groupBy("range").agg(F.sum("n").alias("t"))
    before = totals.select("range", F.coalesce(F.sum("t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return sorted_.withColumn("within", within).join(before, "range").select("doc_id", (F.col("before") + F.col("within")).cast("long").alias("first"))


def ingest(items: DataFrame, snapshots: Snapshots, settings: IngestSettings | None = None, files: DataFrame | None = None, force: bool = False, remote: Remote | None = None, writer: Writer | None = None) -> dict:
    """Bring new documents (all of them with `force`) into the tables; facts of what was done.

    An ingest with the signature of the current set, whose tables are as its manifest says, is skipped.  Documents that any
    of the tables has stay as they are; only the items of the others are parsed.  The outside index is written before the
    tables become current, under a journal.
    """
    s = settings or IngestSettings()
    journal = Journal(snapshots)
    journal.recover(remote, writer)
    mark = signature(files, s) if files is not None else None
    current = snapshots.manifest()
    if not force and mark and current and current.get("signature") == mark and not snapshots.validate():
        return {"skipped": True, "chunks": current["tables"].get("chunks", 0), "pages": current.get("pages", 0)}
    now = snapshots.load()
    known = incremental.ids(*[now[k] for k in KEYED if k in now]) if now else None
    arriving = incremental.ids(items)
    active = settled(arriving if force or known is None else arriving.join(known, "doc_id", "left_anti"))
    if active.isEmpty():
        return {"skipped": True, "chunks": 0, "pages": 0}
    work = uuid.uuid4().hex

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{snapshots.folder}/{work}/{name}")
        return snapshots.spark.read.parquet(f"{snapshots.folder}/{work}/{name}")

    staged = build(incremental.keep_ids(items, active), s, keep)
    # what is new is unknown to all tables; what is forced takes the place of what is there
    merged = incremental.upsert({k: now[k] for k in KEYED if k in now}, staged, force=True) if now else dict(staged)
    merged["quality"] = quality(merged)
    pages = pages_of(merged["blocks"]).first()["pages"]
    names = [r["doc_id"] for r in active.toLocalIterator()] if remote else []  # a callback's list; a writer needs none
    journal.execute("upsert", merged, names, remote, writer, OUTSIDE, signature=mark, pages=pages)
    snapshots.files.delete(work)
    return {"skipped": False, "documents": active.count(), "chunks": snapshots.manifest()["tables"]["chunks"], "pages": pages}


def remove(snapshots: Snapshots, ids: list[str], remote: Remote | None = None, writer: Writer | None = None) -> dict:
    """Delete documents; which ids were known, which not, and by how many rows each table shrank."""
    journal = Journal(snapshots)
    journal.recover(remote, writer)
    now = snapshots.load()
    asked = snapshots.spark.createDataFrame([(str(i),) for i in ids], "doc_id string")
    kept, known = incremental.delete({k: now[k] for k in KEYED if k in now}, asked)
    before = snapshots.manifest()["tables"]
    found = sorted(r["doc_id"] for r in known.collect())
    if found:
        facts = {"pages": pages_of(kept["blocks"]).first()["pages"]}  # no signature: what was removed is read again
        journal.execute("delete", kept | {"quality": quality(kept)}, found, remote, writer, OUTSIDE, **facts)
    after = snapshots.manifest()["tables"]
    return {"deleted": found, "missing": sorted({str(i) for i in ids} - set(found)), "rows": {k: before[k] - after[k] for k in before}}


# ---------------------------------------------------------------- readiness

def readiness(present: dict[str, DataFrame], scope: str = "main") -> tuple[str, ...]:
    """Why a set of tables can't answer questions of a scope; each test reads one row."""
    needed = {"references": V.NOT_READY["references"]} if scope == "references" else {k: v for k, v in V.NOT_READY.items() if k != "references"}
    return tuple(reason for table, reason in needed.items() if table not in present or present[table].isEmpty())


def readiness_message(reasons: tuple[str, ...], scope: str = "main") -> str:
    """What a user is told; blank where nothing is missing."""
    if not reasons:
        return ""
    details = "；".join(V.NOT_READY_TEXTS.get(r, r) for r in reasons)
    return V.NOT_READY_FRAME.format(scope=V.SCOPE_TEXTS["references" if scope == "references" else "main"], details=details)


def consistency(snapshots: Snapshots, remote_counts: dict[str, int | None] | None = None, rebuild: Remote | None = None) -> dict:
    """Whether tables and outside indexes (name of the table: rows there, None if it is missing) agree, after a repair if
    `rebuild` is given."""
    now = snapshots.load()
    reasons = list(snapshots.validate())

    def outside(counts: dict[str, int | None]) -> list[str]:
        rows = (snapshots.manifest() or {"tables": {}})["tables"]
        return [f"{'missing' if n is None else 'empty'}_remote_collection:{k}" for k, n in counts.items() if rows.get(k, 0) > 0 and not n]

    bad = outside(remote_counts or {})
    reasons += bad
    repaired = bool(bad and rebuild and now.get("chunks") is not None)
    if repaired:
        rebuild("upsert", now, [])
        reasons.append("rebuilt_remote_indexes")
    return {"ok": not snapshots.validate() and (not bad or repaired), "repaired": repaired, "reasons": tuple(dict.fromkeys(reasons))}


def cache_hit_state(snapshots: Snapshots, expected: dict[str, int]) -> tuple[str, ...]:
    """Mismatches of what a cache claims about the numbers of rows; 0 claims nothing."""
    rows = (snapshots.manifest() or {"tables": {}})["tables"]
    return tuple(f"{k}_count_mismatch" for k, n in expected.items() if n and rows.get(k, 0) != n)
