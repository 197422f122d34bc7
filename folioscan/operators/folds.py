"""Ordered folds over a document's blocks: state machines that stream over sorted rows, and folds of short arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as X
from pyspark.sql.pandas.types import to_arrow_type

from folioscan.functions import arrow as A
from folioscan.functions import text as T
from folioscan.functions import vocabulary as V

MAX_CHARS, MIN_CHARS, HARD = 1800, 450, 1.6
MEDIA = ("equation", "image", "table")


def scan(rows: DataFrame, order: Column | str, signals: dict[str, Column], step: Callable[[], Callable], out: str) -> DataFrame:
    """`rows` with one more column that a state machine finds for each in its order within its doc_id.

    Rows are dealt by doc_id and sorted, and stream through a task: a document of any number of rows costs its length, and
    only the signals of a batch are looked at in Python, beside whatever else a row carries.  `step()` starts a machine for
    a document; it is called with a row's signals.  What a row needs of the one before, or of its document, is a window.
    """
    named = rows.select("*", *[c.alias(f"__signal_{k}") for k, c in signals.items()], (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) == 1).alias("__first"))
    keep, count = rows.columns, len(signals)
    field, kind = out.split(" ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = step()
        for batch in batches:
            found = []
            for first, *values in zip(batch.column(batch.num_columns - 1).to_pylist(), *[batch.column(len(keep) + i).to_pylist() for i in range(count)], strict=True):
                if first:
                    machine = step()
                found.append(machine(*values))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, to_arrow_type(result))], names=[*keep, field])

    result = X._parse_datatype_string(kind)
    schema = X.StructType([*[X.StructField(f.name, f.dataType) for f in rows.schema], X.StructField(field, result)])
    return named.mapInArrow(run, schema)


def _packer(max_chars: int, min_chars: int) -> Callable[[int, bool, bool], int]:
    group, chars = -1, 0

    def step(n: int, cut: bool, soft: bool) -> int:
        nonlocal group, chars
        total = chars + n
        if group < 0 or cut or total > int(max_chars * HARD) or (soft and total > max_chars and chars >= min_chars):
            group, chars = group + 1, n
        else:
            chars = total
        return group

    return step


def pack_groups(blocks: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Blocks with `grp`, the number of the packed document they belong to within their doc_id; blank blocks go.

    A group ends where section or reference flag change or pages jump, above the hard limit, or above the soft one once
    the minimum is reached and neither neighbour is an equation, image or table.  Lengths are those of trimmed texts.
    """
    kept = blocks.where(F.trim(T.strip(F.col("text"))) != "")
    before = lambda c: F.lag(c).over(Window.partitionBy("doc_id").orderBy("ord"))
    media = F.lower(F.trim(F.col("block_type"))).isin(*MEDIA)
    same = before("section_path").eqNullSafe(F.col("section_path")) & before("is_reference").eqNullSafe(F.col("is_reference"))
    signals = {
        "n": F.length(T.strip(F.col("text"))),
        "cut": F.coalesce(~same | (F.abs(F.col("page") - before("page")) > 1), F.lit(False)),
        "soft": F.coalesce(~media & ~before(media), F.lit(False)),
    }
    return scan(kept, "ord", signals, lambda: _packer(max_chars, min_chars), "grp bigint")


def packed_documents(blocks: DataFrame, **limits: int) -> DataFrame:
    """Packed documents in reading order: text (blocks divided by a blank line), pages, types, sections, the reference flag
    and section of the first block and, where the blocks have them, figure and table ids, block ids, first and last block
    and boxes with their pages."""
    g = pack_groups(blocks, **limits)
    has = set(blocks.columns)
    rows = F.array_sort(F.collect_list(F.struct("ord", T.strip(F.col("text")).alias("t"))))
    distinct = lambda c: F.sort_array(F.collect_set(c))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    out = [
        F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("text"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.concat_ws("-", F.min("page"), F.max("page")).alias("page_range"),
        distinct("block_type").alias("block_types"), F.min_by("section_path", "ord").alias("section_path"),
        F.filter(distinct(F.trim("section_path")), lambda x: x != "").alias("section_paths"), F.min_by("is_reference", "ord").alias("is_reference"),
    ]
    for c in ("figure_ids", "table_ids"):
        if c in has:
            out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c))
    if "block_id" in has:
        out += [in_order("block_id").alias("block_ids"), F.min_by("block_id", "ord").alias("first_block"), F.max_by("block_id", "ord").alias("last_block")]
    if "bbox" in has:
        boxes = F.transform(F.array_sort(F.collect_list(F.when(F.size("bbox") > 0, F.struct("ord", "page", "bbox")))), lambda x: F.struct(x["page"].alias("page"), x["bbox"].alias("bbox")))
        out.append(boxes.alias("bboxes"))
    out += [F.min_by(c, "ord").alias(c) for c in ("source", "title", "year", "authors", "venue", "keywords", "language") if c in has]
    return g.groupBy("doc_id", "grp").agg(*out)


def structure_blocks(text: Column, min_chars: int = 300) -> Column:
    """Paragraphs as blocks: a heading begins one, list items and what follows a short block join it."""
    plain = F.trim(F.regexp_replace(T.text_or_empty(text), r"\r\n?", "\n"))
    paragraphs = F.filter(F.transform(F.split(plain, r"\n{2,}"), lambda x: F.trim(x)), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        line = F.trim(F.split(p, "\n")[0])
        item = T.is_list_item(line)
        joins = ~_block_heading(line) & (s["now"] != "") & ((F.length(s["now"]) < min_chars) | item)
        done = F.when(joins | (s["now"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(F.trim(s["now"]))))
        now = F.when(joins, F.concat(s["now"], F.when(item, "\n").otherwise("\n\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(paragraphs, state, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.trim(s["now"])))))


def _block_heading(line: Column) -> Column:
    low = F.lower(line)
    marked = low.rlike(r"^(?:chapter|section|appendix)(?![\p{L}\p{N}_])|^\d+(?:\.\d+){0,4}\s+|^[ivxlcdm]+[.)]\s+|^第[一二三四五六七八九十百0-9]+[章节部分]\s*")
    return marked | ((F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) <= 80))


def annotate_blocks(items: DataFrame, word: str = T._WORD) -> DataFrame:
    """Layout items (doc_id, ord, page_idx from 0, type, text and further columns) as blocks with page (from 1),
    section_path and is_reference.

    Text and discarded items may be headings, which keep a stack of up to six levels.  References begin at their heading
    and end at a heading of the same or a higher level, where the last reference is more than a page back, or at a paragraph
    like body text.  Within them entries and continuations are references, outside only continuations under a reference
    section.  Entries on the last quarter of the pages are references too.  A lone column `page` is taken for page_idx.
    """
    if "page_idx" not in items.columns:
        items = items.withColumnRenamed("page", "page_idx")
    own = [c for c in items.columns if c not in ("doc_id", "ord", "page_idx", "type", "text", "page", "block_type", "section_path", "is_reference", "block_id")]
    text = T.text_or_empty(F.col("text"))
    kind = F.lower(F.trim(T.text_or_empty(F.col("type"))))
    seen = items.withColumns({"text": text, "type": F.when(kind == "", "text").otherwise(kind), "page_idx": F.greatest(F.coalesce(F.col("page_idx").cast("long"), F.lit(0)), F.lit(0))})
    seen = T.reference_features(seen, "text", word)
    may_head = F.col("type").isin("text", "discarded") & (F.col("text") != "")
    seen = seen.withColumn("__level", F.when(may_head, T.heading_level(F.col("text")))).withColumn("__title", T.normal_reference_heading(F.col("text")))
    page = F.col("page_idx") + 1
    seen = seen.withColumn("__pages", F.max(page).over(Window.partitionBy("doc_id")))
    opens = F.col("__level").isNotNull() & F.col("ref.opens")
    signals = {
        "page": page, "some": F.col("text") != "", "level": F.col("__level"), "opens": opens, "cites": F.col("ref.entry") | F.col("ref.goes_on"), "goes_on": F.col("ref.goes_on"), "body": F.col("ref.body"),
        "title": F.when(F.col("__level").isNotNull(), F.col("__title")), "refers": T.is_reference_section(F.col("__title")),
    }
    folded = scan(seen, "ord", signals, _annotator, "found struct<section_path: string, is_reference: boolean>")
    late = page >= F.greatest(F.lit(1), F.floor(F.col("__pages") * 0.75))
    return folded.select(
        "doc_id", "ord", page.alias("page"), F.col("type").alias("block_type"), "text",
        "found.section_path", (F.col("found.is_reference") | (late & F.col("ref.entry"))).alias("is_reference"),
        F.format_string("%s::b%06d", F.col("doc_id").cast("string"), F.col("ord").cast("int")).alias("block_id"), *own,
    )


def _annotator() -> Callable[..., dict]:
    """The machine of annotate_blocks: titles of the open headings, whether references are open, since which level, and the
    page of the last reference."""
    stack: list[tuple[str, bool]] = []
    inside, since, last, path, under = False, 0, 0, T.BODY, False

    def step(page: int, some: bool, level: int | None, opens: bool, cites: bool, goes_on: bool, body: bool, title: str | None, refers: bool) -> dict:
        nonlocal inside, since, last, path, under
        gone = last > 0 and page > last + 1
        higher = level is not None and not opens and level <= since
        open_ = opens or (inside and not gone and not higher)
        if level is not None:
            del stack[min(level, 6) - 1 :]
            stack.append((title, refers))
            path, under = " > ".join(t for t, _ in stack), any(r for _, r in stack)
        is_reference = True if opens else cites if open_ and some else under and goes_on
        inside = open_ and (opens or not some or cites or not body)
        if opens:
            since = level
        if is_reference:
            last = page
        return {"section_path": path, "is_reference": is_reference}

    return step


def fit_texts(rows: Column, limit: int) -> Column:
    """Squeezed texts in order, joined by blanks until `limit` characters are reached, then truncated."""
    step = lambda s, x: F.when((F.length(s) >= limit) | (x == ""), s).when(s == "", x).otherwise(F.concat_ws(" ", s, x))
    return T.truncate(F.aggregate(F.transform(rows, T.squeeze), F.lit(""), step), limit)


def abstract(blocks: DataFrame, limit: int = 1200, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, abstract), as the rows of a document are read in order.

    An abstract begins in a section of that name, or at a text that has the word and enough after it; it goes on until a text
    that looks like the next part.  In such a section what follows the word comes first, then the text without its banners.
    Without any, the first section of that name counts (`sections` with doc_id, page, section, summary), else the lead: texts
    that are no references until 900 characters.  Running windows find all of it, and no more than `limit` characters and the
    text that passes them are gathered for a document.
    """
    whole = r"(?i)(?<![\p{L}\p{N}_])" + V.ABSTRACT_WORD + r"(?![\p{L}\p{N}_])" + V.ABSTRACT_AFTER
    named = lambda c: F.lower(c).rlike("|".join(V.ABSTRACT_MARKS)) | c.rlike(whole)
    after = lambda c: F.when(c.rlike(whole), T.without_front_matter(F.regexp_replace(c, r"(?s)^.*?" + whole, ""))).otherwise("")
    section = F.col("section_path") if "section_path" in blocks.columns else F.lit("")
    rows = blocks.select("doc_id", "ord", F.coalesce("is_reference", F.lit(False)).alias("ref"), A.clean(T.text_or_empty(F.col("text"))).alias("t"), A.clean(T.text_or_empty(section)).alias("s"))
    stop = F.lower("t").rlike("|".join(f"(?:{p})" for p in V.ABSTRACT_STOPS))
    rows = rows.select("doc_id", "ord", "ref", after(F.col("t")).alias("after"), T.without_front_matter(F.col("t")).alias("plain"), named(F.col("s")).alias("under"), F.col("t").rlike("^(?:" + whole + ")$").alias("heading"), stop.alias("stop"))
    big = ~F.col("under") & (F.length("after") >= V.ABSTRACT_LEAST)
    order = Window.partitionBy("doc_id").orderBy("ord")
    before, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"big": big, "inside": F.coalesce(F.max(F.col("under") | big).over(before), F.lit(False))})
    halts = F.col("stop") & F.when(F.col("under"), (F.col("after") == "") & ~F.col("heading")).otherwise(~F.col("big") & F.col("inside"))
    rows = rows.withColumn("done", F.max(halts).over(until))
    body = F.when((F.col("under") | F.col("big")) & (F.col("after") != ""), F.col("after")).when(F.col("under"), F.when(~F.col("heading"), F.col("plain"))).when(F.col("inside"), F.col("plain"))
    lead = F.when(~F.col("ref"), F.when(F.col("after") != "", F.col("after")).otherwise(F.col("plain")))
    rows = rows.select("doc_id", "ord", F.when(~F.col("done") & (body != ""), body).alias("body"), F.when(lead != "", lead).alias("lead"))
    sizes = {f"{c}_before": F.coalesce(F.sum(F.length(c) + 1).over(before), F.lit(0)) for c in ("body", "lead")}

    def joined(c: str, most: int) -> Column:
        some = F.collect_list(F.when(F.col(c).isNotNull() & (F.col(f"{c}_before") <= most), F.struct("ord", c)))
        return F.array_join(F.transform(F.array_sort(some), lambda x: x[c]), " ")

    found = rows.withColumns(sizes).groupBy("doc_id").agg(joined("body", limit + 1).alias("body"), joined("lead", 900).alias("lead"))
    chosen = F.when(F.col("body") != "", F.col("body")).otherwise(F.col("lead"))
    if sections is not None:
        own = sections.select("doc_id", F.struct("page", "section").alias("at"), A.clean(T.text_or_empty(F.col("section"))).alias("s"), A.clean(T.text_or_empty(F.col("summary"))).alias("t"))
        first = own.where(named(F.col("s"))).groupBy("doc_id").agg(F.min_by(after(F.col("t")), "at").alias("section"))
        found = found.join(first, "doc_id", "left")
        chosen = F.when(F.col("body") != "", F.col("body")).when(F.col("section").isNotNull(), F.col("section")).otherwise(F.col("lead"))
    return found.select("doc_id", T.truncate(chosen, limit).alias("abstract"))
