"""State machines over long documents: equal to plain loops, across Arrow batches, in time that grows with the length."""

import random
import time

from pyspark.sql import functions as F

from folioscan.operators import folds


def packed_by_hand(rows, most=folds.MAX_CHARS, least=folds.MIN_CHARS):
    out, group, chars, before = {}, -1, 0, None
    for doc, o, page, kind, section, ref, text in rows:
        n = len(text.strip())
        if not n:
            continue
        if before is None or before[0] != doc:
            group, chars, before = -1, 0, None
        media = lambda k: (k or "").strip().lower() in folds.MEDIA
        new = before is None
        if before is not None:
            _, _, p, k, s, r, _ = before
            jump = p is not None and page is not None and abs(page - p) > 1
            soft = chars + n > most and chars >= least and k is not None and kind is not None and not media(k) and not media(kind)
            new = s != section or r != ref or jump or chars + n > int(most * folds.HARD) or soft
        group, chars = (group + 1, n) if new else (group, chars + n)
        out[doc, o] = group
        before = (doc, o, page, kind, section, ref, text)
    return out


def blocks(seed, sizes):
    r = random.Random(seed)
    rows = []
    for d, size in enumerate(sizes):
        section, page, ref = "A", 1, False
        for o in range(size):
            section = r.choice(["A", "B", None]) if r.random() < 0.03 else section
            page += r.choice([0, 0, 0, 1, 2]) if r.random() < 0.2 else 0
            ref = (not ref) if r.random() < 0.02 else ref
            rows.append((f"d{d}", o, None if r.random() < 0.01 else page, r.choice(["text", "text", "table", " Image ", None]), section, ref, "x" * r.choice([0, 5, 200, 700, 3000]) + " " * r.randint(0, 2)))
    return rows


SCHEMA = "doc_id string, ord long, page int, block_type string, section_path string, is_reference boolean, text string"


def test_packing_equals_a_plain_loop(spark):
    rows = blocks(1, [0, 1, 40, 3000, 25])
    shuffled = random.Random(2).sample(rows, len(rows))
    got = {(r.doc_id, r.ord): r.grp for r in folds.pack_groups(spark.createDataFrame(shuffled, SCHEMA).repartition(5)).collect()}
    assert got == packed_by_hand(rows) and max(got.values()) > 20


def test_state_goes_on_over_arrow_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = blocks(3, [100, 60])
        got = {(r.doc_id, r.ord): r.grp for r in folds.pack_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == packed_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def seconds(spark, n):
    o = F.col("id")
    text = F.when(o % 50 == 3, F.concat(F.lit("1.2 Heading "), o.cast("string"))).otherwise(F.concat(F.lit("Body of a sentence, number "), o.cast("string"), F.lit(".")))
    items = spark.range(n).select(F.lit("d").alias("doc_id"), o.alias("ord"), F.floor(o / 40).cast("long").alias("page_idx"), F.lit("text").alias("type"), text.alias("text"))
    began = time.perf_counter()
    packed = folds.pack_groups(folds.annotate_blocks(items))
    found = packed.agg(F.count("*").alias("n"), F.max("grp").alias("g"), F.count_distinct("section_path").alias("s")).first()
    assert found.n == n and found.s == (n + 46) // 50 + 1 and found.g >= found.s - 1
    return time.perf_counter() - began


def test_a_long_document_takes_time_in_proportion(spark):
    seconds(spark, 2000)
    assert seconds(spark, 100_000) < 12 * max(seconds(spark, 20_000), 1.0)


def found_abstract(spark, rows, sections=None):
    """rows: (section, text) or (section, text, is_reference)."""
    blocks = spark.createDataFrame([("d", i, r[0], r[1], len(r) > 2 and r[2]) for i, r in enumerate(rows)], "doc_id string, ord long, section_path string, text string, is_reference boolean")
    own = None if sections is None else spark.createDataFrame([("d", p, s, t) for p, s, t in sections], "doc_id string, page int, section string, summary string")
    return folds.abstract(blocks.repartition(3), sections=own).first().abstract


LONG = "Rivers carry sediment to the coast, where deltas grow or shrink with the balance of supply, tides and waves, and with what people take out of them."


def test_abstract_in_its_section(spark):
    rows = [("Front", "A Study of Deltas"), ("Abstract", "Abstract"), ("Abstract", LONG), ("Abstract", "We measure forty of them."), ("Abstract", "1 Introduction"), ("Abstract", "Not this.")]
    assert found_abstract(spark, rows) == f"{LONG.removesuffix('.')} We measure forty of them"
    assert found_abstract(spark, [("Abstract", f"A B S T R A C T: {LONG}"), ("1 Introduction", "Keywords: delta"), ("1 Introduction", "No.")]) == LONG.removesuffix(".")


def test_abstract_behind_the_word_in_a_text(spark):
    rows = [("Front", f"Volume 3. Abstract. {LONG}"), ("Front", "More of it & more."), ("Front", "See https://example.org"), ("Front", "No.")]
    assert found_abstract(spark, rows) == f"{LONG.removesuffix('.')} More of it & more"
    # too short to begin one: the lead, where what follows the word comes first
    assert found_abstract(spark, [("Front", "Abstract: brief"), ("Front", "Other text")]) == "brief Other text"


def test_lead_when_nothing_is_called_abstract(spark):
    rows = [("Body", "[1] A reference.", True), ("Body", "First. "), ("Body", None), ("Body", "x" * 890), ("Body", "y" * 400), ("Body", "never")]
    got = found_abstract(spark, rows)
    assert got.startswith("First " + "x" * 890 + " yyy") and got.endswith("...") and len(got) == 1200 and "never" not in got
    assert found_abstract(spark, [("Body", None)]) == "" and found_abstract(spark, [("Body", "ref", True)]) == ""


def test_sections_before_the_lead(spark):
    rows = [("Body", "Lead text")]
    assert found_abstract(spark, rows, [(2, "Abstract of all", "Abstract: later"), (1, "Abstract", "Abstract: earlier")]) == "earlier"
    assert found_abstract(spark, rows, [(1, "Methods", "Abstract: no")]) == "Lead text"


def test_no_more_than_needed_is_gathered(spark):
    rows = [("Abstract", "z" * 100)] * 200
    got = found_abstract(spark, rows)
    assert len(got) == 1200 and got.endswith("...") and set(got) == {"z", " ", "."}
