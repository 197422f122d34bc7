"""Licence scans by canonical digest lookup, in DataFrame functions alone.

A text's canonical form is lower case, without copyright lines, with every run of other characters than letters and
digits as one blank, and with equivalent spellings as one.  Its SHA-256 joins it to the digests of known licences.
Whole documents are looked up, and so is each of their lines that names a licence or copyright, as an entire text of
its own.  The known texts are given by the driver's program (a fixed list of a few), so their digests are broadcast.

Cases: a null or empty text has an empty canonical form, no words and no licence; the digest of an empty form matches
nothing; equal texts get equal results; a licence known by several texts is named once; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.licence_texts import SPELLINGS, TEXTS

COPYRIGHT = r"(?m)^[ \t]*(?:portions )?(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)|©)[^\n]*$"
RIGHTS = r"(?m)^[ \t]*all rights reserved\.?[ \t\r]*$"
OTHER = r"[^\p{L}\p{N}]+"
ASKS = r"licen[cs]e|copyright"
_VARIANT = r"(?:^| )(?:" + "|".join(a for a, _ in SPELLINGS) + r")(?: |$)"


def canonical(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.contains("copyright") | low.contains("(c)") | low.contains("©") | low.contains("all rights"), F.regexp_replace(F.regexp_replace(low, COPYRIGHT, " "), RIGHTS, " ")).otherwise(low)
    plain = F.trim(F.regexp_replace(low, OTHER, " "))
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    respelled = F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(spelled[w], w)), " ")
    return F.when(plain.rlike(_VARIANT), respelled).otherwise(plain)


def known_digests(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """(known_sha256, licence_id) of licence texts, one row for each digest."""
    given = spark.createDataFrame(list(texts), "licence_id string, text string")
    form = canonical(F.col("text"))
    return given.where(form != "").groupBy(F.sha2(form, 256).alias("known_sha256")).agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """doc_id, n_words and canonical_sha256 of the canonical form, licence_id of the whole text, and notices: the sorted
    licences that single lines give."""
    known = known_digests(docs.sparkSession, texts)
    pairs = [F.lit(x) for r in known.collect() for x in (r["known_sha256"], r["licence_id"])]
    by_digest = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    rows = docs.select("doc_id", "text", canonical(F.col("text")).alias("form"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(x).rlike(ASKS))
    notices = F.filter(F.transform(lines, lambda x: by_digest[F.sha2(canonical(x), 256)]), lambda x: x.isNotNull())
    return (
        rows.select(
            "doc_id",
            F.when(F.col("form") == "", 0).otherwise(F.size(F.split("form", " "))).cast("long").alias("n_words"),
            F.sha2("form", 256).alias("canonical_sha256"),
            F.array_sort(F.array_distinct(notices)).alias("notices"),
        )
        .join(F.broadcast(known), F.col("canonical_sha256") == F.col("known_sha256"), "left")
        .select("doc_id", "n_words", "canonical_sha256", "licence_id", "notices")
    )
