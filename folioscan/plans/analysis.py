"""Analysis of questions as columns over a `queries` table: routes, variants, constraints."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import vocabulary as V
from folioscan.operators.matching import containing
from folioscan.operators.settle import settled, side


@dataclass(frozen=True)
class Settings:
    """Retrieval defaults."""

    mode: str = "hybrid"
    retriever_k: int = 8
    final_k: int = 5
    dense_k: int = 20
    bm25_k: int = 20
    rrf_k: int = 60
    variants: int = 3


def _has(low: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(m) for m in markers], F.lit(False))


def model_terms(c: Column) -> Column:
    """Model-like words of three characters or more, as written."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"({V.MODEL_LIKE})"), F.lit(1)), lambda x: F.length(x) >= 3)


def route_type(question: Column, scope: Column | None = None) -> Column:
    """The first route that fits: explicit scope, references, metadata, survey, comparison, factual."""
    low = F.lower(F.trim(T.text_or_empty(question)))
    hint = _has(low, V.COMPARISON_MARKERS)
    compares = hint & (question.rlike(V.CONNECTOR) | (F.size(F.array_distinct(F.transform(model_terms(question), F.lower))) >= 2))
    explicit = F.lit(False) if scope is None else F.lower(F.trim(T.text_or_empty(scope))).isin(*V.REFERENCE_SCOPES)
    return (
        F.when(explicit | _has(low, V.REFERENCE_MARKERS), "references").when(_has(low, V.METADATA_MARKERS), "metadata").when(_has(low, V.SURVEY_MARKERS), "survey").when(compares, "comparison").otherwise("factual")
    )


def budgets(s: Settings) -> dict[str, tuple]:
    """By route: mode, paper_k, chunk_k, final_k, use_parents, prefers_papers."""
    r, f = s.retriever_k, s.final_k
    return {
        "references": ("bm25", 0, max(r, 12), f, False, False),
        "metadata": ("bm25", max(6, f + 2), max(r, 16), max(f, 5), False, True),
        "survey": ("hybrid", max(8, f + 4), max(r, 36), max(f, 6), False, True),
        "comparison": ("hybrid", max(8, f + 3), max(r, 40), max(f, 6), True, False),
        "factual": (s.mode, max(6, f + 2), r, f, True, False),
    }


def route(queries: DataFrame, settings: Settings | None = None, scope: str | None = None) -> DataFrame:
    """Questions with their plan: route, mode, paper_k, chunk_k, final_k, use_parents, prefers_papers."""
    b = budgets(settings or Settings())
    out = queries.withColumn("route", route_type(F.col("text"), None if scope is None else F.lit(scope)))
    for i, name in enumerate(("mode", "paper_k", "chunk_k", "final_k", "use_parents", "prefers_papers")):
        out = out.withColumn(name, reduce(lambda c, kv: c.when(F.col("route") == kv[0], F.lit(kv[1][i])), list(b.items())[1:], F.when(F.col("route") == "references", F.lit(b["references"][i]))))  # noqa: B023
    return out


# ---------------------------------------------------------------- variants

def _mapped(low: Column, table: dict[str, str]) -> Column:
    """Terms of each entry whose key the text contains, in the table's order."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(low.contains(k.lower()), F.split(F.lit(v), " ")).otherwise(none) for k, v in table.items()])


def keywords(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"({V.KEYWORD_TOKEN})"), F.lit(1))
    return T.distinct_terms(F.filter(found, lambda x: ~F.lower(x).isin(*V.STOPWORDS) & ~x.isin(*V.FILLERS)))


def acronym_terms(low: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = []
    for short, full in V.ACRONYMS.items():
        parts.append(F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){short}(?![\p{{L}}\p{{N}}_])"), F.split(F.lit(full), " ")).otherwise(none))
        parts.append(F.when(low.contains(full), F.array(F.lit(short.upper()))).otherwise(none))
    return T.distinct_terms(F.concat(*parts))


def intent_terms(low: Column) -> Column:
    none = F.array().cast("array<string>")
    return T.distinct_terms(F.concat(*[F.when(_has(low, triggers), F.split(F.lit(terms), " ")).otherwise(none) for triggers, terms in V.INTENTS]))


def title_hints(c: Column) -> Column:
    low = F.lower(T.text_or_empty(c))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in V.TITLE_HINTS.items()])))


def stripped(c: Column) -> Column:
    return T.squeeze(reduce(lambda x, p: F.regexp_replace(x, p, ""), V.BOILERPLATE, T.squeeze(c)))


def variants(queries: DataFrame, most: int = 3) -> DataFrame:
    """`queries` with `variants`, up to `most` distinct spellings of `text`: as it is, without boilerplate, with aliases,
    keywords, terms of the other language, academic terms.

    Each step is a projection of its own, so that no expression is copied into several others.
    """
    none = F.array().cast("array<string>")
    core, low = F.col("__core"), F.col("__low")
    with_terms = lambda c: F.when(F.size(c) > 0, F.concat_ws(" ", core, F.array_join(c, " "))).otherwise("")
    out = queries.withColumn("__plain", T.squeeze(F.col("text"))).withColumn("__bare", stripped(F.col("text")))
    out = out.withColumn("__core", F.when(F.col("__bare") != "", F.col("__bare")).otherwise(F.col("__plain"))).withColumn("__low", F.lower("__core"))
    out = out.withColumns({
        "__alias": T.distinct_terms(_mapped(low, V.ALIASES)), "__words": keywords(core), "__intent": intent_terms(low), "__short": acronym_terms(low),
        "__zh": F.when(core.rlike("[一-鿿]"), T.distinct_terms(_mapped(low, V.ZH_TO_EN))).otherwise(none), "__en": F.when(core.rlike("[A-Za-z]"), T.distinct_terms(_mapped(low, V.EN_TO_ZH))).otherwise(none),
    })
    out = out.withColumns({"__other": T.distinct_terms(F.concat("__zh", "__en")), "__all": T.distinct_terms(F.concat("__words", "__intent", "__short", "__alias"))})
    each = F.array("__plain", "__bare", with_terms(F.col("__alias")), F.array_join("__words", " "), with_terms(F.col("__other")), F.array_join("__all", " "))
    made = out.withColumn("__each", each).withColumn("variants", F.slice(T.distinct_terms(F.col("__each")), 1, max(1, most)))
    return made.select(*queries.columns, "variants")


# ---------------------------------------------------------------- constraints

_Y = r"((?:19|20)\d{2})"
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Patterns in the order in which they take text away, with the first and last year as (group or None, offset).
_RANGES = (
    (rf"(?i){_B}{_Y}\s*(?:-|–|—|~|至|到|to)\s*{_Y}{_E}", (1, 0), (2, 0)),
    (rf"(?i){_B}between\s+{_Y}\s+and\s+{_Y}{_E}", (1, 0), (2, 0)),
    (rf"(?i){_B}after\s+{_Y}{_E}", (1, 1), "now"),
    (rf"(?i){_B}{_Y}\s*(?:之后|以后){_E}", (1, 1), "now"),
    (rf"(?i){_B}(?:since|from)\s+{_Y}{_E}", (1, 0), "now"),
    (rf"(?i){_B}{_Y}\s*(?:以来|起){_E}", (1, 0), "now"),
    (rf"(?i){_B}before\s+{_Y}{_E}", "first", (1, -1)),
    (rf"(?i){_B}{_Y}\s*(?:之前|以前){_E}", "first", (1, -1)),
)
_RECENT = r"(?i)(?:近|最近)\s*([0-9一二两三四五六七八九十]{1,3})\s*年|(?:last|past)\s+(\d{1,2})\s+years?"


def small_number(c: Column) -> Column:
    """Digits or a Chinese numeral below 100; null otherwise."""
    digit = F.create_map(*[F.lit(x) for kv in V.NUMERALS.items() for x in kv])
    ten = F.instr(c, "十")
    tens = F.when(ten == 1, F.lit(1)).otherwise(digit[F.substring(c, 1, 1)])
    ones = F.when(F.length(c) > ten, digit[F.substring(c, -1, 1)]).otherwise(0)
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when(F.length(c) == 1, digit[c]).when((ten > 0) & (F.length(c) <= 3), tens * 10 + ones)


def years(c: Column, current_year: int) -> Column:
    """The sorted years (as text) that a question allows; ranges are taken out before single years are read.

    A range whose bounds are the wrong way round is turned, also after a year at or past the present one.
    """
    span = lambda a, b: F.when(
        F.greatest(F.least(a, b), F.lit(V.YEAR_MIN)) <= F.least(F.greatest(a, b), F.lit(V.YEAR_MAX)),
        F.sequence(F.greatest(F.least(a, b), F.lit(V.YEAR_MIN)), F.least(F.greatest(a, b), F.lit(V.YEAR_MAX))),
    ).otherwise(F.array().cast("array<int>"))
    rest = F.concat(F.lit(" "), F.trim(T.text_or_empty(c)), F.lit(" "))
    def bound(m: Column, pattern: str, what) -> Column:
        if what == "now":
            return F.lit(current_year)
        if what == "first":
            return F.lit(V.YEAR_MIN)
        return F.regexp_extract(m, pattern.replace(_B, "").replace(_E, ""), what[0]).cast("int") + what[1]

    def spans(pattern: str, low, high) -> Column:
        matches = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        return F.flatten(F.transform(matches, lambda m: span(bound(m, pattern, low), bound(m, pattern, high))))

    found = []
    for pattern, low, high in _RANGES:
        found.append(spans(pattern, low, high))
        rest = F.regexp_replace(rest, pattern, " ")
    recent = F.transform(F.regexp_extract_all(rest, F.lit(_RECENT), F.lit(0)), lambda m: small_number(F.concat(F.regexp_extract(m, _RECENT, 1), F.regexp_extract(m, _RECENT, 2))))
    found.append(F.flatten(F.transform(F.filter(recent, lambda n: n > 0), lambda n: span(F.greatest(F.lit(V.YEAR_MIN), F.lit(current_year) - n + 1), F.lit(current_year)))))
    rest = F.regexp_replace(rest, _RECENT, " ")
    found.append(F.transform(F.regexp_extract_all(rest, F.lit(f"{_B}{_Y}{_E}"), F.lit(1)), lambda y: y.cast("int")))
    return F.transform(F.array_sort(F.array_distinct(F.concat(*found))), lambda y: y.cast("string"))


_EDGE = r"^[\s\"'`.,;:()\[\]{}<>/。，、；：（）]+|[\s\"'`.,;:()\[\]{}<>/。，、；：（）]+$"
_YEAR_TAIL = rf"(?i)(?:\s+(?:{_Y}\s*(?:-|–|—|~|至|到|to)\s*{_Y}|between\s+{_Y}\s+and\s+{_Y}|(?:after|since|from|before)\s+{_Y}|{_Y}\s*(?:之后|以后|以来|起|之前|以前)|(?:近|最近)\s*[0-9一二两三四五六七八九十]{{1,3}}\s*年|(?:last|past)\s+\d{{1,2}}\s+years?|{_Y}))+$"


def field_terms(c: Column, field: str) -> Column:
    """Values after a field's label, up to the next label, a comma, semicolon, line break or the end; trailing years go."""
    own = "|".join(map(re.escape, V.FIELD_LABELS[field]))
    every = "|".join(re.escape(x) for v in V.FIELD_LABELS.values() for x in v)
    pattern = rf"(?i)(?:{own})\s*[:：]\s*(.+?)(?=(?:\s+(?:{every})\s*[:：])|[,，;；\n]|$)"
    trim = lambda x: F.regexp_replace(x, _EDGE, "")
    return F.filter(F.transform(F.regexp_extract_all(T.text_or_empty(c), F.lit(pattern), F.lit(1)), lambda x: T.squeeze(trim(F.regexp_replace(trim(x), _YEAR_TAIL, "")))), lambda x: x != "")


def constraints(queries: DataFrame, current_year: int) -> DataFrame:
    """Questions with years and the five labelled fields' terms."""
    q = F.col("text")
    return queries.select("*", years(q, current_year).alias("years"), *[field_terms(q, f).alias(f"{f}_terms") for f in V.FIELD_LABELS])


def allowed_documents(parsed: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the papers that fit each question's constraints.  A question without a row is open: it has no
    constraint, or none that anything fits.

    Fields must all fit, one of a field's terms is enough; texts are compared as substrings, years as members.  A paper's
    fields are read once for the terms of all questions.  What they hold is joined by field and term to the distinct sets of
    constraints, and questions take the papers of their set.
    """
    fields = list(V.FIELD_LABELS)
    columns = {"source": "source", "title": "title", "author": "authors", "venue": "venue", "keyword": "keywords"}

    def under(c: str, name: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(name).alias("grp"), (T.norm(x) if name != "year" else x).alias("needle")))

    wanted = F.concat(under("years", "year"), *[under(f"{f}_terms", f) for f in fields])
    needed = reduce(lambda a, b: a + b, [(F.size(c) > 0).cast("int") for c in ("years", *[f"{f}_terms" for f in fields])])
    terms = F.array_sort(F.array_distinct(F.filter(wanted, lambda w: w["needle"] != "")))
    key = F.sha1(F.to_json(F.struct("needed", "wants")).cast("binary")).alias("key")
    each = settled(parsed.select("query_id", needed.alias("needed"), terms.alias("wants")).select("query_id", "needed", "wants", key)).where(F.size("wants") > 0)
    asked = settled(each.select("key", "needed", "wants").distinct().select("key", "needed", F.explode("wants").alias("w")).select("key", "needed", "w.grp", "w.needle"))
    text = lambda c: T.norm(F.col(c).cast("string")) if c in papers.columns else F.lit("")
    year = F.col("year").cast("string") if "year" in papers.columns else F.lit("")
    fields_of = papers.select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("grp"), text(c).alias("text")) for f, c in columns.items()])).alias("x")).select("id", "x.grp", "x.text")
    held = containing(fields_of, asked.where("grp <> 'year'")).unionByName(papers.select(F.col("doc_id").alias("id"), F.lit("year").alias("grp"), year.alias("needle")))
    found = held.join(side(asked), ["grp", "needle"]).groupBy("key", F.col("id").alias("doc_id")).agg(F.count_distinct("grp").alias("n"), F.max("needed").alias("needed"))
    fits = settled(found.where("n = needed").select("key", "doc_id"))
    return each.select("query_id", "key").join(side(fits), "key").select("query_id", "doc_id")


# ---------------------------------------------------------------- comparison

def comparison_entities(c: Column) -> Column:
    """Up to four things that a question compares; empty if it compares nothing."""
    low = F.lower(F.trim(c))
    terms = model_terms(c)
    hint, joins, two = _has(low, V.COMPARES), low.rlike(r"(?i)(和|与|及|以及|跟|vs|/|、|&|\band\b)"), F.size(F.array_distinct(F.transform(terms, F.lower))) >= 2
    ends = [F.when(F.instr(low, m) > 0, F.instr(low, m)) for m in V.CUTS]
    head = F.substring(F.trim(c), F.lit(1), F.coalesce(F.least(*ends) - 1, F.length(F.trim(c))))
    parts = F.split(F.split(head, "的")[0], r"(?i)(?:和|与|及|以及|跟|vs\.?|/|、|&|\band\b)")
    named = F.filter(F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(T.squeeze(x), "[\"'`]", ""), V.NOUNS, ""), r"^[ ,，。？?；;：:]+|[ ,，。？?；;：:]+$", "")), lambda x: x != "")
    chosen = F.when((F.size(named) < 2) & (F.size(terms) >= 2), terms).otherwise(named)
    compares = (hint & (joins | two)) | (joins & two)
    return F.when(compares, F.slice(T.distinct_terms(chosen), 1, 4)).otherwise(F.array().cast("array<string>"))
