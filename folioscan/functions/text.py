"""Scalar text functions and predicates as columns; they run in the JVM and prune and push down like any expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.vocabulary import BANNER_WORDS, FRONT_MATTER, NOISE_SECTIONS, NOISE_WORDS, NOTICES, REFERENCE_HEADINGS, VENUES

#: A CJK character alone, or a run of ASCII letters, digits and underscores.
TOKEN = r"[一-鿿]|[a-z0-9_]+"
_WORD = r"[\p{L}\p{N}_]"
#: What ends a word for SQL engines whose `\b` knows ASCII alone.
ASCII_WORD = "[A-Za-z0-9_]"
#: Fixed value: the section of what stands before any heading.
BODY = "正文"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: as a lambda's variable it is not copied into where it is used."""
    return F.transform(F.array(value), body)[0]


def run_lengths(c: Column) -> Column:
    """array<struct<value, n>>: the distinct entries of an array in order with how often each occurs, within the row."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    count = lambda s, e: F.transform(e, lambda x, i: F.struct(F.get(s, x - 1).alias("value"), (x - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("long").alias("n")))
    return let(F.array_sort(c), lambda s: F.when(F.size(s) > 0, let(ends(s), lambda e: count(s, e))))


def squeeze(c: Column) -> Column:
    """Runs of (Unicode) white space as one blank; trimmed; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


#: Unicode's white space, as the pattern (?U)\\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without (Unicode) white space at either end; null is empty."""
    return F.trim(text_or_empty(c), F.lit(WHITE))


def norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"({TOKEN})"), F.lit(1))


def index_tokens(c: Column) -> Column:
    """Tokens to index: a text without any has the one token `_`."""
    return let(tokens(c), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("_"))))


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` characters; a longer text loses three more and its trailing blanks to an ellipsis."""
    return let(squeeze(c), lambda s: F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, max(limit - 3, 0))), F.lit("..."))).otherwise(s))


def top_section(path: Column) -> Column:
    first = F.trim(F.substring_index(text_or_empty(path), " > ", 1))
    return F.when(first == "", "main").otherwise(first)


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(text_or_empty(html), r"<[^>]+>", " "))


def quality_line(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(c), r"\s+", " "), 1, 160)


def edge_lines(text: Column) -> Column:
    """struct(first, last) of the non-blank lines, each collapsed and cut to 160 characters; empty where there is none."""
    lines = F.filter(F.split(text_or_empty(text), "\n"), lambda x: F.trim(x) != "")
    pick = lambda i: F.when(F.size(lines) > 0, quality_line(F.element_at(lines, i))).otherwise("")
    return F.struct(pick(1).alias("first"), pick(-1).alias("last"))


def meaningful_line(line: Column) -> Column:
    """4 to 140 characters with two letters in a row."""
    return F.length(line).between(4, 140) & line.rlike(r"[A-Za-z一-鿿]{2,}")


def heading(c: Column) -> Column:
    """The first line of the trimmed text, squeezed, without colons, hyphens and blanks around it."""
    first = F.regexp_extract(text_or_empty(c), r"(?U)^\s*([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1)
    return F.regexp_replace(squeeze(first), r"^[:\- ]+|[:\- ]+$", "")


def is_reference_heading(c: Column) -> Column:
    return let(F.lower(heading(c)), lambda h: _any(h.startswith(x) for x in REFERENCE_HEADINGS))


def is_reference_section(path: Column) -> Column:
    return F.lower(text_or_empty(path)).rlike("|".join(REFERENCE_HEADINGS))


def normal_reference_heading(c: Column) -> Column:
    def named(h: Column) -> Column:
        low = F.lower(h)
        return F.when(low.startswith("reference"), "References").when(low.startswith("bibliography"), "Bibliography").when(low.startswith("参考文献"), "参考文献").when(low.startswith("参考资料"), "参考资料").otherwise(h)

    return let(heading(c), named)


def reference_features(df: DataFrame, column: str, word: str = _WORD) -> DataFrame:
    """`df` with the struct `ref` of a text's reference features: s (squeezed), opens (a references heading), years,
    signal (0 to 5: number prefix, up to two years, authors, venue), entry, goes_on (a continuation), chunk, body (a
    paragraph after the references).  `word` is the class of characters that words are made of.

    Each step is a projection of its own, so that every pattern is matched once.
    """
    s, low, sig, yrs = F.col("__s"), F.lower("__s"), F.col("__signal"), F.col("__years")
    authors = low.contains("et al") | s.rlike(rf"(?:(?<!{word})[A-Z]\.\s*){{2,}}") | s.rlike(rf"(?<!{word})[A-Z][a-z'`-]+,\s*[A-Z]\.")
    marks = rf"(?<!{word})(?:doi|arxiv|in\s+proceedings)(?!{word})|(?<!{word})(?:pp?\.|vol\.|no\.|proc\.)(?={word})"
    venue = _any(low.contains(v) for v in VENUES) | low.rlike(marks)
    body = low.rlike(rf"^(?:appendix|supplement|supplementary|acknowledg|conclusion|discussion)(?!{word})") | s.rlike(r"^(?:\d+(?:\.\d+)*|[A-Z]|[IVXLCM]+)[.)]?\s+[A-Z]")
    out = df.withColumn("__s", squeeze(F.col(column))).withColumn("__opens", is_reference_heading(F.col(column)))
    out = out.withColumns({"__prefix": s.rlike(r"^(?:\[\d+\]|\(\d+\)|\d+\.)\s+"), "__years": F.regexp_count(low, F.lit(rf"(?<!{word})(?:19|20)\d{{2}}[a-z]?(?!{word})")), "__authors": authors, "__venue": venue})
    out = out.withColumn("__signal", F.when(s == "", 0).otherwise(F.col("__prefix").cast("int") + F.least(yrs, F.lit(2)) + F.col("__authors").cast("int") + F.col("__venue").cast("int")))
    long = F.length(s) >= 20
    out = out.withColumns({"__entry": long & (sig >= F.when(F.col("__prefix"), 3).otherwise(4)), "__on": long & (F.col("__opens") | ((sig >= 3) & (yrs >= 1)))})
    out = out.withColumn("__chunk", F.col("__opens") | F.col("__entry") | F.col("__on"))
    out = out.withColumn("__body", (F.length(s) >= 40) & ~F.col("__chunk") & (body | ((yrs == 0) & s.rlike("[.!?]"))))
    names = {"s": "__s", "opens": "__opens", "years": "__years", "signal": "__signal", "entry": "__entry", "goes_on": "__on", "chunk": "__chunk", "body": "__body"}
    return out.withColumn("ref", F.struct(*[F.col(v).alias(k) for k, v in names.items()])).drop(*names.values(), "__prefix", "__authors", "__venue")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "on")


def language(c: Column) -> Column:
    """zh where over 15 % of the characters are CJK, unknown for an empty text, else en."""
    s = F.trim(text_or_empty(c))
    share = F.length(F.regexp_replace(s, r"[^一-鿿]", "")) / F.length(s)
    return F.when(s == "", "unknown").when(share > 0.15, "zh").otherwise("en")


def contains_any(text: Column, needles: Column) -> Column:
    """Whether a normalised needle occurs in the text; true without needles."""
    return (F.size(needles) <= 0) | F.exists(needles, lambda n: F.contains(text, n))


def string_list(c: Column) -> Column:
    """A JSON list, a list divided by `|`, or one value, as trimmed non-empty strings."""
    parsed = F.from_json(c, "array<string>")
    return F.filter(F.transform(F.coalesce(F.when(F.trim(c).startswith("["), parsed), F.split(text_or_empty(c), r"\|")), lambda x: F.trim(x)), lambda x: x != "")


def text_list(c: Column) -> Column:
    """A JSON list's non-blank strings, or one text, trimmed; empty otherwise."""
    parsed = F.filter(F.transform(F.from_json(c, "array<string>"), strip), lambda x: x != "")
    one = strip(c)
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (one == ""), none).when(one.startswith("["), F.coalesce(parsed, none)).otherwise(F.array(one))


def box(c: Column) -> Column:
    """The first four numbers of a JSON list; empty where there are fewer or one is no number."""
    four = F.transform(F.slice(F.from_json(c, "array<string>"), 1, 4), lambda x: F.trim(x).try_cast("double"))
    whole = (F.size(four) == 4) & ~F.exists(four, lambda x: x.isNull())
    return F.when(F.coalesce(whole, F.lit(False)), four).otherwise(F.array().cast("array<double>"))


def media_id(path: Column, prefix: str) -> Column:
    """`prefix` and the first 24 safe characters of a file's name without its last suffix; unknown for a blank path."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"(?<=[^.])\.[^.]+$", "")
    safe = F.substring(F.regexp_replace(stem, r"[^a-zA-Z0-9._-]+", "_"), 1, 24)
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", f"{prefix}_unknown").otherwise(F.concat(F.lit(f"{prefix}_"), safe))


def _trim_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .,:;-]+|[ .,:;-]+$", "")


def without_front_matter(c: Column, title: Column | None = None, authors: Column | None = None) -> Column:
    """A cleaned text without banners, its own title and authors, notices, and marks at either end."""
    for p in FRONT_MATTER:
        c = F.trim(F.regexp_replace(c, p, ""))
    for prefix in (title, authors):
        if prefix is not None:
            start = squeeze(prefix)
            c = let(F.struct(c.alias("t"), start.alias("p")), lambda x: F.when((x["p"] != "") & F.startswith(x["t"], x["p"]), _trim_marks(F.substring(x["t"], F.length(x["p"]) + 1, F.length(x["t"])))).otherwise(x["t"]))
    for p in NOTICES:
        c = F.regexp_replace(c, p, "")
    return _trim_marks(c)


def name_list(c: Column, most: int = 24) -> Column:
    """Authors divided by commas, semicolons, `and` or `et al`."""
    parts = F.split(squeeze(c), r"(?i)[;,，、]|\band\b|\bet al\b")
    return F.slice(F.filter(F.transform(parts, squeeze), lambda x: x != ""), 1, most)


def keyword_list(c: Column, most: int = 32) -> Column:
    return F.slice(F.filter(F.transform(F.split(squeeze(c), r"[;,，、|/]"), squeeze), lambda x: x != ""), 1, most)


def is_noise_section(name: Column) -> Column:
    """A section name that says nothing of a paper: blank, a journal's furniture, an affiliation, a citation."""
    return let(squeeze(name), lambda s: (s == "") | _any(s.rlike(p) for p in NOISE_SECTIONS) | _any(F.lower(s).contains(w) for w in NOISE_WORDS))


def is_body_section(name: Column) -> Column:
    """main, body, or a name of up to eight characters without a letter or digit of ASCII."""
    return let(squeeze(name), lambda s: F.lower(s).isin("main", "body") | (F.length(s).between(1, 8) & ~s.rlike("[A-Za-z0-9]")))


def section_text(c: Column, name: Column, title: Column | None = None, authors: Column | None = None) -> Column:
    """A section's cleaned text; that of a body section without front matter."""
    return F.when(is_body_section(name), without_front_matter(c, title, authors)).otherwise(c)


def is_skipped_section(name: Column, c: Column, title: Column) -> Column:
    """Whether a summary leaves a section out: nothing in it, or a body section with a banner or the paper's title first."""
    low, t = F.lower(c), squeeze(title)
    return (c == "") | (is_body_section(name) & (_any(low.contains(w) for w in BANNER_WORDS) | ((t != "") & F.startswith(c, t))))


def distinct_terms(terms: Column) -> Column:
    """First spelling of each term, compared without case, in order; blanks go."""
    empty = F.struct(F.array().cast("array<string>").alias("low"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        t = F.trim(x)
        skip = (t == "") | F.array_contains(s["low"], F.lower(t))
        return F.when(skip, s).otherwise(F.struct(F.array_append(s["low"], F.lower(t)).alias("low"), F.array_append(s["out"], t).alias("out")))

    return F.aggregate(terms, empty, step, lambda s: s["out"])


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def citation_edge_id(doc_id: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("::", doc_id, text).cast("binary")), 1, 16)


def parsed_reference(c: Column) -> Column:
    """struct(authors, year, title): the first year splits authors from title; without one, the title is the start."""
    s = squeeze(c)
    year = F.regexp_extract(s, r"((?:19|20)\d{2})", 1)
    at = F.when(year != "", F.instr(s, year)).otherwise(0)
    edge = r"^[\s.,;:()\[\]]+|[\s.,;:()\[\]]+$"
    after = F.regexp_replace(F.substring(s, at + 4, F.length(s)), edge, "")
    title = F.substring(F.regexp_extract(after, r"(?s)^(.*?)(?:[.?!]\s+|$)", 1), 1, 260)
    authors = F.substring(F.regexp_replace(F.substring(s, F.lit(1), at - 1), edge, ""), 1, 200)
    return F.struct(
        F.when(at > 0, authors).otherwise("").alias("authors"), year.alias("year"),
        F.when((at > 0) & (title != ""), title).otherwise(F.substring(s, 1, 240)).alias("title"),
    )


def heading_level(c: Column) -> Column:
    """Depth of a numbered heading (digits and white space, no mark between); 1 for references, roman numerals with a mark,
    chapter, section, appendix and all capitals of 80 characters or fewer; null otherwise or above 140 characters."""

    def level(h: Column) -> Column:
        low = F.lower(h)
        number = F.regexp_extract(h, r"^(\d+(?:\.\d+)*)\s+\S", 1)
        other = low.rlike(r"^[ivxlcdm]+[.)]\s+\S|^(?:chapter|section|appendix)(?![\p{L}\p{N}_])|^第[一二三四五六七八九十百0-9]+[章节部分]")
        capitals = (F.length(h) <= 80) & (F.upper(h) == h) & (low != h)
        return (
            F.when((h == "") | (F.length(h) > 140), None).when(_any(low.startswith(x) for x in REFERENCE_HEADINGS), 1)
            .when(number != "", F.size(F.split(number, r"\."))).when(other | capitals, 1)
        )

    return let(heading(c), level)


def is_heading(c: Column) -> Column:
    return heading_level(c).isNotNull()


def is_list_item(c: Column) -> Column:
    return F.trim(text_or_empty(c)).rlike(r"^(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][.)]\s+|[(]\d+[)]|（\d+）)")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
