"""First-page metadata: title, year, authors, venue, keywords and language of a paper, as one Arrow-batched function.

A page is a handful of lines, so every rule is a weight or a test on features that a line computes once.
"""

from __future__ import annotations

import re
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.arrow import normal_text
from folioscan.functions.vocabulary import PAGE_BANNERS, PAGE_VENUES

BANNERS = re.compile("|".join(f"(?:{p})" for p in PAGE_BANNERS))
# ---- fixed values: what publication lines and affiliations say
PUBLISHING = ("conference", "proceedings", "journal", "communications", "transaction", "transactions", "published", "doi", "arxiv", "vol.", "volume", "issue")
AFFILIATIONS = ("university", "college", "school", "department", "institute", "laboratory", "hospital", "faculty", "momenta", "microsoft research")
OPENERS = ("abstract", "keywords", "introduction")
YEAR = re.compile(r"\b(19\d{2}|20\d{2})\b")
LINK = re.compile(r"\bdoi\b|https?://|www\.")


class Line:
    def __init__(self, raw: str):
        self.text = normal_text(raw)
        self.low = self.text.lower()
        self.words = self.text.split()

    def says(self, words) -> bool:
        return any(w in self.low for w in words)

    @cached_property
    def banner(self) -> bool:
        return bool(self.low) and bool(BANNERS.search(self.low))

    @cached_property
    def linked(self) -> bool:
        return bool(LINK.search(self.low))

    @cached_property
    def opens(self) -> bool:
        return self.low.startswith(OPENERS)

    @cached_property
    def years(self) -> list[str]:
        return YEAR.findall(self.text)

    @cached_property
    def titled(self) -> bool:
        return 8 <= len(self.text) <= 220 and not (self.banner or self.opens or self.linked or "@" in self.text)

    @cached_property
    def published(self) -> bool:
        return bool(self.text) and (self.banner or self.linked or self.says(PUBLISHING) or bool(re.search(r"\b(received|accepted|published|copyright)\b", self.low)))

    @cached_property
    def lists(self) -> bool:
        return "," in self.text or " and " in self.low or "&" in self.text

    @cached_property
    def authored(self) -> bool:
        """Shaped like names: a quarter of a list's words at least, or a short line of capitalised words."""
        dated = re.search(r"\b(received|accepted|published)\b", self.low)
        venue = self.says(PAGE_VENUES + PUBLISHING) and not self.lists and not re.search(r"\d", self.text)
        if not self.text or len(self.text) > 420 or self.banner or self.opens or self.linked or dated or venue or self.text.count("@") >= 2:
            return False
        if self.lists:
            names = sum(bool(re.match(r"[A-Z][A-Za-z.'-]+$", w.strip(",;:"))) for w in self.words)
            return names >= 2 and names >= 0.25 * len(self.words)
        return sum(w[0].isupper() for w in self.words) >= 2 and len(self.words) <= 18

    @cached_property
    def names(self) -> str:
        """Names without marks, numbers, mail addresses and affiliations."""
        t = re.sub(r"\\[A-Za-z]+|[{}$^_~|\\]|[*†‡]+", " ", self.text)
        t = re.sub(r"(?<=[A-Za-z])\d+(?:,\d+)*|\b\d+(?:,\d+)*\*?(?!\w)", "", t)
        t = re.sub(r"\b([A-Za-z])\s+([A-Za-z])\b", r"\1\2", re.sub(r"\s*&\s*", " & ", t))
        t = " ".join(t.split())
        ends = [p for p in (t.lower().find(h) for h in AFFILIATIONS) if p > 0]
        cut = min([*ends, *([t.index("@")] if "@" in t else [])], default=len(t))
        t = t[:cut].strip(" ,;:-") if cut < len(t) else t
        parts = [p.strip() for p in t.split(",") if p.strip()]
        return " ".join((", ".join(parts[: 1 if ends else 24]) if "," in t else t).split())


#: Weights of a title line's features.
WEIGHTS = (
    (3, lambda x: 4 <= len(x.words) <= 18),
    (2, lambda x: len(re.findall(r"\b[A-Z][A-Za-z0-9-]{2,}\b", x.text)) >= 3),
    (-6, lambda x: x.text.count(",") >= 2),
    (-6, lambda x: len(re.findall(r"\d", x.text)) >= 3),
    (-2, lambda x: bool(re.search(r"\band\b", x.low))),
    (-3, lambda x: x.text.endswith((".", ";", ":"))),
    (-8, lambda x: bool(re.search(r"\b(article|downloads?|citations?)\b", x.low))),
    (-2, lambda x: bool(x.years)),
    (-4, lambda x: x.says(("university", "department", "institute", "school", "college"))),
)


def title_score(lines: list[Line], i: int) -> int | None:
    x = lines[i]
    if not x.titled:
        return None
    early = 4 if i <= 2 else 2 if i <= 5 else 1 if i <= 8 else 0
    after = 4 * any(y.authored for y in lines[i + 1 : i + 3]) + 5 * any(y.low.startswith(("abstract", "摘要")) for y in lines[i + 1 : i + 4])
    return 10 + early + after + sum(w for w, holds in WEIGHTS if holds(x))


def title_of(lines: list[Line], stem: str) -> tuple[str, int]:
    scored = [(s, -i) for i in range(min(18, len(lines))) if (s := title_score(lines, i)) is not None]
    if scored and max(scored)[0] > 0:
        i = -max(scored)[1]
        return lines[i].text, i
    return normal_text(stem.split(" - ")[-1]), -1


def year_of(lines: list[Line], stem: str, at: int) -> str:
    votes: dict[str, int] = {}
    for x in lines[max(0, at - 3) : max(at + 18, 18)]:
        if x.banner or not x.years:
            continue
        weight = 1 + 3 * x.says(PUBLISHING) + 2 * x.says(PAGE_VENUES) + 2 * (len(x.text) <= 80 and len(x.years) == 1) - ("received" in x.low) - ("accepted" in x.low) - 3 * ("introduction" in x.low)
        for y in x.years:
            votes[y] = votes.get(y, 0) + weight
    if votes:
        return max(votes, key=lambda y: (votes[y], y))
    return next(iter(re.findall(r"(?:19|20)\d{2}", stem)), "")


def authors_of(lines: list[Line], at: int) -> str:
    """Lines of names before the title, or else after it, up to six."""
    for span in ([lines[max(0, at - 8) : at], lines[at + 1 : at + 7]] if at >= 0 else [lines[1:8]]):
        found: list[str] = []
        for x in span:
            if x.opens or (found and (x.banner or x.linked or (not x.authored and x.published))):
                break
            if x.banner or x.linked or not x.authored:
                continue
            if len(x.names.split()) >= 2:
                found.append(x.names)
            elif found:
                break
        if found:
            seen: dict[str, str] = {}
            for f in found:
                seen.setdefault(f.lower(), f)
            return " ; ".join(list(seen.values())[:6])
    return ""


def venue_of(lines: list[Line], stem: str, at: int) -> str:
    best = (0, "")
    for x in lines[: max(12, at + 10 if at >= 0 else 14)]:
        if not x.text or x.banner or (x.says(AFFILIATIONS) and not x.says(PUBLISHING)):
            continue
        for v in PAGE_VENUES:
            if re.search(rf"\b{v}\b", x.low):
                score = 1 + 3 * x.says(PUBLISHING) + 2 * x.low.startswith(v) + ("|" in x.text or ":" in x.text)
                best = max(best, (score, v.upper()), key=lambda b: b[0])
    return best[1] or next((v.upper() for v in PAGE_VENUES if re.search(rf"\b{v}\b", stem.lower())), "")


def metadata(page: str | None, file_name: str | None) -> tuple[str, str, str, str, str, str]:
    raw = [r for r in (page or "").split("\n") if r.strip()]
    stem = re.sub(r"\.pdf$", "", file_name or "", flags=re.I)
    lines = [Line(r) for r in raw]
    title, at = title_of(lines, stem)
    words = re.search(r"(?i)keywords?\s*[:：]\s*(.+)", page or "")
    text = " ".join(raw).strip()
    cjk = len(re.findall("[一-鿿]", text))
    language = "unknown" if not text else "zh" if cjk / len(text) > 0.15 else "en"
    return title, year_of(lines, stem, at), authors_of(lines, at), venue_of(lines, stem, at), " ".join(words[1].split())[:220] if words else "", language


FIELDS = ("title", "year", "authors", "venue", "keywords", "language")


def front_pages(items: DataFrame) -> DataFrame:
    """(doc_id and the six fields) from layout items (doc_id, file_name, ord, page, text); only page 0 counts."""
    first = items.where("page = 0").groupBy("doc_id", "file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("page"))

    def run(batches):
        for b in batches:
            yield pd.concat([b[["doc_id"]], pd.DataFrame([metadata(p, f) for p, f in zip(b["page"], b["file_name"], strict=True)], columns=FIELDS, index=b.index)], axis=1)

    return first.mapInPandas(run, f"doc_id {dict(first.dtypes)['doc_id']}, " + ", ".join(f"{f} string" for f in FIELDS))
