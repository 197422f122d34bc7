"""What the JVM has no function for, as Arrow-batched functions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import deque
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as X
from tokenizers import Tokenizer

#: What PDF text extraction leaves in place of ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "\x1b": "fi", "\x1c": "ffi", "\x1d": "ff", "\x1e": "fl", "\x80": "fl", "\xa0": " "}
_LIGATURES = str.maketrans(LIGATURES)
_SPACED = {c: " " for c in (9, 10, 13)}
_DROPPED = {c: None for c in range(32)}
#: Where a recursive splitter cuts, best place first.
SEPARATORS = ("\n\n", "\n", "。 ", "。", "；", "，", ". ", "; ", ", ", " ", "")


def normal_text(s: str | None) -> str:
    """NFKC, ligatures repaired, line breaks and tabs as blanks, other control characters gone, white space collapsed."""
    t = unicodedata.normalize("NFKC", s or "").translate(_LIGATURES)
    return " ".join(t.translate(_SPACED).translate(_DROPPED).split())


def clean_text(s: str | None) -> str:
    """As normal_text, but mark-up characters become blanks, `&` stands apart, and line breaks and tabs go without a blank."""
    t = unicodedata.normalize("NFKC", s or "").translate(_LIGATURES).replace("\\textcircled", " ")
    t = t.translate({ord(c): " " for c in "\\{}$^_~|"}).replace("&", " & ")
    return " ".join(t.translate(_DROPPED).split())


def first_json_object(s: str | None) -> str | None:
    """The first object that parses, whatever stands around it."""
    decoder, at = json.JSONDecoder(), (s or "").find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(s, at)
            if isinstance(value, dict):
                return s[at:end]
        except ValueError:
            pass
        at = s.find("{", at + 1)
    return None


def characters(parts: list[str]) -> list[int]:
    return [len(p) for p in parts]


#: Words whose tokens a counter keeps, and the longest of them.
WORDS, LONGEST_WORD = 1 << 20, 48
#: A blank after white space, or what some version of Unicode takes for it: the blank may then belong to it.
_GAP = re.compile(" (?<=[\\s\u180e\u200b\ufeff] )")
#: Letters in every version of Unicode, and marks behind them, with which they share no token.
_MARKED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]+)")


class _Counted(dict):
    """Tokens of `before` and a word, counted when they are first asked for; all are forgotten when there are too many."""

    def __init__(self, encode: Callable[[str], list], before: str = "", marks: dict[str, int] | None = None):
        super().__init__()
        self.encode, self.before, self.marks = encode, before, marks

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST_WORD:
            return len(self.encode(self.before + word))
        marked = _MARKED.fullmatch(word) if self.marks is not None else None
        n = self[marked[1]] + self.marks[marked[2]] if marked else len(self.encode(self.before + word))
        if len(self) >= WORDS:
            self.clear()
        self[word] = n
        return n


def _has_words(path: str) -> bool:
    """Whether no token of the tokenizer has a blank behind another character, so that words with the blank before them can be
    counted one by one: byte-level BPE with the usual pattern, nothing before it and no further tokens."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return usual and d.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and all(x["special"] for x in d.get("added_tokens", ()))


@lru_cache(maxsize=4)
def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts texts' tokens by a tokenizer's JSON file, which every executor can open; special tokens' names are plain text.

    Where the tokenizer allows it a text's words are looked up, and only new ones are encoded.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()

    def encode(s: str) -> list:
        return tokenizer.encode(s, add_special_tokens=False)

    whole = _Counted(encode)
    first, later = _Counted(encode, "", whole), _Counted(encode, " ", whole)
    one = later.__getitem__

    def by_words(part: str) -> int:
        if _GAP.search(part):
            return whole[part]
        words = part.split(" ")
        return first[words[0]] + sum(map(one, words[1:]))

    count = by_words if _has_words(path) else whole.__getitem__
    return lambda parts: list(map(count, parts))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, count: Callable[[list[str]], list[int]] = characters) -> list[str]:
    """Chunks of about `size` (characters, or what `count` counts), cut before the best separator present; what is still too
    long is cut at the next one.  A chunk begins with as many of the last parts of the one before as make up at most `overlap`."""
    place = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark, finer = separators[place], separators[place + 1 :]
    parts = list(text) if not mark else [p for p in (lambda x: [x[0], *[mark + y for y in x[1:]]])(text.split(mark)) if p]
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    total = 0

    def flush(whole: bool):
        nonlocal total
        while held and (joined := "".join(p for p, _ in held).strip()):
            # without the blanks at its ends a chunk may have more tokens than its parts: its last parts then begin another one
            back: deque[tuple[str, int]] = deque()
            while count is not characters and len(held) > 1 and joined and count([joined])[0] > size:
                back.appendleft(held.pop())
                joined = "".join(p for p, _ in held).strip()
            if joined and finer and len(held) == 1 and count is not characters and count([joined])[0] > size:
                out.extend(split_recursively(joined, size, overlap, finer, count))
            elif joined:
                out.append(joined)
            if not back:
                break
            total = sum(n for _, n in held) - held.popleft()[1]
            while held and total + sum(n for _, n in back) > size or total > overlap:
                total -= held.popleft()[1]
            held.extend(back)
            total = sum(n for _, n in held)
        if whole:
            held.clear()
            total = 0

    for p, n in zip(parts, count(parts), strict=True):
        if n >= size:
            flush(True)
            if finer:
                out += split_recursively(p, size, overlap, finer, count)
            else:
                out.append(p)
            continue
        if total + n > size and held:
            flush(False)
            while total > overlap or (total > 0 and total + n > size):
                total -= held.popleft()[1]
        held.append((p, n))
        total += n
    flush(True)
    return out


@F.pandas_udf(X.StringType())
def normalise(s: pd.Series) -> pd.Series:
    return s.map(normal_text)


@F.pandas_udf(X.StringType())
def clean(s: pd.Series) -> pd.Series:
    return s.map(clean_text)


@F.pandas_udf(X.StringType())
def json_object(s: pd.Series) -> pd.Series:
    return s.map(first_json_object)


def splitter(size: int = 500, overlap: int = 100, tokenizer: str | None = None):
    """A column function; sizes are tokens of the tokenizer in that file, or characters without one."""

    @F.pandas_udf(X.ArrayType(X.StringType()))
    def split(s: pd.Series) -> pd.Series:
        count = token_counter(tokenizer) if tokenizer else characters
        return s.map(lambda t: split_recursively(t or "", size, overlap, count=count) if t else [])

    return split


def sized_splitter(size: int, overlap: int, tokenizer: str):
    """As splitter with a tokenizer, and the tokens of each chunk as it is."""

    @F.pandas_udf("parts array<string>, sizes array<bigint>")
    def split(s: pd.Series) -> pd.DataFrame:
        count = token_counter(tokenizer)
        parts = [split_recursively(t, size, overlap, count=count) if t else [] for t in s]
        return pd.DataFrame({"parts": parts, "sizes": [count(x) for x in parts]})

    return split
