"""Grouping of spelling variants: words one edit apart, found by a positional index of bigrams with a count filter.

Words are counted within each partition, then added.  An edit changes at most two of a word's bigrams, so two near words
share all but two of either's.  Three steps use that:

- Routing.  With a word's bigrams (repeats numbered) ordered from rare to frequent, near words share SHARED of their first
  SHARED + 2.  A word is sent under each choice of SHARED of these, so every near pair meets; a pair counts where it meets
  under its first SHARED common bigrams, so once.
- Index.  The words of a group are indexed one after the other, short ones first, by bigram, length and place.  A word asks
  for those of its own length with the bigram in the same place, and for those shorter by one with it there or one place
  before.  Bigrams that a choice passes over before its last one are left out, as the other word of a pair that counts there
  lacks them.  A word for which more than two bigrams in all have no list has no near word; otherwise the shortest lists are
  merged by a heap, and what occurs in enough of them is looked up in the others until the bound is passed or missed.
- Verification of the pairs above the bound, character by character.

A group beyond HOT words is held by several tasks; each indexes it whole and asks for a part of its words.

Cases: null and empty texts have no words; a null doc_id counts as an empty string before the colon; repeated rows count as
often as they stand there; ties of n go to the smaller word; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_arrow, cut, partitions, tidy

RUN = "[A-Za-zÀ-ÿ]"
LENGTH, LEAST, EVERY, FACTOR = 7, 2, 31, 10
#: Bigrams of a routing key.  A word of LENGTH has LENGTH - 1, of which near words share LENGTH - 3: no more than that.
SHARED = 3
#: Words of a group that one task asks for, rows of a bucket of groups, and rows whose lists are built at once.
HOT, BUCKET, TOGETHER = 20_000, 200_000, 16_384
#: Distinct words that a partition holds before it sends their counts on.
SENT = 400_000


def counted_words(docs: DataFrame, length: int = LENGTH, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n) of runs of letters in whole texts, lower-cased in A-Z, of at least `length` code points and `least` occurrences.

    Of a run whose crc32 of `<doc_id>:<run>` is divisible by `every` one code point goes: the one at crc32 modulo its length.
    """
    long = re.compile(f"{RUN}{{{length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            found = as_arrow(word=pa.array(list(seen), pa.binary()).cast(pa.string()), n=np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                runs = Counter(long.findall(text)) if len(text) < 1 << 20 else Counter(m[0] for m in long.finditer(text))
                before = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in runs.items():
                    raw = word.encode().lower()  # of bytes: A-Z alone
                    h = zlib.crc32(raw, before)
                    if h % every == 0:
                        whole = raw.decode()
                        at = h % len(whole)
                        if len(whole) <= length:
                            continue
                        raw = (whole[:at] + whole[at + 1 :]).encode()
                    seen[raw] += n
                if len(seen) > SENT:
                    yield sent()
        if seen:
            yield sent()

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def ranked_bigrams(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(place from rare to frequent, words' occurrences) of each bigram: at most the square of the alphabet's 90 letters."""
    bigrams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    found = words.select(F.explode(bigrams).alias("bigram")).groupBy("bigram").count().collect()
    return {r["bigram"]: (k, r["count"]) for k, r in enumerate(sorted(found, key=lambda r: (r["count"], r["bigram"])))}


def first_bigrams(word: str, ranked: dict[str, tuple[int, int]], shared: int = SHARED) -> list[int]:
    """The rarest shared + 2 bigrams of a word as numbers in that order; equal ones are numbered."""
    times: dict[str, int] = {}
    out = []
    for i in range(len(word) - 1):
        g = word[i : i + 2]
        times[g] = k = times.get(g, -1) + 1
        out.append(ranked[g][0] << 32 | k)
    return sorted(out)[: shared + 2]


def _key(chosen: tuple[int, ...]) -> int:
    """One number for a choice of SHARED bigrams: 13 bits for the place of one of at most 90 * 90, 8 for its number.

    Equal bigrams are numbered from 0 and stand together, so no number among the first SHARED + 2 reaches 8 bits.
    """
    key = 0
    for g in chosen:
        key = key << 21 | (g >> 32) << 8 | g & 255
    return key


#: Choices of SHARED of the first bigrams, each with those that it passes over before its last one.
CHOICES = [(c, [i for i in range(c[-1]) if i not in c]) for c in combinations(range(SHARED + 2), SHARED)]


def routes(word: str, ranked: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """(keys, places passed over, rarest bigram's place in the ranking) of a word's choices.

    A pair counts under its first SHARED common bigrams, so one that a word has before the last of these and that was not
    chosen is not in the other word.  Up to two such places (from 1, a byte each) are given, of bigrams that stand in the
    word once.
    """
    times: dict[str, int] = {}
    found = []
    for i in range(len(word) - 1):
        g = word[i : i + 2]
        times[g] = k = times.get(g, -1) + 1
        found.append((ranked[g][0] << 32 | k, i + 1, g))
    found.sort()
    first = [x[0] for x in found[: SHARED + 2]]
    small = [(x >> 32) << 8 | x & 255 for x in first]
    place = [p if p < 256 and not times[g] else 0 for _, p, g in found[: SHARED + 2]]
    keys, over, rarest = [], [], []
    for (a, *rest), passed in CHOICES:
        key = small[a]
        for i in rest:
            key = key << 21 | small[i]
        keys.append(key)
        out = 0
        for i in passed:
            if place[i]:
                out = out << 8 | place[i]
        over.append(out)
        rarest.append(small[a] >> 8)
    return keys, over, rarest


def routed(words: DataFrame, ranked: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, word, n, over, most) for each choice of bigrams; `over` are places passed over, `most` bounds the key's group."""
    count = np.array([n for _, n in sorted(ranked.values())], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, over, rarest = [], [], []
            for word in batch.column(0).to_pylist():
                k, o, r = routes(word, ranked)
                keys += k
                over += o
                rarest += r
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(CHOICES)))
            yield as_arrow(key=np.array(keys, np.int64), word=batch.column(0).take(at), n=batch.column(1).take(at), over=np.array(over, np.int32), most=count[np.array(rarest, np.int64)])

    return words.mapInArrow(run, "key long, word string, n long, over int, most long")


def one_edit(a: str, b: str) -> bool:
    """Whether `b`, as long or longer by one, differs by exactly one replaced or inserted character."""
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def merged(lists: list, bound: int) -> list[int]:
    """What stands in at least `bound` of the ascending lists (an entry of `lists` is one list, or a pair counted as one).

    The lists beyond the shortest few hold few that are needed: what doesn't occur twice among the shortest
    len(lists) - bound + 2 can't reach the bound.
    """
    if bound > len(lists):
        return []
    lists = sorted(lists, key=lambda x: len(x) if type(x) is list else len(x[0]) + len(x[1]))
    n = min(len(lists), len(lists) - bound + 2)
    flat = [y for x in lists[:n] for y in ((x,) if type(x) is list else x)]
    need = bound - (len(lists) - n)
    out = []
    last, count = -1, 0
    for j in heapq.merge(*flat, (1 << 62,)):
        if j == last:
            count += 1
            continue
        if count >= need:
            for x in lists[n:]:
                if count >= bound:
                    break
                for y in (x,) if type(x) is list else x:
                    k = bisect_left(y, last)
                    if k < len(y) and y[k] == last:
                        count += 1
                        break
            if count >= bound:
                out.append(last)
        last, count = j, 1
    return out


def near_in_group(words: list[str], keys: list[list[int]], step: int, asks: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """(later, earlier) of each near pair among words of ascending length.

    `keys` are their bigrams' postings (bigram, length, place) as numbers, without those that a near word can't have: one
    less is one place before, `step` less is one shorter.  With `asks` only the words marked ask.
    """
    index: dict[int, list[int]] = {}
    get = index.get
    lengths: set[int] = set()
    for i, (word, own) in enumerate(zip(words, keys, strict=True)):
        n = len(word)
        bound = n - 3
        if asks is None or asks[i]:
            if n in lengths:
                lists = [x for k in own if (x := get(k)) is not None]
                if len(lists) >= bound:
                    for j in merged(lists, bound):
                        if one_edit(words[j], word):
                            yield i, j
            if n - 1 in lengths:
                lists = []
                for k in own:
                    x, y = get(k - step), get(k - step - 1)
                    if x is not None or y is not None:
                        lists.append(y if x is None else x if y is None else (x, y))
                if len(lists) >= bound:
                    for j in merged(lists, bound):
                        if one_edit(words[j], word):
                            yield i, j
        lengths.add(n)
        for k in own:
            x = get(k)
            if x is None:
                index[k] = [i]
            else:
                x.append(i)


def postings(words: list[str], over: np.ndarray | None = None) -> tuple[list[list[int]], int]:
    """The numbers (bigram, length, place) of each word's bigrams but those at the places in `over`, and what a length counts in them."""
    sizes = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    inside = np.ones(len(code), bool)
    inside[first + sizes - 1] = False
    if over is not None:
        for place in (over & 255, over >> 8):
            inside[(first + place - 1)[place > 0]] = False
    at = np.flatnonzero(inside)
    _, bigram = np.unique(code[at] << 21 | code[at + 1], return_inverse=True)
    row = np.repeat(np.arange(len(words)), sizes)[at]
    step = int(sizes.max()) + 2
    key = ((bigram * step + sizes[row]) * step + at - first[row] + 1).tolist()
    edge = np.searchsorted(row, np.arange(len(words) + 1)).tolist()
    return [key[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], step


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, both ways."""
    ranked = ranked_bigrams(words)
    rows = routed(words, ranked)
    seldom, often = rows.filter(F.col("most") <= HOT), rows.filter(F.col("most") > HOT)
    hot = often.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOT)
    pieces = F.coalesce(F.ceil(F.col("rows") / HOT), F.lit(1)).cast("int")
    split = often.join(hot, "key", "left").select("key", "word", "n", "over", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), pieces.alias("pieces"))
    whole = seldom.select("key", "word", "n", "over", F.lit(0).alias("piece"), F.lit(1).alias("pieces"))
    total = sum(n for _, n in ranked.values())  # bigrams of all words
    n = max(partitions(words.sparkSession), -(-total // BUCKET))
    dealt = whole.unionByName(split).withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(n)).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        key, piece, pieces = (table[c].to_numpy() for c in ("key", "piece", "pieces"))
        size = pa.compute.utf8_length(table["word"]).to_numpy()
        order = np.lexsort((size, piece, key))
        key, piece = key[order], piece[order]
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]), [True]]))
        begin, end = edge[:-1][np.diff(edge) > 1], edge[1:][np.diff(edge) > 1]  # a word alone has nobody to meet
        out: list[tuple[str, str, int, int]] = []
        a = 0
        while a < len(begin):
            b = max(a + 1, int(np.searchsorted(end, begin[a] + TOGETHER, side="right")))
            part = table.take(pa.array(order[begin[a] : end[b - 1]]))
            words, counts = part["word"].to_pylist(), part["n"].to_pylist()
            keys, step = postings(words, part["over"].to_numpy())
            for x, y in zip((begin[a:b] - begin[a]).tolist(), (end[a:b] - begin[a]).tolist(), strict=True):
                k, p, ps = int(key[begin[a] + x]), int(piece[begin[a] + x]), int(pieces[order[begin[a] + x]])
                asks = [zlib.crc32(w.encode()) % ps == p for w in words[x:y]] if ps > 1 else None
                for i, j in near_in_group(words[x:y], keys[x:y], step, asks):
                    one, other = words[x + i], words[x + j]
                    common = set(first_bigrams(one, ranked)).intersection(first_bigrams(other, ranked))
                    if _key(tuple(sorted(common)[:SHARED])) == k:
                        out.append((one, other, counts[x + i], counts[x + j]))
            a = b
        one, other, n_one, n_other = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"word": pa.array(one + other, pa.string()), "near": pa.array(other + one, pa.string()), "near_n": pa.array(n_other + n_one, pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(tidy(meet), "word string, near string, near_n long")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, over at most `longest` of them, twice as far each time."""
    at = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < longest:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        reach *= 2
    return at


def group(docs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of `docs`.

    A form is the most frequent near word, if it is at least `factor` times as frequent; roots follow forms to the last.
    """
    words = cut(counted_words(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    close = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    known = cut(
        words.join(near, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(close, F.col("best.near")).alias("form"), F.when(close, -F.col("best.less")).alias("form_n"))
    )
    most = known.agg(F.max("form_n")).first()[0] or 0
    longest = 0
    while factor > 1 and factor**longest <= most:  # each form is `factor` times as frequent as the word before
        longest += 1
    followed = roots(known.filter(F.col("form").isNotNull()).select("word", "form"), longest)
    return known.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
