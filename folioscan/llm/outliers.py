"""Quality rules: base rules, then robust multivariate outliers of text statistics.

Each document's statistics are transformed to five numbers.  For each language and source the minimum covariance
determinant estimate is found by concentration steps: the three quarters of the group's documents nearest in
Mahalanobis distance give the next mean and covariance, from two starts (medians with quartile scales; mean and
covariance of all), and the start that ends with the smaller determinant is kept.  Documents farther than the cutoff
are rejected.

A document's own sampling variance is added to its group's covariance: four statistics are means and square roots of
shares over its words, so chance alone moves them by `SAMPLING` over the number of words (a word's length has a
variation of about a half, a square root of a Poisson share a variance of a quarter, repeated words come in runs of eight).
Most groups have no symbol or repeated line in the core, so without it one symbol would be infinitely far out.

Every group has its own estimate.  That of a group of n documents under `MIN_ROWS` is blended with its language's, own by
n / MIN_ROWS, and a small language's likewise with that of all documents: there is no size at which an estimate jumps.

Everything is counted over all documents.  A step is two aggregations that are combined in each task before they are
shuffled: a histogram of distances, whose cell edge is the group's limit, and the moments of the documents within it.
A hot source is thus never gathered in a task.  Steps run for at most `BLOCK` estimates at once, which bounds what the
driver collects; what it keeps and broadcasts of each estimate is 240 bytes and its name.

Cases: a null, empty or blank text has no word and fails the base rules, and failed documents don't enter estimates; a
null language or source is a value like any other; equal texts of a group get equal verdicts; a group without spread
has only the sampling variance and `TINY`; an empty table gives no
rows; further columns are ignored; a text of any length is hashed in bounded parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import SPACE, as_arrow, buffers, chain, cut, mix, pieces, release, span_hashes, union_lengths, window_starts, word_spans

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 20, 30
#: Estimates that are found at once, and groups whose names are broadcast (some 10 MB); more are joined by their names.
BLOCK, FEW = 8192, 100_000
#: Documents from which a group's estimate is its own alone, ten for each statistic.
MIN_ROWS = 50
#: Share of a group that gives its estimate, and concentration steps.
CORE, STEPS = 0.75, 8
#: For one word, the sampling variance of each transformed statistic: log word length, symbols a word, repeated lines a
#: word, repeated words (square roots of shares), log words.
SAMPLING = np.array([0.25, 0.25, 0.25, 2.0, 0.0])
#: Keeps covariances regular in numbers.
TINY = 1e-6
#: The chance that a document of a normal group is rejected.  Of 17,242 labelled clean documents of check_s that pass the
#: base rules 44 were beyond 1e-3 and 5 beyond 1e-4, and 1,371 of 1,397 labelled bad ones were beyond either.
REJECT = 1e-4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    starts, ends, first = word_spans(data, offs)
    rows = len(offs) - 1

    def per_row(flag: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[edges[1:]] - total[edges[:-1]]

    word = np.repeat(np.arange(rows), np.diff(first))
    at = window_starts(first, WINDOW)
    with np.errstate(over="ignore"):
        key = chain(span_hashes(data, starts, ends), WINDOW)[at] + mix(word[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = union_lengths(at[again], WINDOW, len(starts))

    stop = np.union1d(np.flatnonzero(data == 10), offs[1:])  # ends of lines
    begin = np.concatenate([[0], np.where(data[np.minimum(stop, len(data) - 1)] == 10, stop + 1, stop)])[: len(stop)] if len(data) else np.zeros(len(stop), np.int64)
    begin = np.maximum(begin, 0)
    some = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[some], stop[some]
    line_row = np.searchsorted(offs, begin, side="right") - 1
    with np.errstate(over="ignore"):
        key = span_hashes(data, begin, stop) + mix(line_row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    repeated = np.zeros(len(key), bool)
    repeated[order[1:]] = key[order[1:]] == key[order[:-1]]
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": per_row(~SPACE[data] & ((data & 0xC0) != 0x80), offs),
        "n_symbols": per_row(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(line_row[repeated], minlength=rows).astype(np.int64),
        "n_repeat_words": per_row(covered, first),
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five statistics and base_failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(3))
            for a, b in pieces(offs):
                s = statistics(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                part = batch.slice(a, b - a)
                yield as_arrow(doc_id=part.column(0), lang=part.column(1), source=part.column(2), **s)
            release()

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in STATISTICS)
    found = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, schema)
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate's number, transformed statistics, words) of a batch of (g, statistics)."""
    group, n, chars, symbols, lines, repeats = (batch.column(i).to_numpy().astype(np.float64) for i in range(6))
    n = np.maximum(n, 1)
    return group.astype(np.int64), np.stack([np.log(np.maximum(chars, 1) / n), np.sqrt(symbols / n), np.sqrt(lines / n), np.sqrt(repeats / n), np.log(n)], axis=1), n


def _distances(x: np.ndarray, words: np.ndarray, center: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, each from its own centre with its own covariance and sampling variance."""
    d = x - center
    return np.einsum("ni,ni->n", d, np.linalg.solve(cov + _noise(words), d[..., None])[..., 0])


def _noise(words: np.ndarray) -> np.ndarray:
    return (SAMPLING / words[..., None] + TINY)[..., None] * np.eye(K)


def _cells(d: np.ndarray) -> np.ndarray:
    """Distances in cells of a sixteenth of a power of two, from small to large."""
    return np.clip(np.floor(np.log2(np.maximum(d, 1e-12)) * 16), -640, 640).astype(np.int64)


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-16:
        i += 1
        term *= x / i
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


K = len(SAMPLING)
_FACTOR = CORE / chi2_cdf(chi2_quantile(CORE, K), K + 2)
_PAIRS = [(i, j) for i in range(K) for j in range(i, K)]


class Estimates:
    """Centres and covariances by (start, group)."""

    def __init__(self, groups: int, starts: int = 2):
        self.center = np.zeros((starts, groups, K))
        self.cov = np.zeros((starts, groups, K, K))

    def take_moments(self, rows, factor: float) -> None:
        for r in rows:
            s, g, n = r["s"], r["g"], r["n"]
            mean = np.array([r[f"m{i}"] for i in range(K)]) / n
            cov = np.zeros((K, K))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = r[f"m{i}_{j}"] / n - mean[i] * mean[j]
            self.center[s, g] = np.round(mean, 9)
            self.cov[s, g] = np.round(factor * cov, 9)


class Groups:
    """Numbers of the estimates: 0 for all documents, then languages, then pairs of language and source."""

    def __init__(self, stats: DataFrame):
        sizes = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")).collect()  # a row for each group
        of_lang: dict = {}
        for r in sizes:
            of_lang[r["lang"]] = of_lang.get(r["lang"], 0) + r["n"]
        self.langs = {v: 1 + i for i, v in enumerate(sorted(of_lang, key=repr))}
        names = {(r["lang"], r["source"]): r["n"] for r in sizes}
        self.pairs = {v: 1 + len(self.langs) + i for i, v in enumerate(sorted(names, key=repr))}
        self.size = np.array([sum(of_lang.values()), *[of_lang[v] for v in self.langs], *[names[v] for v in self.pairs]], np.float64)
        self.above = np.array([0, *[0] * len(self.langs), *[self.langs[v[0]] for v in self.pairs]])

    def __len__(self) -> int:
        return len(self.size)

    def number(self, stats: DataFrame) -> DataFrame:
        """`stats` with g, the number of its language and source (0 where no document of them passed), and that of its language."""
        known = stats.sparkSession.createDataFrame([(*p, g, self.langs[p[0]]) for p, g in self.pairs.items()], "l1 string, s1 string, g int, g1 int")
        known = F.broadcast(known) if len(self.pairs) <= FEW else known
        joined = stats.join(known, F.col("lang").eqNullSafe(F.col("l1")) & F.col("source").eqNullSafe(F.col("s1")), "left").drop("l1", "s1")
        return joined.withColumns({"g": F.coalesce("g", F.lit(0)), "g1": F.coalesce("g1", F.lit(0))})


def estimate(stats: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame, Groups]:
    """(centres, covariances) by group number, the statistics with their number g, and the groups."""
    groups = Groups(stats)
    joined = groups.number(stats)
    rows = joined.where(~F.col("base_failed")).select(F.explode(F.array(F.lit(0), "g1", "g")).alias("g"), *STATISTICS)
    some = lambda a: rows if len(groups) <= BLOCK else rows.where(F.col("g").between(a, a + BLOCK - 1)).withColumn("g", F.col("g") - a)
    center, cov = (np.concatenate(x) for x in zip(*[_estimate(some(a), min(BLOCK, len(groups) - a)) for a in range(0, len(groups), BLOCK)], strict=True))
    for g in range(1, len(groups)):  # languages come before their sources
        own, up = min(1.0, groups.size[g] / MIN_ROWS), groups.above[g]
        center[g], cov[g] = own * center[g] + (1 - own) * center[up], own * cov[g] + (1 - own) * cov[up]
    return center, cov, joined, groups


def _estimate(rows: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, covariances) of the groups numbered from 0."""
    context = rows.sparkSession.sparkContext
    est = Estimates(groups)

    def emit(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    # starts: quartiles of each statistic in cells of a 64th, and moments of all
    def coordinates(batches):
        for batch in batches:
            g, x, _ = _vectors(batch)
            cell = np.clip(np.floor(x * 64), -(1 << 15), 1 << 15).astype(np.int64)
            for i in range(K):
                key, n = np.unique(g << 20 | cell[:, i] + (1 << 16), return_counts=True)
                yield emit(["g", "i", "cell", "n"], [key >> 20, np.full(len(key), i), (key & ((1 << 20) - 1)) - (1 << 16), n])

    cells = rows.mapInArrow(coordinates, "g long, i long, cell long, n long").groupBy("g", "i", "cell").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy("g", "i").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.select("*", F.sum("n").over(up_to).alias("c"), F.sum("n").over(Window.partitionBy("g", "i")).alias("all"))
    quartiles = ranked.groupBy("g", "i").agg(*[F.min(F.when(4 * F.col("c") >= q * F.col("all"), F.col("cell"))).alias(f"q{q}") for q in (1, 2, 3)]).collect()
    for r in quartiles:
        est.center[0, r["g"], r["i"]] = (r["q2"] + 0.5) / 64
        est.cov[0, r["g"], r["i"], r["i"]] = ((r["q3"] - r["q1"]) / 64 / 1.349) ** 2

    def moments(limits: np.ndarray | None, only: tuple[int, ...]):
        shared = context.broadcast((est.center, est.cov, limits))

        def run(batches):
            center, cov, limit = shared.value
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                g, x, words = _vectors(batch)
                for s in only:
                    ok = np.ones(len(g), bool) if limit is None else _cells(_distances(x, words, center[s][g], cov[s][g])) <= limit[s][g]
                    columns = np.concatenate([np.ones((len(g), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in _PAIRS], axis=1)], axis=1)[ok]
                    for v in np.unique(g[ok]).tolist():
                        total[s, v] = total.get((s, v), 0) + columns[g[ok] == v].sum(axis=0)
            if total:
                values = np.stack(list(total.values()))
                yield emit(["s", "g", *names], [np.array([k[0] for k in total]), np.array([k[1] for k in total]), *values.T])

        names = ["n"] + [f"m{i}" for i in range(K)] + [f"m{i}_{j}" for i, j in _PAIRS]
        found = rows.mapInArrow(run, "s long, g long, " + ", ".join(f"{k} double" for k in names))
        return found.groupBy("s", "g").agg(*[F.sum(k).alias(k) for k in names]).collect()

    est.take_moments([r.asDict() | {"s": 1} for r in moments(None, (0,))], 1.0)
    limits = None
    for _ in range(STEPS):
        shared = context.broadcast((est.center, est.cov))

        def distances(batches, shared=shared):
            center, cov = shared.value
            for batch in batches:
                g, x, words = _vectors(batch)
                for s in (0, 1):
                    key, n = np.unique(g << 20 | _cells(_distances(x, words, center[s][g], cov[s][g])) + 1024, return_counts=True)
                    yield emit(["s", "g", "cell", "n"], [np.full(len(key), s), key >> 20, (key & ((1 << 20) - 1)) - 1024, n])

        cells = rows.mapInArrow(distances, "s long, g long, cell long, n long").groupBy("s", "g", "cell").agg(F.sum("n").alias("n"))
        up_to = Window.partitionBy("s", "g").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        ranked = cells.select("*", F.sum("n").over(up_to).alias("c"), F.sum("n").over(Window.partitionBy("s", "g")).alias("all"))
        found = ranked.where(F.col("c") >= CORE * F.col("all")).groupBy("s", "g").agg(F.min("cell").alias("cell")).collect()
        now = np.full((2, groups), 1 << 20)
        for r in found:
            now[r["s"], r["g"]] = r["cell"]
        before = (est.center.copy(), est.cov.copy())
        est.take_moments(moments(now, (0, 1)), _FACTOR)
        if limits is not None and np.allclose(before[0], est.center, atol=1e-6) and np.allclose(before[1], est.cov, atol=1e-6):
            break
        limits = now
    best = np.linalg.slogdet(est.cov + _noise(np.exp(est.center[..., -1])))[1].argmin(axis=0)
    pick = np.arange(groups)
    return est.center[best, pick], est.cov[best, pick]


def rules(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared, Mahalanobis) and kept."""
    center, cov, joined, _ = estimate(cut(document_statistics(docs)))
    shared = docs.sparkSession.sparkContext.broadcast((center, cov))
    limit = chi2_quantile(1 - reject, K)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v = shared.value
        for batch in batches:
            g, x, words = _vectors(batch)
            d = _distances(x, words, c[g], v[g])
            failed = batch.column(7).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(6), *batch.columns[1:6], batch.column(7), pa.array(d), pa.array(~failed & (d <= limit))], names=["doc_id", *STATISTICS, "base_failed", "distance", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in STATISTICS) + ", base_failed boolean, distance double, kept boolean"
    return joined.select("g", *STATISTICS, "doc_id", "base_failed").mapInArrow(run, schema)


def accepted(docs: DataFrame, columns: tuple[str, ...], reject: float = REJECT) -> DataFrame:
    """`columns` (doc_id, text, lang and source among them) of the documents that the rules keep.

    The statistics of a text are computed again where the text is read, which costs less than joining texts by id.
    """
    center, cov, _, groups = estimate(cut(document_statistics(docs)))
    shared = docs.sparkSession.sparkContext.broadcast((center, cov, groups.pairs))
    limit = chi2_quantile(1 - reject, K)
    kept = docs.select(*columns)
    at = [kept.columns.index(k) for k in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v, pairs = shared.value
        for batch in batches:
            data, offs = buffers(batch.column(at[0]))
            for a, b in pieces(offs):
                part = batch.slice(a, b - a)
                s = statistics(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                lang, source = (part.column(i).cast(pa.string()).to_pylist() for i in at[1:])
                g = pa.array([pairs.get(p, 0) for p in zip(lang, source, strict=True)], pa.int64())
                g, x, words = _vectors(as_arrow(g=g, **s))
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED * s["n_words"])
                yield part.filter(pa.array(~failed & (_distances(x, words, c[g], v[g]) <= limit)))
            release()

    return kept.mapInArrow(run, kept.schema)
