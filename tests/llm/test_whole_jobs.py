"""Registered queries and stages do the whole job: what a cut would change."""

import re
from collections import Counter

import numpy as np
import pytest

from folioscan.llm import components, exchange, lm, outliers, queries, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def backoff_by_hand(texts, order):
    words = [WORD.findall(t or "") for t in texts]
    counts = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())
    for w in words:
        score, less = 0.0, 0
        for i in range(len(w)):
            reach = min(i, order - 1)
            k = next(k for k in range(reach, -1, -1) if k == 0 or counts[k][tuple(w[i - k : i + 1])] >= 2)
            score += np.log(counts[k][tuple(w[i - k : i + 1])] / (counts[k - 1][tuple(w[i - k : i])] if k else total) * 0.4 ** (reach - k))
            less += k < reach
        yield len(w), less, round(score, 3)


TEXTS = ["a b c d a b c", "a b c e", "b c d a b", "x y z", "y z x y z", "a b", "q", "", None, "d a b c d a b x", "a b c d a b c"]


def test_backoff_counts_three_words(spark, tmp_path):
    lines = list(enumerate(TEXTS))
    spark.createDataFrame(lines, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_backed_off, round(r.log_score, 3)) for r in queries.op9_backoff(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(backoff_by_hand(TEXTS, 3)))


@pytest.mark.parametrize("order", [1, 4, 5])
def test_backoff_passes(spark, order):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_backed_off, round(r.log_score, 3)) for r in lm.scores(docs, order=order).collect()}
    assert got == dict(enumerate(backoff_by_hand(TEXTS, order)))


def prose(seed, first, n, source, length):
    r = np.random.default_rng(seed)
    return [(first + i, " ".join("x" * int(k) for k in r.integers(1, length, r.integers(25, 90))), "en", source) for i in range(n)]


def verdicts(spark, lines):
    docs = spark.createDataFrame(lines, "doc_id long, text string, lang string, source string").coalesce(2)
    return {r.doc_id: (r.kept, round(r.distance, 4)) for r in outliers.rules(docs).collect()}


def test_rules_of_a_source_do_not_depend_on_other_sources(spark, monkeypatch):
    monkeypatch.setattr(outliers, "MAX_OWN", 4, raising=False)  # was a cap on the groups with an estimate
    one = prose(1, 0, 60, "small", 6)
    alone = verdicts(spark, one)
    assert sum(kept for kept, _ in alone.values()) > 50
    many = one + prose(2, 1000, 300, "a", 14) + prose(3, 2000, 300, "b", 20) + prose(4, 4000, 60, "c", 25)
    among = verdicts(spark, many)
    assert {i: among[i] for i in alone} == alone
    monkeypatch.setattr(outliers, "BLOCK", 2)  # estimates found a few at once are the same
    assert verdicts(spark, many) == among
    monkeypatch.setattr(outliers, "FEW", 1)  # and groups joined by their names
    assert verdicts(spark, many) == among


def test_rows_without_an_id_are_dealt_to_many_batches(spark):
    lines = [(None, f"text number {i} of many without an id {i % 7}") for i in range(400)] + [(5, f"same id {i}") for i in range(100)]
    rows, n = exchange.batched(spark.createDataFrame(lines, "doc_id long, text string"), batch_bytes=500)
    sizes = [r["count"] for r in rows.groupBy("batch").count().collect()]
    assert n > 20 and max(sizes) < 60
    got = substring.removal(spark.createDataFrame(lines[:50] + [(1, "a b c d e f g h i j k l m"), (None, "a b c d e f g h i j k l m n")], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got if r.n_removed) == [(14, 13)]


def test_every_pair_that_shares_three_positional_bytes_is_linked(spark):
    """Passages replaced move all bits alike: a sample of the index's keys misses some of these pairs."""
    r = np.random.default_rng(8)
    texts = []
    for _ in range(80):
        w = r.integers(0, 100000, 300).astype(str).tolist()
        texts += [" ".join(w), " ".join(w[:130] + r.integers(0, 100000, 32).astype(str).tolist() + w[162:])]
    raw = [t.encode() for t in texts]
    v = simhash.wide_fingerprints_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw]))[-4:].T
    x = np.ascontiguousarray(v[::2] ^ v[1::2])
    linked = ((x.view(np.uint8) == 0).sum(axis=1) >= 3) & (np.bitwise_count(x).sum(axis=1) <= 45)
    got = {c.doc_id: c.component_id for c in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert linked.sum() > 50 and [got[2 * i + 1] == 2 * i for i in range(80)] == linked.tolist()


def test_links_of_near_copies_grow_with_their_number(spark):
    """Each list has a forest of its own: over all lists a group's links must not come near its pairs."""
    r = np.random.default_rng(11)
    base, n = r.integers(0, 256, 32).astype(np.uint8), 600
    rows = np.repeat(base[None], n, axis=0)
    for x in rows:
        x[r.permutation(32)[:14]] ^= (1 << r.integers(0, 8, 14)).astype(np.uint8)  # 14 bits of its own
    lines = [(i, *x.tolist()) for i, x in enumerate(np.ascontiguousarray(rows).view(np.int64))]
    entries = spark.createDataFrame(lines, "node long, v0 long, v1 long, v2 long, v3 long")
    links = simhash.alike(entries).distinct()
    assert links.count() <= 30 * n and {c.component for c in components.components(links).collect()} == {0} and components.components(links).count() == n


def test_an_entry_is_posted_once_for_each_first_position():
    """Each posting carries the whole fingerprint of 32 bytes: 240 of them, one for each pair, were several times the input."""
    v = np.random.default_rng(12).integers(0, 1 << 63, (5, 4)).astype(np.uint64)
    key, node, words = simhash.wide_postings(np.arange(5), v)
    assert len(key) == len(node) == len(words) <= 32 * 5 and len(set(zip(key.tolist(), node.tolist()))) == len(key)
    data = words.view(np.uint8)
    assert (data[np.arange(len(key)), key >> 8] == (key & 255)).all()
