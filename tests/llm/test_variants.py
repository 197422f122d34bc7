"""Spelling variants against brute force: counts, pairs one edit apart, forms and roots, hot groups, odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscan.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, key int"
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def counted_by_hand(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def edits(word):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for c in ALPHABET:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]


def grouped_by_hand(rows):
    n = counted_by_hand(rows)
    near = {w: {x for x in edits(w) if x in n and x != w} for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def found(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows(seed, base=30, size=120):
    """Texts of a few words, their variants of one edit in falling numbers, and other letters, digits and signs between."""
    r = random.Random(seed)
    words = ["".join(r.choice("abnéöÀ") for _ in range(r.randint(6, 12))) for _ in range(base)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "abababa", "Ünderline", "çççççççç", "×÷×÷×÷×÷"]
    pool = []
    for w in words:
        some = r.sample(sorted(set(edits(w))), 12)
        pool += [w] * 60 + [x for k, x in enumerate(some) for _ in range(k % 6)]
    rows = []
    for i in range(size):
        picked = [r.choice(pool) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", ", ", "-", "1", "\n"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in picked)))
    return [*rows, rows[3], (None, rows[4][1]), (None, None), (size, None), (size + 1, ""), (size + 2, "short words only")]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = odd_rows(seed)
    want = grouped_by_hand(rows)
    assert found(variants.group(frame_of(spark, rows))) == want
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)


def test_no_words(spark):
    for rows in ([], [(1, None), (None, ""), (2, "a b c")], [(3, "singular")]):
        assert variants.group(frame_of(spark, rows)).collect() == []


def test_roots_follow_every_form(spark):
    text = {"maincase": 3000, "maincose": 250, "maimcose": 22, "maimcosx": 2, "otherword": 40, "otherwird": 4, "solitary": 9}
    rows = [(10**6 + i, " ".join([w] * n)) for i, (w, n) in enumerate(text.items())]
    want = grouped_by_hand(rows)
    assert found(variants.group(frame_of(spark, rows))) == want
    assert len({r[2] for r in want if r[0].startswith("mai")}) == 1


def test_hot_groups_are_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(variants, "HOT", 5)
    monkeypatch.setattr(variants, "TOGETHER", 16)
    r = random.Random(9)
    words = {f"xqzjwk{''.join(r.choice('abcd') for _ in range(r.randint(3, 5)))}" for _ in range(150)}
    rows = [(i, " ".join(sorted(words))) for i in range(3)]
    assert found(variants.group(frame_of(spark, rows))) == grouped_by_hand(rows)


def test_partitions_send_words_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "SENT", 10)
    rows = odd_rows(3)
    assert {r.word: r.n for r in variants.counted_words(frame_of(spark, rows)).collect()} == counted_by_hand(rows)


def test_long_runs():
    a, b = "ab" * 4000, "ab" * 3999 + "b"
    keys, step = variants.postings([b, a, a[:-1] + "c"])
    assert sorted(variants.near_in_group([b, a, a[:-1] + "c"], keys, step)) == [(1, 0), (2, 1)]


def test_merging_loses_no_candidate():
    r = random.Random(10)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randint(1, 15))) for _ in range(r.randint(3, 9))]
        bound = r.randint(1, len(lists))
        count = Counter(x for y in lists for x in y)
        assert variants.merged(list(lists), bound) == sorted(x for x, n in count.items() if n >= bound)


def test_one_edit():
    r = random.Random(11)
    for _ in range(500):
        a = "".join(r.choice("ab") for _ in range(r.randint(5, 8)))
        b = "".join(r.choice("ab") for _ in range(len(a) + r.randint(0, 1)))
        assert variants.one_edit(a, b) == (b in set(edits(a)) and a != b)


def test_every_near_pair_meets_once(spark):
    r = np.random.default_rng(12)
    words = sorted({"".join(r.choice(list("aeiort"), n)) for n in r.integers(7, 10, 1500)})
    near = variants.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    known = set(words)
    assert Counter((x.word, x.near) for x in near) == Counter((w, x) for w in words for x in set(edits(w)) if x in known and x != w)
