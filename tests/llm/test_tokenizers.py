"""Pieces and alignments against the libraries and brute force, with odd texts and small tables of odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import alignment, bpe, piece

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, pairs int, key int"


@pytest.fixture(scope="module")
def pieces():
    return piece.codec(B)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def tokens():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def packed(x):
    return np.array(x, "<u4").tobytes()


def odd_text(r):
    odd = ["a", " ", "  ", "\n", "▁", "é", "中", "𝕏", "\t", "</s>", "<s>", "<|endoftext|>", "the", "ing", "'s", "--", "****", " " * r.randint(1, 40), "\0", "<0x41>", "ˁ", "́", "𞤀"]
    if r.random() < 0.3:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(0, 200)))
    return "".join(r.choice(odd) for _ in range(r.randint(0, 40)))


def test_pieces_are_exact(pieces, library):
    r = random.Random(5)
    for _ in range(3000):
        text = odd_text(r)
        want = library.encode(text)
        assert ids(pieces.encode_rows([text])[0]) == want
        assert pieces.decode(packed([1, *want, 2])).decode() == library.decode([1, *want, 2]) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_pieces_of_any_text(rows):
    c, library = piece.codec(B), sentencepiece.SentencePieceProcessor(model_file=B)
    assert [ids(x) for x in c.encode_rows(rows)] == [library.encode(x) for x in rows]


def test_any_ids_are_decoded_as_the_library_does(pieces, library):
    r = random.Random(6)
    for _ in range(3000):
        some = [r.randrange(3, 259) if r.random() < 0.4 else r.randrange(32000) for _ in range(r.randint(0, 12))]
        assert pieces.decode(packed(some)).decode() == library.decode(some)


def test_long_words_are_linear(pieces, library):
    text = "".join(random.Random(7).choice("abcdefgh") for _ in range(300_000))
    assert ids(pieces.encode_rows([text])[0]) == library.encode(text)
    assert len(text) > piece.LONG and piece.BLANK + text not in pieces.memo


def test_memo_of_words_moves_over(pieces, monkeypatch):
    monkeypatch.setattr(piece, "MEMO", 20)
    texts = [" ".join(f"w{i}{k}" for k in range(15)) for i in range(8)] * 2
    first = pieces.encode_rows(texts)
    assert first == pieces.encode_rows(texts) and len(pieces.memo) <= 20 + 15


def test_classes_are_those_of_the_tokenizer(tokens):
    c = bpe.codec(A)
    for low in range(0, 0x110000, 0x800):
        text = "".join(f"a{chr(x)}1{chr(x)} {chr(x)}'s" for x in range(low, low + 0x800, 7) if not 0xD800 <= x < 0xE000)
        assert ids(c.encode_rows([text])[0]) == tokens.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = ["the", "naïve", "encoding", "Über", "x1", "'s", "中文", "—"]
    texts = [odd_text(r) for _ in range(40)] + [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(30)]
    texts += [None, "", " ", "▁", "a ▁ b", "one", "one", " ".join(words * 300)]
    out = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pieces_by_document(docs, rows, spark, library):
    want = Counter()
    for r in rows:
        some = [1, *library.encode(r[1] or ""), 2]
        want[r[0], len(some), hashlib.sha256(packed(some)).hexdigest(), hashlib.sha256(library.decode(some).encode()).hexdigest()] += 1
    got = piece.encode(docs, B)
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got.collect()) == want
    assert all(len(x.ids) == x.n_tokens for x in got.collect())
    assert piece.encode(spark.createDataFrame([], SCHEMA), B).count() == 0


def aligned_by_hand(rows, tokens, library):
    """Two pointers over both sides' ends; counts of links over all rows."""
    spelled = {i: t for t, i in bpe.ranks_of(A).items()}

    def of_piece(i):
        t = library.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if library.is_byte(i) else t.replace("▁", " ").encode()

    seen, found = Counter(), []
    for doc_id, text, *_ in rows:
        a = tokens.encode(" " + text, add_special_tokens=False).ids if text else []
        b = library.encode(text) if text else []
        if text and b"".join(map(of_piece, b)) != (" " + text).encode():
            a, b = [], []
        links, groups, i, j, x, y = [], [([], [])] if a else [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = x + len(spelled[a[i]]), y + len(of_piece(b[j]))
            if end_a <= end_b:
                groups[-1][0].append(a[i])
                i, x = i + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(b[j])
                j, y = j + 1, end_b
            if end_a == end_b and i < len(a):
                groups.append(([], []))
        seen.update(links)
        found.append((doc_id, a, b, links, ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups), len(groups)))
    best = Counter()
    for (_, y), n in seen.items():
        best[y] = max(best[y], n)
    return Counter(
        (d, len(a), len(b), n, len(links), sum(seen[x] == best[x[1]] for x in links), sum(seen[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if a else "", g)
        for d, a, b, links, g, n in found
    )


def as_counter(frame):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in frame.collect())


def test_alignment(docs, rows, spark, tokens, library):
    assert as_counter(alignment.link_counts(docs, A, B, groups=True)) == aligned_by_hand(rows, tokens, library)
    assert alignment.link_counts(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    nothing = alignment.link_counts(docs.filter(F.col("text").isNull()), A, B).collect()
    assert len(nothing) == 2 and {(r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in nothing} == {(0, 0, 0, "")}


def test_long_texts_are_aligned_in_spans(docs, rows, tokens, library, monkeypatch):
    p = alignment._pair(A, B)
    text = " ".join(odd_text(random.Random(i)).replace("▁", "_") for i in range(80))
    one, two = (np.array(x, np.int64) for x in (tokens.encode(" " + text, add_special_tokens=False).ids, library.encode(text)))
    whole = p.align(one, two)
    monkeypatch.setattr(alignment, "SPAN", 64)
    spans = list(p.spans(one, two))
    assert len(spans) > 10
    for side in (0, 1):
        assert np.concatenate([s[side] for s in spans]).tolist() == (one, two)[side].tolist()
    assert np.concatenate([p.align(*s)[0] for s in spans]).tolist() == whole[0].tolist()
    long = [r for r in rows if r[1] and len(r[1]) > 1000]
    frame = docs.filter(F.length("text") > 1000)
    assert long and as_counter(alignment.link_counts(frame, A, B, groups=True)) == aligned_by_hand(long, tokens, library)


def test_counts_are_found_over_many_shards(spark):
    r = np.random.default_rng(4)
    keys = [r.integers(0, 50, n) << 32 | r.integers(0, 40, n) for n in (0, 3, 400, 900, 2000)]
    frame = spark.createDataFrame([([int(k) for k in x], [1 + i % 3 for i in range(len(x))]) for x in keys], "pairs array<long>, times array<int>").repartition(4)
    want = Counter()
    for x in keys:
        for i, k in enumerate(x):
            want[int(k)] += 1 + i % 3
    shards = alignment.shards_of(alignment.partial_counts(frame))
    asked = np.array(sorted({*want, 7, 1 << 40}), np.int64)
    assert len(shards.shards) > 1
    assert shards.counts(asked).tolist() == [want.get(int(k), 0) for k in asked]
    for b in range(50):
        assert shards.best[b] == max(n for k, n in want.items() if k >> 32 == b)


def test_partitions_send_keys_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 4)
    monkeypatch.setattr(alignment, "SENT", 8)
    frame = spark.createDataFrame([([i, i + 1, i + 2], [1, 2, 3]) for i in range(40)], "pairs array<long>, times array<int>").coalesce(1)
    got = Counter()
    for r in alignment.partial_counts(frame).collect():
        got[r.key] += r.n
    want = Counter()
    for i in range(40):
        want.update({i: 1, i + 1: 2, i + 2: 3})
    assert got == want


def test_names_of_special_tokens_are_plain_text(pieces, library):
    assert ids(pieces.encode_rows(["</s>"])[0]) == library.encode("</s>") and 2 not in ids(pieces.encode_rows(["</s>"])[0])
    assert pieces.encode_rows([""]) == [b""] and pieces.decode(b"") == b""
