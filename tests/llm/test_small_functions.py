"""Brute-force and round-trip tests of what runs inside the workers."""

import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscan.llm import bpe, common, exchange, forest, lm, outliers, packing, quality, simhash, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = " \n\t\r\x0b\x1c\x85\xa0''stremdvl abcXYZ é²½٣漢字 。,!?​　😀\x00ÀÉßİΣς#$|"


def odd_texts(n, seed=1, alphabet=ODD):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", None, " ", "a" * 3000, " " * 500, "ab" * 2000, "one"]


def test_words_of_bytes():
    texts = odd_texts(300)
    data, offs = common.buffers(pa.array(texts))
    starts, ends, first = common.word_spans(data, offs)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == WORD.findall(t or "")
    a, b = common.span_hashes(data, starts, ends), common.span_hashes(data, starts, ends, 1)
    words = [raw[x:y] for x, y in zip(starts, ends)]
    assert len(set(words)) == len(set(a.tolist())) == len(set(b.tolist())) and (a != b).all()


def test_pieces_cover_rows():
    offs = np.array([0, 0, 5, 50, 51, 52, 60])
    assert list(common.pieces(offs, 10)) == [(0, 2), (2, 3), (3, 6)]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_is_exact(codec):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [t or "" for t in odd_texts(1500)] + ["'s", "x's  'll 've ", "\n\n a", "a  \n", "''s", " 's", "<|endoftext|>"]
    for t, ids in zip(rows, codec.encode_rows(rows)):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_bpe_round_trip(rows):
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    assert [c.decode(x).decode() for x in c.encode_rows(rows)] == rows


def test_bpe_memo_moves_over(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    rows = ["alpha beta gamma delta epsilon zeta", "alpha eta", "alpha beta"]
    assert [codec.encode_rows([r])[0] for r in rows] == codec.encode_rows(rows)


def test_word_encoder_is_exact():
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [x or "" for x in odd_texts(1500)] + ["<|endoftext|> hi", "'S It'S THEY'RE", "é ́x", "12345"]
    for r, ids in zip(rows, packing.Encoder(path).encode_rows(rows)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(r, add_special_tokens=False).ids


def test_plain_chunks_are_merged_together_and_not_one_by_one(monkeypatch):
    path = P.path("word_bpe_49k.json")
    library, asked = Tokenizer.from_file(path), []

    class Library:
        model = property(lambda self: self)

        def tokenize(self, word):
            asked.append(word)
            return library.model.tokenize(word)

        def encode(self, chunk, **how):
            asked.append(chunk)
            return library.encode(chunk, **how)

        @staticmethod
        def from_file(_):
            return Library()

    monkeypatch.setattr(packing, "Tokenizer", Library)
    r = np.random.default_rng(8)
    letters = np.array(list("aaabcdeeeilmnoorsttuvxyzABZ0123456789'''.,-!(#~|ÀÖØéßöøÿ"))
    words = ["".join(r.choice(letters, n)) for n in r.integers(1, packing.LONG + 1, 3000)]
    words += ["it's", "don't've", "we'll", "'sure", "''s", "5's", "x'", "'", "'l", "'r", "y'rex", "!'t", "a" * 64, "é" * 64, "'s" * 32, "9" * 64]
    rows = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(path).encode_rows(rows)]
    assert not asked
    assert got == [library.encode(x, add_special_tokens=False).ids for x in rows]


def test_packing_memo_moves_over(monkeypatch):
    path = P.path("word_bpe_49k.json")
    rows = [x or "" for x in odd_texts(400)] + ["alpha beta gamma " + "z" * 70 + " eta", "", "alpha " + "z" * 70, " \x1c alpha\x1fbeta \x1d", "beta eta"]
    for name, n in (("MEMO", 5), ("MERGED", 2), ("COPIED", 3)):
        monkeypatch.setattr(packing, name, n)
    e = packing.Encoder(path)
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(rows), 3) for x in e.encode_rows(rows[i : i + 3])]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert got == [t.encode(x, add_special_tokens=False).ids for x in rows]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_histogram_packing(histogram):
    fill, ranks = Counter(), Counter()
    at = {}
    for length, rank, count, first, offset in packing.pack_histogram(histogram, 64):
        assert rank == ranks[length]
        ranks[length] += count
        for s in range(first, first + count):
            assert at.setdefault(s, 0) == offset
            at[s] += length
            fill[s] += length
    assert ranks == Counter(histogram) and all(v <= 64 for v in fill.values()) and sorted(fill) == list(range(len(fill)))
    # worst fit leaves at most one pack less than half full
    assert sum(v <= 32 for v in fill.values()) <= 1


def slow_fingerprint(t):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    texts = odd_texts(300) + ["a b c", "A B C D", "x  y\tz\nw v"]
    data, offs = common.buffers(pa.array(texts))
    assert simhash.fingerprints_of(data, offs).tolist() == [slow_fingerprint(t) for t in texts]


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bits", [0, 2, 4, 5])
def test_index_loses_no_link(bits):
    r = np.random.default_rng(bits)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]]))
    want = roots(len(fp), [(i, j) for i in range(len(fp)) for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits) + i + 1).tolist()])
    used, size = simhash.shape(bits)
    from itertools import combinations

    found = []
    for chosen in combinations(range(used), size):
        key = sum(((fp >> np.uint64(8 * i)) & np.uint64(255)) << np.uint64(8 * k) for k, i in enumerate(chosen)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        u, v = simhash.links_of(key[order], fp[order], np.arange(len(fp))[order], bits)
        found += list(zip(u.tolist(), v.tolist()))
    assert roots(len(fp), found) == want


@pytest.mark.parametrize("short", [2, 16])
def test_wide_index_loses_no_link(short, monkeypatch):
    """Chains of entries that share exactly three positional bytes, entries that share two, and close copies."""
    monkeypatch.setattr(simhash, "SHORT", short)
    r = np.random.default_rng(4)

    def moved(x, bytes_, bits):
        """Each of so many bytes changed, by so many bits in all."""
        at = r.permutation(32)[:bytes_]
        flips = [1 << r.integers(0, 8) for _ in at]
        for i in r.permutation(bytes_)[: bits - bytes_]:
            flips[i] |= (flips[i] << 1 & 255) or 1
        y = x.copy()
        y[at] ^= np.array(flips, np.uint8)
        return y

    rows = [r.integers(0, 256, 32).astype(np.uint8) for _ in range(12)]
    for x in rows[:]:
        for _ in range(4):
            rows += [moved(x, 29, 40), moved(x, 30, 40), moved(x, 29, 46), *(moved(x, 1, 1) for _ in range(10))]
        rows += [moved(rows[-1], 29, 45), moved(rows[-1], 29, 29)]
    v = np.unique(np.stack(rows), axis=0).view(np.uint64)
    x = v[:, None] ^ v[None]
    near = ((x.view(np.uint8) == 0).sum(axis=-1) >= 3) & (np.bitwise_count(x).sum(axis=-1) <= 45)
    want = roots(len(v), np.argwhere(near).tolist())
    keys, nodes, words = simhash.wide_postings(np.arange(len(v)), v)
    order = np.lexsort((nodes, keys))
    a, b = simhash.alike_links(keys[order], nodes[order], words[order])
    assert near[a, b].all() and roots(len(v), zip(a.tolist(), b.tolist())) == want and 12 < len(set(want)) < len(v) / 2


def test_forest_of_a_list_is_connected():
    fp = np.array([0, 1, 3, 7, 0xFF00, 0xFF01, 1 << 60], np.uint64)
    u, v = simhash.forest(fp, np.array([5, 4, 3, 2, 1, 0, 9]), 1)
    assert roots(10, list(zip(np.concatenate(u).tolist(), np.concatenate(v).tolist())))[:6] == [0, 0, 2, 2, 2, 2]


def test_interior_symbols_are_consistent():
    """Equal windows get the same symbol, whatever stands around them."""
    r = np.random.default_rng(3)
    for _ in range(200):
        w = r.integers(0, 4, 13).astype(np.uint64)
        symbols = set()
        for _ in range(6):
            left, right = r.integers(0, 5, r.integers(0, 9)).astype(np.uint64), r.integers(0, 5, r.integers(0, 9)).astype(np.uint64)
            h = np.concatenate([left, w, right])
            symbols.add(int(substring.interior_symbols(h, np.array([0, len(h)]), np.array([len(left)]))[0]))
        assert len(symbols) == 1


def test_sorted_keys_and_places_round_trip():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()
    n = r.integers(0, 1 << 40, 1000)
    assert (lm.unpack_counts(lm.pack_counts(n)) == n).all()
    doc, row, word = np.sort(r.integers(-(1 << 62), 1 << 62, 99)), np.sort(r.integers(0, 1 << 20, 99)).astype(np.int32), r.integers(0, 1 << 20, 99).astype(np.int32)
    for a, b in zip(exchange.unpack_places(exchange.pack_places(doc, row, word)), (doc, row, word)):
        assert (a == b).all()
    mixed = np.sort(common.mix(np.arange(5000, dtype=np.uint64)))
    for n in (1, 7, 64):
        found, start, stop = exchange.cut_by_bucket(mixed, n)
        for b, a, e in zip(found.tolist(), start.tolist(), stop.tolist()):
            assert lm._bucket_span(mixed, b, n) == (a, e)


def slow_statistics(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics():
    r = random.Random(5)
    texts = odd_texts(300) + ["".join(r.choice(["a ", "b ", "\n", "$", "é ", "\r"]) for _ in range(r.randint(0, 300))) for _ in range(200)] + ["x\nx\n x\nx", "\n\n", "a b c d e f g h a b c d e f g h"]
    data, offs = common.buffers(pa.array(texts))
    got = outliers.statistics(data, offs)
    assert list(zip(*(got[k].tolist() for k in outliers.STATISTICS))) == [slow_statistics(t) for t in texts]


def test_chi2():
    assert abs(outliers.chi2_cdf(11.0705, 5) - 0.95) < 1e-5 and abs(outliers.chi2_quantile(0.999, 5) - 20.515) < 1e-3


def test_quality_symbols_cover_the_text():
    texts = ["", "a", "x" * 64, "x" * 65, "one one two", "é " * 100]
    sym, place, first = quality.symbols(*common.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        at = place[first[i] : first[i + 1]]
        joined = np.unique((at[:, None] + np.arange(quality.CHUNK)).ravel())
        assert sym[joined][: len(t.encode())].astype(np.uint8).tobytes() == t.encode()
        assert (sym[joined][len(t.encode()) :] == quality.PAD).all()


def test_gradients():
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    made = []
    for t in ("abc " * 40, "$$$ xyz", "hello world again"):
        sym, place, _ = quality.symbols(*common.buffers(pa.array([t])))
        made.append((sym, place, quality.repeats(sym, place).astype(np.float64)))
    y = np.array([1.0, 0, 1])

    def loss():
        t = net.table()
        out = []
        for sym, place, again in made:
            z = (sum(t[k][sym[place + k]] for k in range(quality.CHUNK)) + again @ net.p["lagged"]).max(axis=0) + net.p["bias"]
            out.append(np.maximum(z, 0) @ net.p["out"] + net.p["last"][0])
        s = 1 / (1 + np.exp(-np.array(out)))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = net._gradients(made, y)
    for name, at in (("filters", (3, 2, 1)), ("embed", (97, 3)), ("lagged", (3, 4)), ("out", (4,)), ("bias", (4,)), ("last", (0,))):
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3


def test_prefixes():
    a, b = np.array([0b1010, 0, 7], np.uint32), np.array([0b1011, 0, 7 | 1 << 29], np.uint32)
    assert forest._shared(a, b).tolist() == [forest.DEPTH - 1, forest.DEPTH, 0]


def test_forest_candidates_by_brute_force():
    r = np.random.default_rng(2)
    keys = r.integers(0, 1 << 30, (5, 300), dtype=np.uint32)
    order = np.argsort(keys, axis=1)
    ordered = np.take_along_axis(keys, order, axis=1)
    queries = r.integers(0, 1 << 30, (5, 7), dtype=np.uint32)
    queries[:, 3] = keys[:, 17]
    for want in (1, 10, 100, 300):
        got = forest.candidates(ordered, order, queries, want)
        for q in range(7):
            shared = np.stack([forest._shared(keys[t], np.full(300, queries[t, q])) for t in range(5)]).max(axis=0)
            depth = max(d for d in range(31) if (shared >= d).sum() >= want)
            assert np.flatnonzero(got[q]).tolist() == np.flatnonzero(shared >= depth).tolist()


def test_long_pieces_of_bpe_are_matched_in_windows(monkeypatch):
    c = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"))
    r = np.random.default_rng(3)
    pieces_ = [bytes(r.integers(97, 103, n, np.uint8)) for n in (5, 63, 64, 65, 700)] + [b"ab" * 300, b"aaaa" * 90, "äöüß".encode() * 40]
    whole = [c.encode_piece(p) for p in pieces_]
    monkeypatch.setattr(bpe, "WINDOW", 64)
    assert [c.encode_piece(p) for p in pieces_] == whole and [c.decode(np.array(w, "<u4").tobytes()) for w in whole] == pieces_
    c.encode_rows(["short words", "x" * 1000])
    assert all(len(k) <= bpe.LONG for k in c.memo)


def test_packing_memo_keeps_short_chunks_only():
    e = packing.Encoder(P.path("word_bpe_49k.json"))
    text = "abc " + "y" * 5000 + " def " + "ü" * 900
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode_rows([text])[0], "<u4").tolist() == want == np.frombuffer(e.encode_rows([text])[0], "<u4").tolist()
    assert all(len(k) <= packing.LONG for k in e.memo)


def test_hashes_of_long_texts_are_those_of_short_ones(monkeypatch):
    r = np.random.default_rng(2)
    data = r.integers(97, 123, 30_000).astype(np.uint8)
    data[r.integers(0, 20_000, 2500)] = 32  # the last word is long
    offs = np.array([0, 12_000, len(data)])
    starts, ends, _ = common.word_spans(data, offs)
    want = [common.span_hashes(data, starts, ends, w) for w in (0, 1)]
    joined = common.joined_words(data, starts, ends)
    monkeypatch.setattr(common, "CHUNK_BYTES", 500)
    for w in (0, 1):
        assert (common.span_hashes(data, starts, ends, w) == want[w]).all()
        assert common.span_hashes(data, starts[-1:], ends[-1:], w) == want[w][-1:]
    got = common.joined_words(data, starts, ends)
    assert got[0] == joined[0] and (got[1] == joined[1]).all() and (got[2] == joined[2]).all()


def test_forest_recall_with_production_constants():
    """Nearly isotropic vectors against brute force, at several sizes; candidates stay well below half and their share falls."""
    r = np.random.default_rng(8)
    shares = []
    for n in (1000, 4000, 9000):
        x = r.normal(size=(n, 64))
        x[n // 2 :] = 0.45 * x[: n - n // 2] + r.normal(size=(n - n // 2, 64))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        asked = np.arange(0, n, 50)
        s = unit @ unit[asked].T
        best = [set(np.lexsort((np.arange(n), -s[:, q]))[:6].tolist()) for q in range(len(asked))]
        found = forest.search_block(x, np.arange(n), x[asked], unit.mean(axis=0), 6)
        assert np.mean([len(best[q] & set(i.tolist())) / 6 for q, i, _ in found]) >= 0.9
        keys = forest.strings(unit, forest.rotations(64), unit.mean(axis=0))
        order = np.argsort(keys, axis=1, kind="stable")
        shares.append(forest.candidates(np.take_along_axis(keys, order, axis=1), order, keys[:, asked], forest.wanted(n, 6)).mean())
    assert shares[0] < 0.5 and shares[1] < 0.4 and shares[2] < 0.35 and shares[2] < shares[0]


def test_forest_keeps_ties():
    """More vectors at one cosine than any first selection would hold: ties go to the smaller ids."""
    r = np.random.default_rng(9)
    one = r.normal(size=64)
    x = np.concatenate([np.outer(2.0 ** r.integers(-3, 4, 200), one), r.normal(size=(300, 64))])
    ids = r.permutation(500)
    (_, got, score), = forest.search_block(x, ids, one[None], np.zeros(64), 6)
    assert got.tolist() == np.sort(ids[:200])[:6].tolist() and np.allclose(score, 1)


def test_warc_records():
    page = "<html lang='de'><head><title>A &amp; B</title><style>x{}</style></head><body><h1>Hi</h1><p>a<b>b</b>c&nbsp; d</p><script>no()</script><a href='/x'>link</a><!-- no --></body></html>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-A: 1\r\n\r\n" + page.encode()
    records = warc.derived("<urn:uuid:1>", "http://e/", warc.DATE, block)
    data = b"".join(warc.serialised(f, b) for _, _, f, b in records)
    (m, mb), (c, cb) = warc.parse(data)
    assert (m["WARC-Type"], c["WARC-Type"]) == ("metadata", "conversion")
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == "<urn:uuid:1>" and m["WARC-Target-URI"] == "http://e/"
    assert cb.decode() == "Hi\nabc d\nlink" and c["WARC-Block-Digest"] == warc.digest(cb)
    text = mb.decode()
    assert "title: A & B\r\n" in text and "lang: de\r\n" in text and "outlink: /x\r\n" in text and "source-http-x-a: 1\r\n" in text
    assert f"source-payload-digest: {warc.digest(page.encode())}" in text and f"source-block-digest: {warc.digest(block)}" in text


def test_warc_bodies():
    gz = zlib.compressobj(wbits=31)
    body = gz.compress(b"hello") + gz.flush()
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.http_parts(head + chunked)[1] == b"hello"
    assert warc.http_parts(b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nbroken")[1] == b"broken"
    assert warc.http_parts(b"no header")[1] == b"no header" and warc.http_parts(b"")[1] == b""
    assert [k for _, k, _, _ in warc.derived("<x>", None, warc.DATE, b"")] == ["metadata", "conversion"]
