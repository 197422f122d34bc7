"""Operators on small tables against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import bpe, components, forest, licences, lm, outliers, packing, quality, simhash, substring, warc
from folioscan.llm.licence_texts import MIT

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, score double, u long, g int"


def make_texts():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts = base + base[:12] + [b + " tail end" for b in base[5:20]]
    shared = " ".join(r.choice(words) for _ in range(30))
    texts += [f"{r.choice(words)} {shared} {r.choice(words)}\n{r.choice(words)}" for _ in range(10)]
    texts += [None, "", " \t\n", "one", "a a a a a a a a a a a a a a a a", "a a a a a a a a a a a a a a a a a a", "x " * 14, "Über ÉTÉ naïve ß", "word " * 3000, None, ""]
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None, 7, 0.5, 1, 2) for i, t in enumerate(make_texts())]
    out += [out[3], out[70]]  # repeated rows
    return out + [(None, out[4][1], "en", "s1", None, 0, 0.0, 0, 0), (None, "no id " * 9, None, None, None, 0, 0.0, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def removed_by_hand(rows, width=13):
    words = [WORD.findall(r[1] or "") for r in rows]
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    least = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for r, i, w in zip(rows, ids, words):
        gone = {j for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_substring(docs, rows, nothing):
    want = removed_by_hand(rows)
    got = substring.removal(docs, keep=("lang",), text=True).collect()
    assert key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == key(w[:4] for w in want)
    assert key((r.doc_id, " ".join(WORD.findall(r.text))) for r in got) == key((w[0], w[4]) for w in want)
    whole = {r[0]: r[1] or "" for r in rows}
    assert all(r.text == whole[r.doc_id] for r in got if r.n_removed == 0 and r.doc_id is not None)
    assert any(w[2] for w in want) and substring.removal(nothing).count() == 0


def test_near_duplicates(docs, rows, nothing):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {r.fingerprint: int(r.fingerprint, 16) for r in got}
    ids = defaultdict(list)
    for r in got:
        ids[r.fingerprint].append(r.doc_id)
    names = list(fp)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    group = defaultdict(list)
    for n in names:
        group[find(n)] += [i for i in ids[n] if i is not None]
    for r in got:
        assert r.component_id == min(group[find(r.fingerprint)], default=None)
    kept = simhash.one_of_each(docs, ("doc_id", "text")).collect()
    want = {r.component_id for r in got} - {None}
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter(want) and sum(r.doc_id is None for r in kept) == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing, ("doc_id",)).count() == 0


def shingle_sets(text, width=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def test_similar_texts(spark, nothing):
    """Groups at a five-word similarity of 0.8 or more against brute force; unlike texts stay apart."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(60, 400))) for _ in range(120)]
    for i in range(60):  # near copies with a word changed in about 70, and in about 15
        w = texts[i].split()
        for k in r.sample(range(len(w)), max(1, len(w) // (70 if i < 40 else 15))):
            w[k] = r.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3].upper(), texts[4], None, "", " \n", "two words", "Two  words", "two other"]
    lines = [(i, t, i % 3, 1) for i, t in enumerate(texts)] + [(4, texts[4], 1, 1), (7, "another text of row seven " * 9, 1, 1), (None, texts[5], 0, 1)]
    docs = spark.createDataFrame(lines, "doc_id long, text string, node int, key int").repartition(4)
    got = {x.doc_id: x.component_id for x in simhash.similar(docs).collect() if x.doc_id not in (None, 7)}
    sets = {i: shingle_sets(t) for i, t in enumerate(texts)}
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    close = [(i, 120 + i) for i in range(60) if i != 7 and j(i, 120 + i) >= 0.8]
    assert len(close) >= 35 and all(got[a] == got[b] for a, b in close)
    assert all(got[120 + i] == 120 + i for i in range(40, 60) if j(i, 120 + i) < 0.4) and all(got[i] == i for i in range(120) if i != 7)
    assert got[180] == 3 and got[181] == 4 and got[182] == got[183] == got[184] == 182 and got[185] == got[186] == 185 and got[187] == 187
    kept = simhash.one_of_similar(docs, ("doc_id", "text", "key")).collect()
    ids = Counter(x.doc_id for x in kept)
    assert ids[4] == ids[7] == ids[3] == ids[None] == 1 and set(ids) - {None, 7} == set(got.values()) - {7} and simhash.one_of_similar(nothing, ("doc_id", "text")).count() == 0
    assert {x.text for x in kept if x.doc_id == 7} <= {texts[7], lines[-2][1]}


def test_bits_are_counted_over_any_number_of_shingles(monkeypatch):
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 2000).astype(np.uint64)
    edges = np.array([0, 0, 1, 255, 511, 511, 2000])
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = [bits[a:b].sum(axis=0).tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert simhash.bit_counts(h, edges).tolist() == want
    text = " ".join(f"a{i % 97}" for i in range(500)).encode()
    data, offs = np.frombuffer(text + b"one two", np.uint8), np.array([0, len(text), len(text) + 7])
    one, wide = simhash.fingerprints_of(data, offs), simhash.wide_fingerprints_of(data, offs)
    monkeypatch.setattr(simhash, "TOGETHER", 7)  # a long text is hashed in parts
    assert simhash.fingerprints_of(data, offs).tolist() == one.tolist() and simhash.wide_fingerprints_of(data, offs).tolist() == wide.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (103, 102), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_bpe(docs, rows, nothing):
    got = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert key((r.doc_id, r.decoded_sha256) for r in got) == key((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)
    assert bpe.encode(nothing, P.path("byte_bpe_multi_50k.tiktoken")).count() == 0


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(docs, rows, nothing, size):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs, path, size).collect()
    t = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [packing.END]
        want += [(r[0], s, len(ids[s : s + size]), zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), size)]
    assert key(tuple(r)[:5] for r in got) == key(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(by) == list(range(len(by))) and len(by) <= 1.1 * sum(r.length for r in got) / size + 1
    assert packing.pack(nothing, path).count() == 0


def test_backoff(docs, rows, nothing):
    words = [WORD.findall(r[1] or "") for r in rows]
    for order in (1, 2, 3):
        counts = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        total = sum(counts[0].values())
        want = []
        for r, w in zip(rows, words):
            score, less = 0.0, 0
            for i in range(len(w)):
                reach = min(i, order - 1)
                for k in range(reach, -1, -1):
                    n = counts[k][tuple(w[i - k : i + 1])]
                    if k == 0 or n >= 2:
                        score += np.log((n / (counts[k - 1][tuple(w[i - k : i])] if k else total)) * 0.4 ** (reach - k))
                        less += k < reach
                        break
            want.append((r[0], len(w), less, round(score, 4)))
        got = lm.scores(docs, order=order).collect()
        assert key((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 4)) for r in got) == key(want)
    assert all(r.mean_log_score is None for r in got if not r.n_words) and lm.scores(nothing).count() == 0


def test_rules(spark, nothing, monkeypatch):
    r = random.Random(1)
    lines = []
    for i in range(900):
        words = [r.choice(["alpha", "be", "gamma", "of", "delta", "to"]) + r.choice("abcdefgh") for _ in range(r.randint(25, 200))]
        if i % 30 == 0:
            words = [w + "$$$" for w in words]
        lines.append((i, " ".join(words), ["en", "de", None][i % 3], "big" if i % 2 else f"s{i % 50}", 0))
    lines += [(900, None, "en", "big", 0), (901, "", None, None, 0), (902, "few words", "en", "big", 0), (903, "again " * 60, "en", "big", 0)]
    monkeypatch.setattr(outliers, "MIN_ROWS", 60)
    docs = spark.createDataFrame(lines, "doc_id long, text string, lang string, source string, g int").repartition(4)
    got = {x.doc_id: x for x in outliers.rules(docs).collect()}
    assert len(got) == len(lines)
    assert {i for i, x in got.items() if x.base_failed} == {900, 901, 902, 903}
    assert all(not got[i].kept for i in range(0, 900, 30)) and not any(got[i].kept for i in range(900, 904))
    assert np.mean([got[i].kept for i in range(900) if i % 30]) > 0.995
    kept = outliers.accepted(docs, ("doc_id", "text", "lang", "source")).select("doc_id").collect()
    assert sorted(x.doc_id for x in kept) == sorted(i for i, x in got.items() if x.kept)
    assert outliers.rules(nothing).count() == 0 and outliers.accepted(nothing, ("doc_id", "text", "lang", "source")).count() == 0


def plain_estimate(x, words, weight=None):
    """The determinant estimate of one group by numpy over its rows: two starts, steps on the nearest three quarters."""
    found = []
    order = np.sort(np.floor(x * 64), axis=0)
    low, mid, high = (order[int(np.ceil(q * len(x) / 4)) - 1] for q in (1, 2, 3))
    for c, v in (((mid + 0.5) / 64, np.diag(((high - low) / 64 / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(outliers.STEPS):
            cell = outliers._cells(plain_distances(x, words, c, v))
            core = x[cell <= np.sort(cell)[int(np.ceil(outliers.CORE * len(x))) - 1]]
            c, v = core.mean(axis=0), outliers._FACTOR * np.cov(core.T, bias=True)
        typical = np.exp(c[-1])
        found.append((np.linalg.slogdet(v + np.diag(outliers.SAMPLING / typical + outliers.TINY))[1], c, v))
    return min(found, key=lambda f: f[0])[1:]


def plain_distances(x, words, c, v):
    return np.array([(a - c) @ np.linalg.inv(v + np.diag(outliers.SAMPLING / n + outliers.TINY)) @ (a - c) for a, n in zip(x, words)])


def test_rules_match_a_plain_estimate_for_every_group(spark):
    """`kept` with production constants: large groups, groups of a few documents, groups of a language of its own."""
    r = np.random.default_rng(4)
    lines = []
    for lang, source, n, longest in [("en", "a", 220, 9), ("en", "b", 70, 14), ("en", "c", 9, 6), ("en", None, 1, 5), ("de", "a", 60, 11), (None, "a", 7, 8), (None, "d", 55, 12)]:
        for i in range(n):
            words = ["x" * int(k) for k in r.integers(1, longest, r.integers(25, 90))]
            if i % 17 == 3:
                words = [w + "%" for w in words]
            lines.append((len(lines), " ".join(words) + "\nsame line" * int(r.integers(1, 4)), lang, source))
    docs = spark.createDataFrame(lines, "doc_id long, text string, lang string, source string").repartition(5)
    got = {a.doc_id: a for a in outliers.rules(docs).collect()}
    rows = outliers.document_statistics(docs).orderBy("doc_id").toPandas()
    n = rows.n_words.to_numpy(float)
    x = np.stack([np.log(rows.word_chars / n), np.sqrt(rows.n_symbols / n), np.sqrt(rows.n_dup_lines / n), np.sqrt(rows.n_repeat_words / n), np.log(n)], axis=1)
    ok = ~rows.base_failed.to_numpy()
    every, by_lang = plain_estimate(x[ok], n[ok]), {}
    blend = lambda own, up, size: tuple(min(1, size / 50) * a + (1 - min(1, size / 50)) * b for a, b in zip(own, up))
    limit = outliers.chi2_quantile(1 - outliers.REJECT, 5)
    seen = 0
    for lang, source in dict.fromkeys((a[2], a[3]) for a in lines):
        of_lang = ok & np.array([a[2] == lang for a in lines])
        by_lang.setdefault(lang, blend(plain_estimate(x[of_lang], n[of_lang]), every, of_lang.sum()))
        group = of_lang & np.array([a[3] == source for a in lines])
        c, v = blend(plain_estimate(x[group], n[group]), by_lang[lang], group.sum())
        d = plain_distances(x[group], n[group], c, v)
        mine = np.array([got[i].distance for i in np.flatnonzero(group)])
        assert np.allclose(d, mine, rtol=1e-4, atol=1e-5), (lang, source)
        assert [got[i].kept for i in np.flatnonzero(group)] == (d <= limit).tolist()
        seen += (d > limit).sum()
    assert seen >= 15


def test_classifier(spark, nothing):
    r = random.Random(2)
    lines, labels = [], []
    for i in range(500):
        words = [r.choice(["alpha", "be", "gamma", "of", "delta", "to", "psi"]) for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        lines.append((i, " ".join(w + "$$" if bad else w for w in words), 0.1))
        labels.append((i, 0 if bad else 1, None))
    lines += [(500, None, 0.1), (501, "", 0.1), (502, "x" * 200_000, 0.1)]
    labels += [(7, 1, 0), (None, 1, 0), (9999, 0, 0), (500, None, 1)]
    docs = spark.createDataFrame(lines, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.classify(docs, marks).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(500) if got[i].held_out] == held
    assert np.mean([got[i].predicted == (i % 5 != 0) for i in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values()) and got[500].score == got[501].score
    assert sorted(x.doc_id for x in quality.accepted(docs, marks, ("doc_id", "text")).collect()) == sorted(i for i, x in got.items() if x.predicted)
    one = quality.classify(docs, marks.where("quality = 1")).select("score").distinct().collect()
    none = quality.classify(docs, marks.limit(0)).select("score").distinct().collect()
    assert [x.score for x in one] == [1.0] and [x.score for x in none] == [0.5]
    assert quality.classify(nothing, marks).count() == 0


def test_classifier_is_a_plain_convolution():
    """Pooled responses of rows of all lengths, and of one long row in spans, against loops over bytes."""
    r = np.random.default_rng(3)
    texts = [b"", b"a", b"ab ab ab ab", bytes(r.integers(0, 256, 64, np.uint8)), bytes(r.integers(97, 100, 65, np.uint8)), b"xyz" * 60, bytes(r.integers(97, 101, 777, np.uint8))]
    net = quality.Network(5)
    table, lagged = net.table(), net.p["lagged"]
    want = []
    for t in texts:
        sym = list(t) + [quality.PAD] * 2000
        best = None
        for c in range(0, max(1, -(-(len(t) - 64) // 16) + 1)):
            at = 16 * c
            z = sum(table[k][sym[at + k]].astype(np.float64) for k in range(64))
            for lag in range(1, 33):
                n = sum(sym[at + k : at + k + 3] == sym[at + k + lag : at + k + lag + 3] and quality.PAD not in sym[at + k + lag : at + k + lag + 3] for k in range(64))
                z = z + n / 16 * lagged[lag - 1]
            best = z if best is None else np.maximum(best, z)
        want.append(best)
    expected = np.maximum(np.array(want) + net.p["bias"], 0) @ net.p["out"] + net.p["last"][0]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(net.logits(table, data, offs), expected, atol=1e-3)
    for most in (16, 100, 5000):
        assert np.allclose([net.long_logit(table, np.frombuffer(t, np.uint8), most)[0] for t in texts], expected, atol=1e-3)


def test_nearest(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 24)).astype(np.float32)
    x[250:260] = x[0]
    x[260] = 2 * x[1]
    lines = [(i, v.tolist()) for i, v in enumerate(x)]
    lines += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] + [1.0] * 23), (304, [None] + [1.0] * 23), (350, [float("inf")] * 24), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (3, x[3].tolist()), (None, x[5].tolist())]
    v = spark.createDataFrame([(*a, 1, 2) for a in lines], "vec_id long, embedding array<float>, rank int, rep int")
    got = defaultdict(list)
    for a in forest.nearest(v, F.col("vec_id") % 50 == 0).collect():
        got[a.query_id].append((a.rank, a.vec_id, a.score))
    assert sorted(got) == [0, 50, 100, 150, 200, 250, 400]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in (0, 50, 100, 150, 200, 250):
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        want = np.lexsort((np.arange(300), -s))[:5].tolist()
        mine = [b for _, b, _ in sorted(got[q])]
        hits += len(set(want) & set(mine))
        assert [a for a, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5] and all(abs(c - s[b]) < 1e-9 for _, b, c in got[q])
    assert hits >= 28 and [b for _, b, _ in sorted(got[0])] == [250, 251, 252, 253, 254] and [b for _, b, _ in sorted(got[250])] == [0, 251, 252, 253, 254]
    assert [(a, b) for a, b, _ in got[400]] == [(1, 401)]
    assert forest.nearest(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_licences(spark, nothing):
    own = "Copyright (c) 2020 Some One\n\n" + MIT.replace(",", " ,").upper().replace("SUBLICENSE", "sublicence")
    texts = [own, "MIT Licence\n\n" + MIT, MIT + " more", None, "", "Hello.\nReleased under the MIT License.\nLicenced under the Apache License, Version 2.0!", "copyright notice and this"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, form string, licence_id string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [got[i].licence_id for i in range(7)] == ["MIT", "MIT", None, None, None, None, None]
    assert got[5].notices == ["Apache-2.0", "MIT"] and got[3].n_words == got[4].n_words == 0 and got[3].notices == [] and got[6].n_words == 4
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and licences.scan(nothing).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "r"), (2, None, None, "r"), (1, "http://a/", "<p>x</p>", "r")], "page_id long, url string, html string, record_id string")
    got = warc.derivatives(warc.responses_of_pages(pages)).collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 4
    by = {(r.page_id, r.warc_type): r for r in got}
    one = list(warc.parse(bytes(by[1, "conversion"].record)))
    assert one[0][1] == b"x" and one[0][0]["WARC-Record-ID"] == by[1, "conversion"].record_id and by[1, "metadata"].refers_to == by[1, "conversion"].refers_to
    assert by[2, "conversion"].target_uri is None and by[2, "conversion"].content_length == 0
    assert warc.derivatives(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.dtypes == docs.select(*cp.COLUMNS).dtypes
        if k < 3:
            assert after.exceptAll(docs.select(*cp.COLUMNS)).count() == 0
        if k == 3:
            want = {w[0]: w[4] for w in removed_by_hand([(r.doc_id, r.text) for r in docs.collect()])}
            assert {r.doc_id: " ".join(WORD.findall(r.text)) for r in after.collect()} == want
        docs = after
    before = spark.read.parquet(f"{tmp_path}/3")
    assert docs.select("doc_id").distinct().count() == before.count()
    assert key(tuple(r) for r in cp.run(spark, sf).collect()) == key(tuple(r) for r in docs.collect())
