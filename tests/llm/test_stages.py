"""Each stage of the pipeline on odd rows, clashing columns and empty tables; the defined result of each case."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, score double, g int, kept boolean, u long, words string"


def good(r, n=220):
    words = ["harbour", "Fähre", "winter", "market", "señal", "letters", "granite", "evening", "copper", "through", "against", "seldom", "carried", "the", "of", "and", "a", "to", "in"]
    return ". ".join(" ".join(f"{r.choice(words)}{r.choice(['', '', 's', 'ly'])}" for _ in range(11)) for _ in range(n // 11)) + "."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    texts = [good(r) for _ in range(24)] + [None, "", " \n\t", "one", "spam " * 400, "x" * 30_000, good(r) * 20]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None, 9, 0.5, 3, False, 1, "clash") for i, t in enumerate(texts)]
    out += [out[2], (None, texts[5], "en", "s", 4, 0, 0.0, 0, True, 0, ""), (None, None, None, None, None, None, None, None, None, None, None), (90, texts[3], "en", "s", 1, 0, 0.0, 0, True, 0, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(frame):
    return Counter(tuple(r) for r in frame.select(*cp.COLUMNS).collect())


@pytest.mark.parametrize("k", [0, 1])
def test_filters_keep_rows_as_they_are(spark, docs, nothing, k):
    stage = cp.STAGES[k][1]
    out = stage(spark, docs, SF)
    assert tuple(out.columns) == cp.COLUMNS and not plain(out) - plain(docs)
    assert stage(spark, nothing, SF).count() == 0
    if k == 1:  # few words fail the base rules, repeated rows share a verdict
        kept = plain(out)
        assert not any(len((t or "").split()) < 20 for _, t, *_ in kept) and all(kept[x] in (0, n) for x, n in plain(docs).items())


def test_one_of_each_group_stays(spark, docs, nothing):
    stage = cp.STAGES[2][1]
    out = stage(spark, docs, SF)
    kept, before = plain(out), plain(docs)
    assert tuple(out.columns) == cp.COLUMNS and not kept - before and stage(spark, nothing, SF).count() == 0
    ids = Counter(x[0] for x in kept.elements())
    assert ids[None] == 2 and all(n == 1 for d, n in ids.items() if d is not None)  # rows without an id all stay
    assert 90 not in ids and ids[3] == 1  # an exact copy: the smallest id stays
    assert sum(not (t or "").split() for d, t, *_ in kept.elements() if d is not None) == 1  # null, empty and blank are one group


def test_passages_go_from_later_documents(spark, docs, nothing):
    stage = cp.STAGES[3][1]
    out = stage(spark, docs, SF)
    found = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert tuple(out.columns) == cp.COLUMNS and out.count() == docs.count() and stage(spark, nothing, SF).count() == 0
    assert found[90] == "" and found[24] == "" and len(found[3]) > 1000  # a copy loses all and stays; null becomes empty
    gone = [r.text for r in out.where("doc_id IS NULL").collect()]
    assert gone == ["", ""]  # a null id counts as the largest: its copied text goes
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_every_row_is_packed(spark, docs, nothing):
    stage = cp.STAGES[4][1]
    out = stage(spark, docs, SF).collect()
    assert stage(spark, nothing, SF).count() == 0
    whole = Counter()
    for r in out:
        whole[r.doc_id] += r.length
    sizes = {r.doc_id: r.doc_tokens for r in out}
    assert whole[24] == whole[25] == whole[26] == 1 and whole[2] == 2 * sizes[2] and set(whole) == {r[0] for r in docs.select("doc_id").collect()}
