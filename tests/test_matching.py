"""Needles in texts against a plain search, in one list and in blocks."""

import random

from folioscan.operators import matching

SCHEMA = "id long, grp string, text string"


def frames(spark, seed=3):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé ") for _ in range(r.randint(0, n)))
    texts = [(i, r.choice(["x", "y"]), word(60)) for i in range(120)] + [(120, "x", None), (121, None, "ab"), (122, "x", ""), (3, "y", "ab ab"), (None, "x", "ab")]
    needles = [(r.choice(["x", "y", "z"]), word(4)) for _ in range(60)] + [("x", "ab"), ("x", "ab"), ("y", ""), ("x", None), (None, "a"), ("x", "b")]
    want = sorted(((i, g, n) for i, g, t in texts if t is not None and g is not None for n in {n for h, n in needles if h == g and n is not None} if n in t), key=str)
    return spark.createDataFrame(texts, SCHEMA).repartition(3), spark.createDataFrame(needles, "grp string, needle string"), want


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_containing(spark, monkeypatch):
    texts, needles, want = frames(spark)
    assert want and found(matching.containing(texts, needles)) == want
    monkeypatch.setattr(matching, "TEXTS", 500)
    assert found(matching.containing(texts, needles, most=200)) == want


def test_nothing_to_find(spark):
    texts, needles, _ = frames(spark)
    assert matching.containing(texts, needles.limit(0)).collect() == [] and matching.containing(texts.limit(0), needles).collect() == []
    assert matching.containing(texts.limit(0), needles, most=50).collect() == []
