"""Chunks by tokens against the tokenizer itself: sizes, overlaps, nothing lost, characters as before."""

import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.functions import arrow
from folioscan.functions import text as T
from folioscan.operators import chunks
from folioscan.plans import registry_ingest

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def count():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def text_of(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["river", "Überlauf", "中文", "x" * r.randint(1, 90), "2024", "and", "<|endoftext|>", "naïve"])
    out = ""
    for _ in range(r.randint(1, 120)):
        out += word() + r.choice([" ", " ", " ", ". ", ", ", "; ", "\n", "\n\n", "。"])
    return out


@pytest.mark.parametrize("size, overlap", [(20, 5), (60, 20), (60, 0), (500, 100)])
def test_sizes_overlaps_and_nothing_lost(count, size, overlap):
    for seed in range(25):
        text = text_of(seed)
        parts = arrow.split_recursively(text, size, overlap, count=arrow.token_counter(PATH))
        assert all(count(p) <= size for p in parts) and all(p in text for p in parts)
        at = 0
        for p in parts:  # in order, with only white space between
            place = next(i for i in range(len(text)) if text.startswith(p, i) and (i >= at or i + len(p) > at))
            assert place <= at or not text[at:place].strip()
            shared = text[place:at] if place < at else ""
            assert count(shared) <= overlap + 1
            at = max(at, place + len(p))
        assert not text[at:].strip()


def test_parts_are_filled(count):
    text = " ".join(["river"] * 1000)
    parts = arrow.split_recursively(text, 50, 10, count=arrow.token_counter(PATH))
    assert {count(p) for p in parts[1:-1]} == {50} and len(parts) == 1 + -(-(1000 - 50) // 40)


def test_characters_without_a_tokenizer():
    text = text_of(3)
    assert arrow.split_recursively(text, 80, 20) == arrow.split_recursively(text, 80, 20, count=lambda parts: [len(p) for p in parts])
    assert all(len(p) <= 80 or not re.search(r"\s", p) for p in arrow.split_recursively(text, 80, 20))


def test_chunks_of_a_table(spark, count):
    texts = [text_of(1) * 8, "short", "  ", None]
    d = spark.createDataFrame([(i, "s", 1, t) for i, t in enumerate(texts)], "doc_idx long, source string, page int, text string")
    got, _ = chunks.chunks_with_parents(d, "token", structure=False, size=100, overlap=10, tokenizer=PATH)
    rows = sorted((r.chunk_id, r.doc_idx, r.text) for r in got.collect())
    assert [r[0] for r in rows] == list(range(len(rows))) and {r[1] for r in rows} == {0, 1} and all(count(r[2]) <= 100 for r in rows) and len(rows) > 3


def test_chunks_without_the_blanks_at_their_ends_fit(count):
    """Capitals without the blank before them have more tokens than with it."""
    for text in (" ".join(["Thor"] * 900), " ".join(["ÈEAU!!", "QUE.!!", "Ououçre", "DENKEITKEIT!!"] * 200)):
        for size, overlap in ((500, 100), (40, 10), (7, 3)):
            parts = arrow.split_recursively(text, size, overlap, count=arrow.token_counter(PATH))
            assert max(map(count, parts)) <= size
            assert set(text.split()) <= set(" ".join(parts).split()) or size < 10


def test_only_what_is_split_goes_to_python(spark, monkeypatch):
    """Whole parents stay in the JVM."""
    seen = spark.createDataFrame([(0, "s", 1, "a b. " * 400), (1, "s", 1, "short")], "doc_idx long, source string, page int, text string")
    cut = chunks.chunks(chunks.semantic_parents(seen), hard_max=1 << 30)
    assert sorted(r.doc_idx for r in cut.collect()) == [0, 1]
    plan = chunks.chunks(chunks.semantic_parents(seen))._jdf.queryExecution().optimizedPlan().toString()
    assert any("CASE WHEN" in line and "split(" in line and "split(text" not in line for line in plan.splitlines())


ODD = ["a", "B", "é", "中", "1", "²", "Ⅷ", "'s", "'", "'ll", ".", "...", ",", "-", "_", " ", " ", " ", "  ", "\n", "\t", "\r", "\xa0", "\u3000", "\x1c", "\x85", "\u200b", "\u180e", "\ufeff", "<|endoftext|>", "😀", "\u0301", "\x00", "𝒜"]


def test_words_are_counted_as_the_tokenizer_does(count):
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    assert arrow.token_counter(PATH)(texts) == list(map(count, texts))


def test_words_are_encoded_once(monkeypatch):
    """A word that comes again is looked up, whatever text it stands in, and no text is encoded whole."""
    asked = []

    class Watched(arrow._Counted):
        def __init__(self, encode, *more):
            super().__init__(lambda s: asked.append(s) or encode(s), *more)

    monkeypatch.setattr(arrow, "_Counted", Watched)
    seen = arrow.token_counter.__wrapped__(PATH)
    text = " ".join(["river", "Überlauf", "and."] * 400)
    arrow.split_recursively(text, 50, 10, count=seen)
    assert 0 < len(asked) <= 10 and max(map(len, asked)) < 12


def test_words_are_forgotten_when_there_are_many(count, monkeypatch):
    monkeypatch.setattr(arrow, "WORDS", 3)
    texts = ["a b c d e f, g. a b", "x" * 100 + " a x"]
    assert arrow.token_counter.__wrapped__(PATH)(texts) == list(map(count, texts))


def test_other_tokenizers_count_whole_texts():
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [text_of(i) for i in range(5)]
    assert arrow.token_counter(path)(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_chunks_by_tokens_splits_within_rows(spark, tmp_path, count):
    """Each document is split once and nothing is shuffled; sizes are those of the chunks as they are."""
    texts = [text_of(1) * 30, "short", "  ", None, text_of(2) * 3]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry_ingest.chunks_by_tokens(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
    assert sorted(map(tuple, df.collect())) == [(0, True, True), (1, True, True), (4, True, True)]
    cut = chunks.sized_parts(chunks.block_parents(spark.createDataFrame([(0, "s", 1, texts[0])], "doc_idx long, source string, page int, text string"), structure=False), PATH, 100, 10).first()
    assert cut.parts == arrow.split_recursively(texts[0].strip(), 100, 10, count=arrow.token_counter(PATH)) and cut.sizes == list(map(count, cut.parts))


def test_strip_as_the_pattern_does(spark):
    r = random.Random(2)
    rows = [("".join(r.choice([*T.WHITE, "a", "é", "中", "\x1c", "\u200b", "\u180e", "\ufeff", "\x00"]) for _ in range(r.randint(0, 9))),) for _ in range(3000)] + [(None,), ("",)]
    d = spark.createDataFrame(rows, "t string")
    assert d.where(T.strip(F.col("t")) != F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", "")).count() == 0
