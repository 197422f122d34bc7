"""SentencePiece encoding (merges with byte fallback) and decoding by a table of prefixes.

Blanks become U+2581 and one is put in front, as the model's normaliser does.  For every prefix of a word the table holds
the one token that its encoding ends with.  An automaton reports every piece that ends at a place; it is the last token of
that prefix if it and the last token of the prefix before it are compatible, that is, if merging the two pieces'
characters together gives just these two.  Exactly one piece passes, so one look over the matches fills the table, and the
ids are read from it backwards: linear in the word, however long.  A character without a piece has no entry; it merges
with nothing, and its UTF-8 bytes stand for it.

Merges go by score, best first, and from the left where scores are equal (runs of blanks share one score in public models).

Cases: a null text is empty; an empty text has the begin and end ids alone; the names of control pieces in a text are
ordinary text; repeated rows are encoded each; U+2581 in a text is decoded to a blank, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import as_arrow, buffers, pieces

BLANK = "▁"
#: Entries of each of the two generations of a worker's memo of words; longer words don't stay in it.
MEMO, LONG = 400_000, 64
NEVER = 1 << 40


class Pieces:
    """Encoder and decoder for a model file of merges with byte fallback, no normalisation but of blanks, no user-defined pieces."""

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in every]
        self.text = [model.id_to_piece(i) for i in every]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(model.is_unused(i) for i in every) or not all(map(model.is_byte, self.bytes)):
            raise ValueError("a model with byte pieces and without unused ones is needed")
        self.ids = {self.text[i]: i for i in every if not special[i]}
        if any(BLANK in t.lstrip(BLANK) or "\n" in t for t in self.ids):
            raise ValueError("pieces may hold blanks only in front, and no line ends")
        scores = sorted({model.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: Place of a piece's score among all; equal scores share one.
        self.rank = {t: order[model.get_score(i)] for t, i in self.ids.items()}
        self.parts: dict[str, tuple[str, str]] = {}
        self.edges: dict[str, tuple[list[str], list[str]]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if len(t) == 1 or self._made(t):
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        out = [t.replace(BLANK, " ").encode() for t in self.text]
        for i in every:
            if model.is_control(i):
                out[i] = b""
            elif model.is_unknown(i):
                out[i] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            out[i] = bytes([b])
        self.out = out
        self.words = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.memo = _Memo(self)

    def _made(self, piece: str) -> bool:
        """Whether the merges of a piece's own characters give it; remembers the last two parts."""
        parts = list(piece)
        while len(parts) > 2:
            ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in self.rank]
            if not ranked:
                return False
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if any(len(p) > 1 and self.rank[p] > self.rank[piece] for p in parts):
            raise ValueError(f"the parts of {piece!r} come after it")
        self.parts[piece] = (parts[0], parts[1])
        return True

    def _edges(self, piece: str) -> tuple[list[str], list[str]]:
        """What stands at the right and at the left edge of a piece as its merges go on, from character to whole."""
        if (known := self.edges.get(piece)) is None:
            known = ([piece], [piece])
            if len(piece) > 1:
                left, right = self.parts[piece]
                known = (self._edges(right)[0] + [piece], self._edges(left)[1] + [piece])
            self.edges[piece] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces gives just these two.

        A merge across the border comes first if it ranks before the next merge at the left piece's edge, or not after the
        next one at the right piece's edge: of equal ranks the leftmost goes first.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            left, right = self._edges(self.text[a])[0], self._edges(self.text[b])[1]
            i = j = 0
            known = True
            while True:
                after_left = self.rank[left[i + 1]] if i + 1 < len(left) else NEVER
                after_right = self.rank[right[j + 1]] if j + 1 < len(right) else NEVER
                across = self.rank.get(left[i] + right[j], NEVER)
                if across < after_left and across <= after_right:
                    known = False
                    break
                if after_left == after_right == NEVER:
                    break
                if after_left <= after_right:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_word(self, word: str) -> array:
        whole = self.ids.get(word)
        if whole is not None and word in self.parts:
            return array("i", [whole])
        last = array("i", [-1]) * (len(word) + 1)  # by length of prefix; -1: it ends with a character without a piece
        known = self.pairs.get
        for end, (token, length) in self.automaton.iter(word):
            if last[end + 1] >= 0:
                continue
            before = last[end + 1 - length]
            ok = before < 0 or known(before << 32 | token)
            if ok is None:
                ok = self.compatible(before, token)
            if ok:
                last[end + 1] = token
        return self._backwards(word, last)

    def _backwards(self, word: str, last: array) -> array:
        out, n = array("i"), len(word)
        while n:
            token = last[n]
            if token < 0:
                out.extend(self.bytes[b] for b in reversed(word[n - 1].encode("utf-8", "surrogatepass")))
                n -= 1
            else:
                out.append(token)
                n -= len(self.text[token])
        out.reverse()
        return out

    def encode_rows(self, rows: list[str]) -> list[bytes]:
        """Each row's ids as little-endian unsigned 32-bit integers, without begin and end."""
        out = []
        for row in rows:
            words = self.words.findall(BLANK + row.replace(" ", BLANK)) if row else []
            out.append(b"".join(map(self.memo.__getitem__, words)))
            if len(self.memo) > MEMO:
                self.memo = _Memo(self, dict(self.memo))
        return out

    def spelled(self, ids: bytes) -> bytes:
        """What the pieces stand for, joined: the text after the blank in front."""
        return b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8: a blank that the first piece leads with goes, and each byte that is part of no character becomes U+FFFD."""
        raw = self.spelled(ids)
        text = raw.decode("utf-8", "surrogateescape")
        if not text.isascii():
            text = re.sub("[\udc80-\udcff]", "\ufffd", text)
        first = next((i for i in np.frombuffer(ids[:64], "<u4").tolist() if self.out[i]), None)
        return (text[1:] if first is not None and self.text[first].startswith(BLANK) else text).encode()


class _Memo(dict):
    """Ids by word; `older` is the generation before, from which what is still in use moves over."""

    def __init__(self, codec: Pieces, older: dict[str, bytes] | None = None):
        self.codec, self.older = codec, older or {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is None:
            ids = np.frombuffer(self.codec.encode_word(word), np.intc).astype("<u4").tobytes()
        if len(word) <= LONG:
            self[word] = ids
        return ids


_CODECS: dict[str, Pieces] = {}


def codec(path: str) -> Pieces:
    """One codec for each model file in a worker's life."""
    if path not in _CODECS:
        _CODECS[path] = Pieces(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Rows of `keep` with n_tokens, ids (array of int with begin and end, if asked for), ids_sha256 and decoded_sha256.

    `model` is a path that every executor can open (part of the installed software, not data).
    A map over the rows: no shuffle; a worker holds one Arrow batch, cut into parts of bounded text.
    """
    kept = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (c.begin, c.end))
        for batch in batches:
            _, offs = buffers(batch.column(batch.num_columns - 1))
            for a, b in pieces(offs):
                part = batch.slice(a, b - a)
                packed = [begin + x + end for x in c.encode_rows([x or "" for x in part.column(part.num_columns - 1).to_pylist()])]
                sizes = [len(x) // 4 for x in packed]
                columns = {k: part.column(i) for i, k in enumerate(keep)} | {"n_tokens": pa.array(sizes, pa.int64())}
                if ids:
                    flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
                columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in packed])
                columns["decoded_sha256"] = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in packed])
                yield as_arrow(**columns)

    types = dict(kept.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"])
    return kept.mapInArrow(run, schema)
