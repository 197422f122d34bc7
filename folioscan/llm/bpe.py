"""Byte-level BPE encoding and decoding without running merges over the text.

Bytes are mapped to Latin-1 characters, so that a pyahocorasick automaton over the vocabulary finds every token at
every place of a piece in one pass.  A piece's merges are the only token sequence in which each adjacent pair is
compatible: merging the two tokens' bytes together must give these two tokens back.  The encoder takes the longest
match, checks it against the token before it, takes shorter ones when the pair is incompatible and steps back when
none is left.  A place from which it stepped back is never entered again, as the tokens up to a place are unique, so
the work is linear in the piece.  Compatibility is memoised by pair.

Cases: a null text is empty; an empty text has no ids; special tokens' strings are ordinary text; ties do not arise.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from folioscan.llm.common import as_arrow, buffers, pieces

#: Entries of each of the two generations of a worker's memo of pieces, and half those of pairs; longer pieces don't stay in
#: it, so that it holds some 100 MB at most, whatever the texts hold.
MEMO, LONG = 400_000, 64
#: Places of a long piece whose matches are held at once.
WINDOW = 4096


class Pretokenizer:
    """Splits text as the pattern of the rank files does, from runs of character classes.

    Classes come from the library whose results are wanted (`regex`, or `tokenizers` for its JSON files), so that its own
    Unicode tables decide what a letter is.
    """

    LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
    TAILS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, library: str = "regex"):
        self.classes = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+")):
            if library == "regex":
                runs = [m.span() for m in regex.finditer(pattern, every)]
            else:
                runs = [at for _, at in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)]
            for a, b in runs:
                self.classes[ord(every[a]) : ord(every[b - 1]) + 1] = kind
        self.classes[0xD800:0xE000] = self.OTHER

    def cuts(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Where pieces of the joined text begin; `ends` are the places where its rows end."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[code]
        begin = np.empty(n, bool)
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        row = np.zeros(n + 1, bool)
        row[ends] = True
        row[0] = True
        begin |= row[:-1]
        at = np.flatnonzero(begin)
        run, stop = kind[at], np.append(at[1:], n)
        space = (run == self.SPACE) & ~row[stop]  # white space before a word of the same row
        last = stop[space] - 1
        # the last white space starts a piece; a blank leads the next run, other white space stands alone
        begin[last] = True
        begin[stop[space][code[last] == 32]] = False
        # 's, 't, 're ... where a piece is a lone apostrophe before letters
        quote = at[(run == self.OTHER) & (stop - at == 1) & ~row[stop]]
        quote = quote[(code[quote] == 39) & begin[quote]]
        quote = quote[kind[quote + 1] == self.LETTER] if len(quote) else quote
        for q in quote.tolist():
            for tail in self.TAILS:
                e = q + 1 + len(tail)
                if text.startswith(tail, q + 1) and not row[q + 1 : e].any():
                    begin[q + 1] = False
                    if e < n:
                        begin[e] = True
                    break
        return np.flatnonzero(begin)


def ranks_of(path: str) -> dict[bytes, int]:
    """Ranks by token, from lines (base64 token, blank, rank) or a JSON file of a byte-level model whose ids follow its merges."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # printable Latin-1 characters stand for their own bytes, those from U+0100 on for the other bytes in ascending order
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("ids in the order of the merges are needed")
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}


class Codec:
    """Encoder and decoder for a file of ranks (see ranks_of)."""

    def __init__(self, path: str):
        self.ranks = ranks_of(path)
        self.tokens: dict[int, bytes] = {b: a for a, b in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.pretokenizer = Pretokenizer("tokenizers" if path.endswith(".json") else "regex")
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self.memo = _Memo(self)

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte."""
        b = self.tokens[token]
        if len(b) == 1:
            return None
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None and r < token]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[-1]]) if len(parts) == 2 else None

    def _edges(self, token: int) -> tuple[list, list]:
        """The tokens that stand at the right and at the left edge of this one as its merges go on, from byte to whole."""
        if (known := self.edges.get(token)) is None:
            parts = self._parts(token)
            known = ([token], [token]) if parts is None else (self._edges(parts[1])[0] + [token], self._edges(parts[0])[1] + [token])
            self.edges[token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the two tokens' bytes give just these two tokens.

        Both sides' merges happen in order of rank.  A merge across the border breaks the pair if its rank comes
        before the next merge at the left side's edge, or not after the next one at the right side's edge (of equal
        ranks the leftmost goes first).
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            left, right = self._edges(a)[0], self._edges(b)[1]
            i = j = 0
            known = True
            while True:
                after_left = left[i + 1] if i + 1 < len(left) else 1 << 40
                after_right = right[j + 1] if j + 1 < len(right) else 1 << 40
                across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]])
                if across is not None and across < after_left and across <= after_right:
                    known = False
                    break
                if after_left == after_right == 1 << 40:
                    break
                if after_left <= after_right:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        latin = piece.decode("latin-1")
        low, found = 0, self._matches(latin, 0)
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = []
        at, k = 0, len(found[0]) - 1
        while at < n:
            here = found[at - low]
            while k >= 0:
                token, length = here[k]
                if not dead[at + length] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at += length
                if at - low >= WINDOW:
                    low = at // WINDOW * WINDOW
                    found = self._matches(latin, low)
                k = len(found[at - low]) - 1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                at -= len(self.tokens[out.pop()])
                k = tried.pop() - 1
                if at < low:
                    low = at // WINDOW * WINDOW
                    found = self._matches(latin, low)
        return out

    def _matches(self, latin: str, low: int) -> list[list]:
        """The tokens (rank, length) that begin at each of WINDOW places from `low`, short ones first."""
        found: list[list] = [[] for _ in range(min(WINDOW, len(latin) - low) + 1)]
        for end, match in self.automaton.iter(latin[low : low + WINDOW + self.longest]):
            if (start := end + 1 - match[1]) < WINDOW:
                found[start].append(match)  # ends ascend, so the longest match is last
        return found

    def encode_rows(self, rows: list[str]) -> list[bytes]:
        """Each row's ids as little-endian unsigned 32-bit integers."""
        joined = "".join(rows)
        ends = np.cumsum([len(r) for r in rows])
        cuts = self.pretokenizer.cuts(joined, ends)
        split = np.searchsorted(cuts, np.concatenate([[0], ends])).tolist()
        stops = np.append(cuts[1:], len(joined))[: len(cuts)].tolist()
        words = [joined[a:b] for a, b in zip(cuts.tolist(), stops, strict=True)]
        known = self.memo.__getitem__
        out = [b"".join(map(known, words[a:b])) for a, b in zip(split[:-1], split[1:], strict=True)]
        if len(self.memo) > MEMO:
            self.memo = _Memo(self, dict(self.memo))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """Ids by piece; `older` is the generation before, from which what is still in use moves over."""

    def __init__(self, codec: Codec, older: dict[str, bytes] | None = None):
        self.codec, self.older = codec, older or {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = np.array(self.codec.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary file in a worker's life."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Rows of `keep` with n_tokens, ids (array of int, if asked for), ids_sha256 and decoded_sha256.

    `vocabulary` is a path that every executor can open (part of the installed software, not data).
    A map over the rows: no shuffle; a worker holds one Arrow batch, cut into pieces of bounded text.
    """
    kept = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            _, offs = buffers(batch.column(batch.num_columns - 1))
            for a, b in pieces(offs):
                part = batch.slice(a, b - a)
                packed = c.encode_rows([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                columns = {k: part.column(i) for i, k in enumerate(keep)} | {"n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64())}
                if ids:
                    flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32), flat)
                columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in packed])
                columns["decoded_sha256"] = pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in packed])
                yield as_arrow(**columns)

    types = dict(kept.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"])
    return kept.mapInArrow(run, schema)
