"""Packing documents into sequences of bounded length by shortest-pack-first over the length histogram.

1. Each document is tokenised where it is read; pieces of at most `size` ids get a length and a checksum.  Ids are
   never shuffled.
2. Pieces are dealt by range of (length, doc_id, start) and kept in a checkpoint.  A count for each length and partition
   gives every piece its rank among the pieces of its length without one task seeing a whole length.
3. The driver packs the histogram, which has at most `size` entries however many documents there are.  Lengths are
   placed longest first into the packs with the most room (the shortest packs); packs with the same room are one
   interval of sequence ids with a count, so a step places thousands of pieces at once.
4. Each step is a run of ranks of one length that goes to a run of sequences at one offset; a binary search by
   (length, rank) joins the steps back to the pieces.

Cases: a null or empty text is the end id alone; repeated documents are packed like any other, ordered by doc_id, start;
an empty table gives no rows; further columns are ignored unless kept.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm.common import as_arrow, buffers, cut, partitions, pieces, release

SIZE = 4096
#: The id that ends each document.
END = 2
#: Entries of each of the two generations of a worker's memo of chunks, which hold 16 ids each on average at most, and
#: characters of a chunk that stays in it: 131 MB over check_l, by calculation under 500 MB and a batch whatever the texts hold.
MEMO, LONG = 400_000, 64
#: New chunks that are merged at once, and chunks whose ids are copied at once.
MERGED, COPIED = 1 << 14, 1 << 18

#: Chunks whose normal form, lower case and words numpy and the tokenizer's library read alike.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PLAIN_LINES = re.compile("[\n\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Python's split() takes these for white space, the tokenizer does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}


#: What a byte of lower-cased plain chunks, a line each, is: the line's end, a letter (or a part of one), a digit, other.
_END, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[10], _KIND[ord("a") : ord("z") + 1], _KIND[128:], _KIND[ord("0") : ord("9") + 1] = _END, _LETTER, _LETTER, _DIGIT


def words_of(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the plain chunks in lower case, start and end there of each word as of _WORDS, and each chunk's first word."""
    data = np.frombuffer("\n".join([*chunks, "\n"]).lower().encode(), np.uint8)  # two ends of line: a quote has two bytes after it
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[(quote == 0) | (kind[quote - 1] != _OTHER)]  # in a run of others it is one of them
    one, two = data[quote + 1], data[quote + 2]
    long = np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    ends = [quote[np.isin(one, list(b"stmd"))] + 2, quote[long] + 3]
    for n, e in zip((2, 3), ends, strict=True):
        first[e - n + 1] = False
        first[e] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(data))
    inside = kind[start] != _END
    start, end = start[inside], end[inside]
    lines = np.flatnonzero(kind == _END)[: len(chunks) - 1] + 1
    return data, start, end, np.searchsorted(start, np.append(0, lines))


class Merges:
    """The file's byte-pair merges, applied to many words at once.

    In each step every word merges its pair of least rank, the leftmost of equal ones, as the library does word by word.
    Ranks are found by open addressing over the pairs.  A place in a word, of 2 * LONG bytes at most, has PLACES bits.
    """

    BITS, NONE, PAD, PLACES = 19, (1 << 24) - 1, (1 << 31) - 1, 7

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError(f"{path}: not a vocabulary of merges alone")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        own = byte_alphabet()
        letters = [chr(own.get(b, b)) for b in range(256)]
        self.inner, self.last = (np.array([vocab[x + end] for x in letters], np.int32) for end in ("", suffix))
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = np.full(1 << self.BITS, np.iinfo(np.uint64).max), np.full(1 << self.BITS, self.NONE, np.int32)
        rank_of = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        if 2 * len(rank_of) > len(self.keys) or len(pairs) >= self.NONE:
            raise ValueError(f"{path}: too many merges")
        keys, ranks = np.array(list(rank_of), np.uint64), np.array(list(rank_of.values()), np.int32)
        slot = self._slots(keys)
        while len(keys):
            at, one = np.unique(slot, return_index=True)
            one = one[self.ranks[at] == self.NONE]
            self.keys[slot[one]], self.ranks[slot[one]] = keys[one], ranks[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) % len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slots(keys)
        out = self.ranks[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & (out != self.NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            out[open_] = self.ranks[slot[open_]]
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (out[open_] != self.NONE)]
        return out

    def _merge(self, ids: np.ndarray) -> None:
        """Merge in place the words in the columns of `ids`, whose last row and places beyond a word's end hold PAD."""
        rows, n = ids.shape
        none = self.NONE << self.PLACES
        place = np.arange(rows, dtype=np.int32)[:, None]
        after, before = (np.repeat(x, n) for x in (np.minimum(place + 1, rows - 1), np.where(place, place - 1, rows - 1)))
        score = np.full(ids.shape, none, np.int32)  # the rank of a place and the next in use, then the place
        score[:-1] = self.rank(ids[:-1].ravel(), ids[1:].ravel()).reshape(rows - 1, n) << self.PLACES | place[:-1]
        flat, scores = ids.reshape(-1), score.reshape(-1)
        while True:
            best = score.min(axis=0)
            column = np.flatnonzero(best < none)
            if not len(column):
                return
            best = best[column]
            at = best & (1 << self.PLACES) - 1
            here = at * n + column
            gone = after[here] * n + column
            flat[here] = self.merged[best >> self.PLACES]
            flat[gone], scores[gone] = self.PAD, none
            right, left = after[gone], before[here]
            after[here], before[right * n + column] = right, at
            found = self.rank(np.concatenate([flat[here], flat[left * n + column]]), np.concatenate([flat[right * n + column], flat[here]])) << self.PLACES
            scores[here] = found[: len(column)] | at
            scores[left * n + column] = found[len(column) :] | left  # before a word's first place is the last row: PAD, no rank

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the plain chunks of at most LONG characters has, and all the ids."""
        data, start, end, first = words_of(chunks)
        size = end - start
        symbols = self.inner[data]
        symbols[end - 1] = self.last[data[end - 1]]
        length = np.empty(len(start), np.int64)
        parts = []
        wide = 1
        while wide < 2 * size.max():  # words of similar length are merged together
            words = np.flatnonzero((size <= wide) & (size > wide // 2))
            if len(words):
                place = np.arange(wide + 1)[:, None]
                ids = np.where(place < size[words], symbols[np.minimum(start[words] + place, len(data) - 1)], np.int32(self.PAD))
                self._merge(ids)
                kept = ids.T != self.PAD
                length[words] = kept.sum(axis=1)
                parts.append((words, ids.T[kept]))
            wide *= 2
        stop = np.cumsum(length)
        out = np.empty(int(stop[-1]), np.uint32)
        for words, ids in parts:
            n = length[words]
            out[np.repeat(stop[words] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return np.add.reduceat(length, first), out


class Memo(defaultdict):
    """The number of each chunk, given when it is first asked for; the ids of numbers are put one after another."""

    def __init__(self):
        super().__init__(itertools.count().__next__)
        self.learned = self.numbers = self.used = 0  # entries that have ids; numbers given to these; ids in use
        self.start, self.length, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def new(self) -> list[str]:
        """Entries without ids so far, in the order of their numbers."""
        return list(itertools.islice(reversed(self), len(self) - self.learned))[::-1]

    def put(self, numbers: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """The ids, in turn, of ascending numbers."""
        if len(numbers) and numbers[-1] >= len(self.start):
            more = np.empty(int(numbers[-1]) + 1, np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(self.used + len(ids), np.uint32)])
        self.length[numbers] = length
        self.start[numbers] = self.used + np.cumsum(length) - length
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each number has, and the ids of all."""
        n = self.length[numbers]
        stop = np.cumsum(n)
        return n, self.ids[np.repeat(self.start[numbers] - stop + n, n) + np.arange(int(n.sum()))]


class Encoder:
    """Ids of whole texts by a word tokenizer's file, with a memo of what was seen before.

    The tokenizer drops white space and never joins over it, so a text's ids are those of its chunks in turn.  Special
    tokens' strings are ordinary text.  New plain chunks go together through the file's merges, long ones word by word
    through the library's, others through all of its steps.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.alphabet = byte_alphabet()
        self.merges = Merges(path)
        self.memo, self.older = Memo(), Memo()

    def _single(self, chunk: str) -> np.ndarray:
        if not _PLAIN.fullmatch(chunk):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32)
        ids: list[int] = []
        for w in _WORDS.findall(chunk.lower()):
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(self.alphabet)
            ids += [t.id for t in self.tokenizer.model.tokenize(w)]
        return np.array(ids, np.uint32)

    def _learn(self) -> tuple[list[str], int]:
        """Put the ids of the memo's new chunks, those of long ones last; gives these and where their ids begin."""
        memo, new = self.memo, self.memo.new()
        seen = np.array(list(map(self.older.get, new, itertools.repeat(-1))), np.int64)
        moved, rest = np.flatnonzero(seen >= 0), np.flatnonzero(seen < 0).tolist()
        memo.put(moved + memo.numbers, *self.older.take(seen[moved]))
        plain, other, long = rest, [], []
        left = [new[i] for i in rest]
        if max(map(len, left), default=0) > LONG or not _PLAIN_LINES.fullmatch("\n".join(left)):
            plain = []
            for i, c in zip(rest, left, strict=True):
                (long if len(c) > LONG else plain if _PLAIN.fullmatch(c) else other).append(i)
        for a in range(0, len(plain), MERGED):
            part = plain[a : a + MERGED]
            memo.put(np.array(part) + memo.numbers, *self.merges.encode([new[i] for i in part]))
        singles = [self._single(new[i]) for i in other]
        if other:
            memo.put(np.array(other) + memo.numbers, np.array([len(x) for x in singles]), np.concatenate(singles))
        kept = memo.used
        for i in long:
            ids = self._single(new[i])
            memo.put(np.array([i + memo.numbers]), np.array([len(ids)]), ids)
        memo.numbers += len(new)
        memo.learned = len(memo)
        return [new[i] for i in long], kept

    def encode_rows(self, rows: list[str]) -> list[bytes]:
        split = [re.findall("[^ \n\t\r]+", r) if any(x in r for x in _NOT_SPACE) else r.split() for r in rows]
        chunks = np.array([len(s) for s in split], np.int64)
        numbers = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(chunks.sum()))
        del split
        long, kept = self._learn()
        taken = [self.memo.take(numbers[a : a + COPIED]) for a in range(0, len(numbers), COPIED)]
        ids = np.concatenate([np.empty(0, np.uint32), *(x for _, x in taken)]).astype("<u4", copy=False)
        before = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(n for n, _ in taken)]))
        edges = before[np.append(0, np.cumsum(chunks))].tolist()
        for c in long:
            del self.memo[c]
        self.memo.learned, self.memo.used = len(self.memo), kept
        if self.memo.numbers > MEMO or self.memo.used > 16 * MEMO:
            self.memo, self.older = Memo(), self.memo
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            _, offs = buffers(batch.column(1))
            for a, b in pieces(offs):
                part = batch.slice(a, b - a)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), e.encode_rows([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    out += [(doc, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
                yield as_arrow(**{k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*out, strict=True), strict=True)})
            release()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, count, first sequence, offset) that place every piece once.

    Packs with equal room wait in a heap with the most room first; of equal room the lowest sequence id goes first.
    """
    steps: list[tuple[int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # (-room, first sequence, count)
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and -packs[0][0] >= length:
                room, first, count = heapq.heappop(packs)
                room = -room
                n = min(count, left)
                if n < count:
                    heapq.heappush(packs, (-room, first + n, count - n))
            else:
                room, first, n = size, sequences, -(-left // (size // length))  # as many as the rest of this length fills
                sequences += n
            steps.append((length, rank, n, first, size - room))
            rank += n
            left -= n
            if room > length:
                heapq.heappush(packs, (length - room, first, n))
    return steps


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and offset; a sequence's offsets are gapless from 0.

    What reaches the driver is bounded: a count for each length present in a partition (a range partition holds few
    lengths, so partitions + `size` rows) and the packing steps.
    """
    spark = docs.sparkSession
    found = cut(tokenised_pieces(docs, tokenizer, size, end))  # dealing by range reads its input twice
    dealt = cut(found.repartitionByRange(partitions(spark), "length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for v, n in zip(*np.unique(batch.column(0).to_numpy(), return_counts=True), strict=True):
                seen[int(v)] = seen.get(int(v), 0) + int(n)
        if seen:
            yield as_arrow(part=pa.array([TaskContext.get().partitionId()] * len(seen), pa.int64()), length=pa.array(list(seen), pa.int64()), n=pa.array(list(seen.values()), pa.int64()))

    counts = dealt.select("length").mapInArrow(count, "part long, length long, n long").collect()
    histogram: dict[int, int] = {}
    before: dict[int, dict[int, int]] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["part"])):
        before.setdefault(r["part"], {})[r["length"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    steps = np.array(pack_histogram(histogram, size), np.int64).reshape(-1, 5)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = spark.sparkContext.broadcast((steps[order], before))  # steps are bounded by the histogram, not by documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, begins = shared.value
        key = plan[:, 0] << 44 | plan[:, 1]
        begin, seen = begins.get(TaskContext.get().partitionId(), {}), {}
        for batch in batches:
            length = batch.column(2).to_numpy()
            if not len(length):
                continue
            rank = np.empty(len(length), np.int64)
            edges = np.flatnonzero(np.diff(length)) + 1
            for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(length)).tolist(), strict=True):
                v = int(length[a])
                rank[a:b] = begin[v] + seen.get(v, 0) + np.arange(b - a)
                seen[v] = seen.get(v, 0) + b - a
            step = plan[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(step[:, 3] + rank - step[:, 1]), pa.array(step[:, 4])], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, dealt._jdf.schema().toDDL() + ", sequence_id long, offset long")
