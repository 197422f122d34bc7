"""Substring dedup by recompression.

The words of all documents are one alphabet.  Rounds rename it: first maximal runs of a symbol become one symbol, then
pairs of a left-class and a right-class symbol do; classes and new names are functions of the names alone, so every
executor gives equal runs and pairs the same name and equal substrings get the same symbols but for a few at their
ends.  For a window of words, the symbols that its words alone decide are followed through the rounds; the longest
of them is the window's interior symbol.

1. Reveal: batches send the distinct interior symbols of their windows to hash buckets, which answer which of them
   other batches hold too.  A window of words that occurs in two documents has the same interior symbol in both, so a
   window whose symbol one document alone holds is no repeat.
2. Verify: the windows left send a 96-bit name of their words to hash buckets (each batch only for the smallest
   doc_id that has it); a window whose name a document with a smaller doc_id also has is removed.
3. Words under removed windows go.

Windows too monotonous for an interior symbol (their runs may go on outside) skip step 1 and are verified like others.

Cases: a null, empty or blank text has no word; under `width` words there is no window and nothing goes; of equal texts
the smallest doc_id stays whole (in what it doesn't share with smaller ones); rows with equal doc_id don't remove each
other's words; a null doc_id counts as the largest; an empty table gives no rows; further columns are kept if named.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folioscan.llm.common import buffers, chain, joined_words, mix, pieces, tidy, window_starts, word_spans
from folioscan.llm.exchange import batched, bucket_of, cut_by_bucket, ids, ordered, pack_places, pack_sorted, unpack_places, unpack_sorted, word_hashes

WIDTH = 13
ROUNDS = 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def interior_symbols(word: np.ndarray, first: np.ndarray, at: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> np.ndarray:
    """The name of the longest interior symbol of the windows that start at words `at`; 0 where there is none."""
    best = np.zeros(len(at), np.uint64)
    if not len(at):
        return best
    with np.errstate(over="ignore"):
        name = mix(word)
        row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        begin = np.arange(len(word), dtype=np.int32)
        live = np.arange(len(at))
        low, high = at.copy(), at + width
        for r in range(1, rounds + 1):
            # runs: the first and the last run of what is certain may go on outside
            new = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))
            where = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            count = np.diff(np.append(where, len(name)))
            name = np.where(count > 1, mix(name[where] + count.astype(np.uint64) * _GOLD), name[where])
            row, begin = row[where], begin[where]
            low, high = number[low] + 1, number[high - 1]
            some = low < high
            live, low, high = live[some], low[some], high[some]
            # pairs: a right-class symbol at the low end or a left-class one at the high end may pair outside
            right = (mix(name + np.uint64(r)) & np.uint64(1)).astype(bool)
            pair = np.append(~right[:-1] & right[1:] & (row[1:] == row[:-1]), False)
            second = np.append(False, pair[:-1])
            low = low + right[low]
            high = high - ~right[high - 1]
            some = low < high
            live, low, high = live[some], low[some], high[some]
            where = np.flatnonzero(~second)
            number = np.cumsum(~second) - 1
            after = np.append(name[1:], np.uint64(0))
            name = np.where(pair, mix(mix(name + _GOLD) ^ (after + np.uint64(r))), name)[where]
            row, begin = row[where], begin[where]
            low, high = number[low], number[high - 1] + 1
            if not len(live):
                break
            length = np.minimum(np.diff(np.append(begin, len(word))), 255).astype(np.uint64)
            weight = length << np.uint64(56) | name >> np.uint64(8)
            most = weight[low]
            for k in range(1, int((high - low).max())):
                more = np.flatnonzero(low + k < high)
                most[more] = np.maximum(most[more], weight[low[more] + k])
            best[live] = np.maximum(best[live], most)
        return np.where(best > 0, mix(best), best)


def _windows(table: pa.Table, width: int, both: bool):
    first, one, two = word_hashes(table, both)
    at = window_starts(first, width)
    symbol = interior_symbols(one, first, at, width)
    owner = np.searchsorted(first, at, side="right") - 1
    return first, one, two, at, owner, symbol


def _several(group_of: np.ndarray, n: int, owner_id: np.ndarray) -> np.ndarray:
    """For each of n groups, whether its members have more than one owner id."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group_of, owner_id)
    np.maximum.at(high, group_of, owner_id)
    return low != high


def _least(name1: np.ndarray, name2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry, the smallest doc among those of its name."""
    if not len(doc):
        return doc
    order = np.argsort(name1)
    a, b = name1[order], name2[order]
    same = a[1:] == a[:-1]
    if (b[1:] != b[:-1])[same].any():
        order = np.lexsort((name2, name1))
        a, b = name1[order], name2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    new = np.append(True, ~same)
    out = np.empty_like(doc)
    out[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def removal(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, `keep` columns and, if asked for, the text without the removed words.

    Removed words go with the white space after them.
    """
    rows, n = batched(docs, *keep)
    by_batch = rows.groupBy("batch")

    @tidy
    def reveal(table: pa.Table) -> pa.Table:
        batch, table = table["batch"][0].as_py(), ordered(table)
        symbol = np.unique(_windows(table, width, False)[5])
        symbol = symbol[symbol > 0]
        found, start, stop = cut_by_bucket(symbol, n)
        return pa.table({"bucket": pa.array(found, pa.int32()), "batch": pa.array([batch] * len(found), pa.int32()), "keys": pa.array([pack_sorted(symbol[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())})

    @tidy
    def answer(table: pa.Table) -> pa.Table:
        lists = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        shared = np.zeros(len(every), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        stop = np.cumsum([len(x) for x in lists])
        bits = [np.packbits(x).tobytes() for x in np.split(shared, stop[:-1])]
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    shared = by_batch.applyInArrow(reveal, "bucket int, batch int, keys binary").groupBy("bucket").applyInArrow(answer, "batch int, bucket int, bits binary")
    fields = {"bucket": pa.int32(), "batch": pa.int32(), "name1": pa.binary(), "name2": pa.binary(), "places": pa.binary(), "runs": pa.binary()}

    @tidy
    def verify(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({k: pa.array([], v) for k, v in fields.items()})
        batch, table = table["batch"][0].as_py(), ordered(table)
        first, one, two, at, owner, symbol = _windows(table, width, True)
        doc = ids(table)
        keys, group = np.unique(symbol, return_inverse=True)
        alive = _several(group, len(keys), doc[owner])
        answers = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True))
        none = int(len(keys) > 0 and keys[0] == 0)
        if none:
            alive[0] = True
        for b, s, e in zip(*(x.tolist() for x in cut_by_bucket(keys[none:], n)), strict=True):
            alive[none + s : none + e] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=e - s).astype(bool)
        left = np.flatnonzero(alive[group])
        at, owner = at[left], owner[left]
        name1, name2 = chain(one, width)[at], chain(two, width, 1)[at]
        # windows that a smaller doc_id of this batch has, as runs; the others go to their buckets
        gone = doc[owner] > _least(name1, name2, doc[owner])
        local = np.flatnonzero(gone)
        edge = np.flatnonzero(np.append(True, (np.diff(at[local]) != 1) | (np.diff(owner[local]) != 0))[: len(local)])
        runs = local[edge]
        sent = np.flatnonzero(~gone)
        sent = sent[np.lexsort((at[sent], bucket_of(name1[sent], n)))]
        found, start = np.unique(bucket_of(name1[sent], n), return_index=True)
        stop = np.append(start[1:], len(sent))[: len(start)]
        word = (at - first[owner]).astype(np.int32)
        own = owner.astype(np.int32)
        run_words = np.diff(np.append(edge, len(local))).astype(np.int32) + width - 1
        spans = [sent[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
        columns = {
            "bucket": [*found.tolist(), batch % n],
            "batch": [batch] * (len(found) + 1),
            "name1": [*(name1[i].tobytes() for i in spans), None],
            "name2": [*(name2[i].astype(np.uint32).tobytes() for i in spans), None],
            "places": [*(pack_places(doc[owner[i]], own[i], word[i]) for i in spans), None],
            "runs": [*[None] * len(found), np.stack([own[runs], word[runs], run_words]).tobytes()],
        }
        return pa.table({k: pa.array(v, fields[k]) for k, v in columns.items()})

    @tidy
    def settle(table: pa.Table) -> pa.Table:
        known = pc.is_valid(table["runs"])
        local, sent = table.filter(known), table.filter(pc.invert(known))
        name1, name2 = _joined(sent["name1"], np.uint64), _joined(sent["name2"], np.uint32)
        places = [unpack_places(x) for x in sent["places"].to_pylist()]
        doc, row, word = (np.concatenate([p[i] for p in places]) if places else np.zeros(0, np.int64) for i in range(3))
        batch = np.repeat(sent["batch"].to_numpy(), [len(p[0]) for p in places])
        gone = np.flatnonzero(doc > _least(name1, name2, doc))
        gone = gone[np.argsort(batch[gone], kind="stable")]
        found, start = np.unique(batch[gone], return_index=True)
        parts = np.split(gone, start[1:]) if len(found) else []
        runs = [np.stack([row[i], word[i], np.full(len(i), width)]).astype(np.int32).tobytes() for i in parts]
        return pa.table({"batch": pa.array([*found.tolist(), *local["batch"].to_pylist()], pa.int32()), "runs": pa.array([*runs, *local["runs"].to_pylist()], pa.binary())})

    checked = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(verify, "bucket int, batch int, name1 binary, name2 binary, places binary, runs binary")
    gone = checked.groupBy("bucket").applyInArrow(settle, "batch int, runs binary")
    types = dict(rows.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text + "".join(f", `{k}` {types[k]}" for k in keep)

    @tidy
    def remove(table: pa.Table, removed: pa.Table) -> pa.Table:
        table = ordered(table)
        data, offs = buffers(table["text"])
        runs = [np.frombuffer(x, np.int32).reshape(3, -1) for x in removed["runs"].to_pylist()]
        row, word, count = np.concatenate([np.zeros((3, 0), np.int32), *runs], axis=1)
        order = np.argsort(row, kind="stable")
        row, word, count = row[order], word[order], count[order]
        edge = np.searchsorted(row, np.arange(len(table) + 1))
        n_words, n_removed, digests, texts = [], [], [], []
        for a, b in pieces(offs):
            d, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            starts, ends, first = word_spans(d, o)
            mark = np.zeros(len(starts) + 1, np.int32)
            at = slice(edge[a], edge[b])
            begin = first[row[at] - a] + word[at]
            np.add.at(mark, begin, 1)
            np.subtract.at(mark, begin + count[at], 1)
            out = np.cumsum(mark[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(out)])
            n_words += np.diff(first).tolist()
            n_removed += (total[first[1:]] - total[first[:-1]]).tolist()
            joined, begin, stop = joined_words(d, starts[~out], ends[~out])
            kept = (np.arange(len(starts) + 1) - total)[first]
            digests += [hashlib.sha256(joined[begin[x] : stop[y - 1]] if y > x else b"").hexdigest() for x, y in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            if text:
                shade = np.zeros(len(d) + 1, np.int8)
                until = np.minimum(np.append(starts[1:], len(d)), o[np.searchsorted(o, starts, side="right")]) if len(starts) else starts
                shade[starts[out]] += 1
                shade[until[out]] -= 1
                stay = np.cumsum(shade[:-1]) == 0
                place = np.concatenate([[0], np.cumsum(stay)])[o]
                raw = d[stay].tobytes()
                texts += [raw[x:y].decode() for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
        columns = {"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if text:
            columns["text"] = pa.array(texts, pa.string())
        return pa.table(columns | {k: table[k] for k in keep})

    return by_batch.cogroup(gone.groupBy("batch")).applyInArrow(remove, schema)
