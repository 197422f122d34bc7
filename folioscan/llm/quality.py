"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are read in overlapping chunks of `CHUNK` bytes every `STRIDE` bytes, to its end.  A learned
filter's response to a chunk has two parts.  The first is linear: every byte is looked up in a learned embedding, and
the filter has a weight vector for each place of the chunk.  The second is of second order, as linear filters can't
compare two places: for each distance up to `LAGS` the filter has a learned weight for the places of the chunk whose
`RUN` bytes stand again at that distance.  Each filter's largest response in the whole document goes through a logistic
unit into one probability.  Embedding and filters are folded into one table for scoring.

Learning takes a bounded sample of labelled rows on the driver: `rows` of either label, those first in a hash order,
of up to `longest` bytes each.  The sample's label shares are set right by the shares among all labels that may be
learned from.  Scoring takes whole texts of every row.  Labels, lang, source and doc_id never enter a score.

Cases: a null or empty text is one chunk of padding and gets that chunk's score; repeated rows get equal scores; a text
of any length is scored in spans of chunks, so that a worker's scratch memory stays bounded; without labels of both kinds
every score is the share of label 1 (0.5 without labels); several labels of one document count as the least, and of
several texts with one doc_id the least in byte order is learned from; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import CHUNK_BYTES, as_arrow, buffers, pieces, release

CHUNK, STRIDE, FILTERS, EMBED, LAGS, RUN = 64, 16, 16, 8, 32, 3
#: Bytes, and the padding after a row's end.
PAD = 256
SYMBOLS = PAD + 1
#: Bounds of the sample to learn from: rows of either label, and bytes of a row.
ROWS, LONGEST = 2500, 1 << 15
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.01, 1e-4
THRESHOLD = 0.3
#: What a row has beyond its last chunk, so that no place is compared with the next row.
TAIL = -(-(LAGS + RUN) // STRIDE) * STRIDE


def chunks_of(lens: np.ndarray) -> np.ndarray:
    """Chunks of rows of so many bytes; the last one reaches the row's end."""
    return np.maximum(1, -(-(lens - CHUNK) // STRIDE) + 1)


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded symbols, place of each chunk, first chunk of each row with the total at the end)."""
    lens = np.diff(offs)
    chunks = chunks_of(lens)
    size = CHUNK + STRIDE * (chunks - 1) + TAIL
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), PAD, np.int16)
    out[np.arange(len(data)) + np.repeat(begin - offs[:-1], lens)] = data
    count = np.cumsum(chunks)
    place = STRIDE * (np.arange(int(count[-1]) if len(count) else 0) - np.repeat(count - chunks, chunks)) + np.repeat(begin, chunks)
    return out, place, np.concatenate([[0], count])


def repeats(sym: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(chunks, LAGS): sixteenths of the places of each chunk whose RUN bytes stand again so many bytes later."""
    out = np.zeros((len(place), LAGS), np.float32)
    known = sym != PAD
    cell = place // STRIDE
    same = np.zeros(len(sym), bool)
    for lag in range(1, LAGS + 1):
        one = (sym[:-lag] == sym[lag:]) & known[lag:]
        m = len(one) - RUN + 1
        same[m:] = False
        same[:m] = one[:m]
        for k in range(1, RUN):
            same[:m] &= one[k : k + m]
        count = np.bitwise_count(same.view(np.uint64)).reshape(-1, STRIDE // 8).sum(axis=1, dtype=np.uint8)
        total = np.zeros(len(place), np.uint16)
        for k in range(CHUNK // STRIDE):
            total += count[cell + k]
        out[:, lag - 1] = total
    return out / 16


def responses(table: np.ndarray, lagged: np.ndarray, sym: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(chunks, filters); table is (CHUNK, SYMBOLS, FILTERS), lagged is (LAGS, FILTERS)."""
    out = repeats(sym, place) @ lagged
    for k in range(CHUNK):
        out += table[k].take(sym[place + k], axis=0)
    return out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32),
            "filters": r.normal(0, 1 / np.sqrt(CHUNK * EMBED), (CHUNK, EMBED, FILTERS)).astype(np.float32),
            "lagged": r.normal(0, 0.1, (LAGS, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.5, FILTERS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def table(self) -> np.ndarray:
        return np.matmul(self.p["embed"][None], self.p["filters"])

    def logits(self, table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        sym, place, first = symbols(data, offs)
        return self.combine(np.maximum.reduceat(responses(table, self.p["lagged"], sym, place), first[:-1], axis=0))

    def long_logit(self, table: np.ndarray, data: np.ndarray, most: int = CHUNK_BYTES) -> np.ndarray:
        """As logits for one row, of which no more than about `most` bytes are in work at once."""
        n, step = int(chunks_of(np.array([len(data)]))[0]), max(most // STRIDE, 1)
        pooled = None
        for c in range(0, n, step):
            last = min(c + step, n)
            part = data[c * STRIDE : (last - 1) * STRIDE + CHUNK + LAGS + RUN]
            sym, place, _ = symbols(part, np.array([0, len(part)]))
            best = responses(table, self.p["lagged"], sym, place[: last - c]).max(axis=0)
            pooled = best if pooled is None else np.maximum(pooled, best)
        return self.combine(pooled[None])

    def combine(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.p["bias"], 0) @ self.p["out"] + self.p["last"][0] + self.shift

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        made = []
        for t in texts:
            sym, place, _ = symbols(*buffers(pa.array([t])))
            made.append((sym, place, repeats(sym, place)))
        step = 0
        total = EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            for part in np.array_split(r.permutation(len(texts)), -(-len(texts) // BATCH)):
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in self._gradients([made[i] for i in part], labels[part]).items():
                    m, v = moment[k]
                    g = g + DECAY * self.p[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def _gradients(self, made: list, labels: np.ndarray) -> dict[str, np.ndarray]:
        table = self.table()
        shift = np.cumsum([0, *[len(m[0]) for m in made]])
        sym = np.concatenate([m[0] for m in made])
        place = np.concatenate([m[1] + s for m, s in zip(made, shift, strict=False)])
        again = np.concatenate([m[2] for m in made])
        count = np.cumsum([0, *[len(m[1]) for m in made]])
        z = again @ self.p["lagged"]
        for k in range(CHUNK):
            z += table[k].take(sym[place + k], axis=0)
        best = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(count[:-1], count[1:], strict=True)])
        pooled = np.take_along_axis(z, best, axis=0) + self.p["bias"]
        active = np.maximum(pooled, 0)
        logit = active @ self.p["out"] + self.p["last"][0]
        error = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        back = error[:, None] * self.p["out"][None] * (pooled > 0)
        seen = sym[place[best][..., None] + np.arange(CHUNK)]  # (rows, filters, CHUNK)
        vectors = self.p["embed"][seen]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, seen, back[..., None, None] * self.p["filters"].transpose(2, 0, 1)[None])
        return {
            "embed": embed,
            "filters": np.einsum("nf,nfke->kef", back, vectors),
            "lagged": np.einsum("nf,nfl->lf", back, again[best]),
            "bias": back.sum(axis=0),
            "out": error @ active,
            "last": error.sum(keepdims=True),
        }


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Network | float:
    """A network, or the share of label 1 where only one label is known."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return float(next(iter(shares))) if shares else 0.5
    spark = docs.sparkSession
    chosen = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    ids = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen], "doc_id long, quality int")  # 2 * rows at most
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= longest)
    least: dict[int, tuple] = {}  # of several texts with one id the least, whatever order they arrive in
    for r in sample.toLocalIterator():
        now = (r["doc_id"], r["text"], r["quality"])
        least[r["doc_id"]] = min(least.get(r["doc_id"], now), now)
    got = sorted(least.values())
    y = np.array([g[2] for g in got], np.float32)
    if not 0 < y.sum() < len(y):
        return shares[1] / (shares[0] + shares[1])
    net = Network()
    net.fit([g[1] for g in got], y)
    net.shift = float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    del got
    release()
    return net


def score(docs: DataFrame, model: Network | float, keep: tuple[str, ...] = ("doc_id",), column: str = "score") -> DataFrame:
    """`keep` columns and the score of every row; a map, without a shuffle."""
    if isinstance(model, float):
        return docs.select(*keep, F.lit(model).alias(column))
    table = model.table()
    shared = docs.sparkSession.sparkContext.broadcast((model, table))  # 1 MB, whatever the input
    kept = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, t = shared.value
        for batch in batches:
            data, offs = buffers(batch.column(at))
            for a, b in pieces(offs):
                span = data[offs[a] : offs[b]]
                logit = (net.long_logit(t, span) if len(span) > CHUNK_BYTES else net.logits(t, span, offs[a : b + 1] - offs[a])).astype(np.float64)
                part = batch.slice(a, b - a)
                yield as_arrow(**{k: part.column(i) for i, k in enumerate(keep)}, **{column: pa.array(1 / (1 + np.exp(-logit)))})
            release()

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keep) + f", `{column}` double")


def accepted(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """`columns` of the documents whose score reaches the threshold."""
    return score(docs, train(docs, labels), columns, "__score").where(F.col("__score") >= threshold).select(*columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
