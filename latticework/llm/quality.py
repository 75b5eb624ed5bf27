"""Quality classifier (operator 7): a byte-level convolutional network in numpy.

Each of ``FILTERS`` learned filters reads ``WIDTH`` neighbouring bytes through a
learned byte embedding.  A text is covered by chunks of 256 bytes that overlap by
half; each chunk keeps every filter's maximum.  The largest, the smallest and the
mean of these maxima over all chunks of the document feed one hidden layer and a
logistic output.  Filters, embedding and layers are trained together (Adam, with
gradients through the chosen maxima only).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import number_of, numbered, picked, raw_texts, slices

WIDTH, FILTERS, EMBED, HIDDEN = 8, 16, 8, 16
SEGMENT = 128  # a chunk is two neighbouring segments
SAMPLE_ROWS = 1200  # labelled rows the network is fitted on, at most
SAMPLE_BYTES = 1 << 17  # the size of each, at most
EPOCHS, BATCH, RATE = 10, 48, 0.01
PIECES = 5  # good texts of a batch of which a short piece is learned instead
_PAD = bytes(WIDTH)
_TOGETHER = 1 << 14  # places scored in one go: their filter values fit a processor's cache


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        return Network(f(256, EMBED) * 0.5, f(WIDTH, EMBED, FILTERS) / np.float32(np.sqrt(WIDTH * EMBED)), f(3 * FILTERS, HIDDEN) / np.float32(np.sqrt(3 * FILTERS)), np.zeros(HIDDEN, np.float32), f(HIDDEN) / np.float32(np.sqrt(HIDDEN)), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """For each tap, what each byte value adds to each filter."""
        return np.einsum("be,wef->wbf", self.embed, self.filters)

    def pair_tables(self) -> np.ndarray:
        """The same for every two neighbouring bytes and two neighbouring taps: half the look-ups."""
        t = self.tables()
        return (t[0::2, :, None] + t[1::2, None, :]).reshape(WIDTH // 2, 1 << 16, FILTERS)


def _levels(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Each filter's value at the first ``n`` places, from tables of single bytes or of pairs."""
    step = WIDTH // len(tables)
    at = data.astype(np.intp)
    if step == 2:
        at = at[:-1] * 256 + at[1:]
    level, more = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
    np.take(tables[0], at[:n], axis=0, out=level, mode="clip")
    for j in range(1, len(tables)):
        np.take(tables[j], at[step * j : step * j + n], axis=0, out=more, mode="clip")
        level += more
    return level


def _places(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """The texts' bytes, padded; the first place of each segment; each text's first segment and
    number of segments; the places whose windows would read into the next text."""
    data = np.frombuffer(b"".join(r + _PAD for r in raws) + _PAD, np.uint8)
    size = np.array([len(r) + WIDTH for r in raws])
    begin = np.cumsum(size) - size
    each = -(-np.maximum(size - WIDTH, 1) // SEGMENT)
    first = np.cumsum(each) - each
    at = np.repeat(begin, each) + (np.arange(each.sum()) - np.repeat(first, each)) * SEGMENT
    beyond = ((begin + size - WIDTH + 1)[:, None] + np.arange(WIDTH - 1)).ravel()
    return data, at, first, each, beyond


def _maxima(tables: np.ndarray, data: np.ndarray, at: np.ndarray, beyond: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Each filter's maximum in each segment, some thousand places at a time; ``place`` gets where they are."""
    out = np.empty((len(at), FILTERS), np.float32)
    ends = np.append(at[1:], len(data) - WIDTH)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _TOGETHER)))
        lo, hi = at[i], ends[j - 1]
        level = _levels(tables, data[lo : hi + WIDTH], hi - lo)
        some = beyond[np.searchsorted(beyond, lo) : np.searchsorted(beyond, hi)]
        level[some - lo] = -np.inf
        out[i:j] = np.maximum.reduceat(level, at[i:j] - lo)
        if place is not None:
            owner = np.repeat(np.arange(i, j), ends[i:j] - at[i:j])
            row, col = np.nonzero(level == out[owner])
            place[owner[row], col] = row + lo
        i = j
    return out


def _features(top: np.ndarray, first: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the largest, smallest and mean chunk maxima. A chunk is a segment with the next one of its text."""
    last = np.zeros(len(top), bool)
    last[first + each - 1] = True
    follow = np.minimum(np.arange(len(top)) + 1, len(top) - 1)
    second = np.where(last, np.arange(len(top)), follow)
    chunks = np.maximum(top, top[second])
    alone = np.repeat(each, each) == 1
    drop = last & ~alone  # a text's last segment is in the chunk before
    low = chunks.copy()
    low[drop] = np.inf
    summed = chunks.copy()
    summed[drop] = 0
    mean = np.add.reduceat(summed, first) / np.maximum(each - 1, 1)[:, None]
    return np.concatenate([np.maximum.reduceat(chunks, first), np.minimum.reduceat(low, first), mean], axis=1), chunks, second


def _head(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ net.hidden + net.hidden_bias)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))


def scores(net: Network, raws: list[bytes], pairs: np.ndarray | None = None) -> np.ndarray:
    """The probability of label 1 for each whole text; ``pairs`` are the network's pair tables."""
    data, at, first, each, beyond = _places(raws)
    top = _maxima(net.pair_tables() if pairs is None else pairs, data, at, beyond)
    return _head(net, _features(top, first, each)[0])[1].astype(np.float64)


def _gradients(net: Network, raws: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    data, at, first, each, beyond = _places(raws)
    place = np.zeros((len(at), FILTERS), np.int64)
    top = _maxima(net.tables(), data, at, beyond, place)
    x, chunks, second = _features(top, first, each)
    hidden, p = _head(net, x)
    err = (p - wanted).astype(np.float32) / len(raws)
    d_hidden = np.outer(err, net.out) * (1 - hidden**2)
    dx = d_hidden @ net.hidden.T
    text = np.repeat(np.arange(len(raws)), each)
    from_first = top >= top[second]
    d_top = np.zeros_like(top)
    last = np.zeros(len(top), bool)
    last[first + each - 1] = True
    counted = ~(last & (each[text] > 1))
    d_chunk = np.where(counted[:, None], dx[text, 2 * FILTERS :] / np.maximum(each - 1, 1)[text, None], 0)
    for k, pick in ((0, np.maximum.reduceat(chunks, first)), (1, x[:, FILTERS : 2 * FILTERS])):
        same = (chunks == pick[text]) & counted[:, None]
        share = np.add.reduceat(same, first, dtype=np.float32)
        d_chunk += same * (dx[:, k * FILTERS : (k + 1) * FILTERS] / np.maximum(share, 1))[text]
    d_top += np.where(from_first, d_chunk, 0)
    d_top[second[~last]] += np.where(from_first, 0, d_chunk)[~last]  # a last segment is its own second
    d_embed, d_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
    for j in range(WIDTH):
        byte = data[place + j]  # segments x filters
        taken = net.embed[byte]
        d_filters[j] = np.einsum("sfe,sf->ef", taken, d_top)
        for e in range(EMBED):
            d_embed[:, e] += np.bincount(byte.ravel(), (d_top * net.filters[j, e]).ravel(), 256)
    return [d_embed, d_filters, x.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ err, err.sum(keepdims=True)]


def _piece(raw: bytes, rng: np.random.Generator) -> bytes:
    """Up to a hundred bytes of a text, from the start of a word."""
    at = int(rng.integers(0, max(1, len(raw) - 20)))
    at = raw.find(b" ", at) + 1
    return raw[at : at + int(rng.integers(1, 100))]


def train(raws: list[bytes], labels: np.ndarray, seed: int = 7) -> Network | None:
    """A network fitted on the texts; None if either label is absent. Both labels weigh the same."""
    labels = np.asarray(labels, np.float32)
    sides = [np.flatnonzero(labels == v) for v in (0, 1)]
    if not all(len(s) for s in sides):
        return None
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    steps_an_epoch = max(4, len(raws) // BATCH)
    step, total = 0, EPOCHS * steps_an_epoch
    while step < total:
        step += 1
        chosen = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        texts = [raws[i] for i in chosen]
        # short good texts are rare: a few pieces of longer ones keep them from being taken for repetition
        texts[-PIECES:] = [_piece(t, rng) for t in texts[-PIECES:]]
        grads = _gradients(net, texts, labels[chosen])
        rate = RATE * min(1, 2 * (1 - step / (total + 1)))
        for w, g, (m, v) in zip(net.weights(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id"):
    """True for rows whose label must not be learned: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """A network fitted on at most ``rows`` labelled documents outside the held-out third.

    The rows with the smallest hashes of doc_id are taken, half of each label
    where there are so many; their whole texts are used.  Rows without a label
    or with two different ones aren't used, nor are texts above ``SAMPLE_BYTES``,
    in whose place the next ones are taken: so what reaches the driver is bounded.
    """
    labels = picked(labels, doc_id=("doc_id", "long"), quality=("quality", "int"))
    known = labels.where(~held_out()).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    asked: list = []
    for label in (0, 1):
        asked += known.where(F.col("quality") == label).orderBy(*order).limit(rows).select("doc_id", "quality").collect()  # at most twice rows
    if not asked:
        return None
    asked_table = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in asked], "doc_id long, quality int")
    found = picked(docs, doc_id=("doc_id", "long"), text=("text", "string")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    found = found.join(F.broadcast(asked_table), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("quality").orderBy(*order))
    chosen = found.withColumn("place", place).where(F.col("place") <= rows // 2).orderBy("doc_id").collect()
    return train([(r["text"] or "").encode("utf-8", "surrogatepass") for r in chosen], np.array([r["quality"] for r in chosen]))


def score_texts(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null texts count as empty and have a score too.  Without a network (no labels
    of both kinds to learn from) every score is 0.5 and every prediction 1.  Equal
    texts have equal scores; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.pair_tables() if shared.value is not None else None
        for batch in slices(batches, "text", most_bytes=1 << 16):
            raws = [r or b"" for r in raw_texts(batch.column("text"))]
            found = scores(shared.value, raws, pairs) if pairs is not None else np.full(len(raws), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    own = picked(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    out = own.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5, with all their columns, whatever their names."""
    plain, at = numbered(docs), number_of(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.pair_tables() if shared.value is not None else None
        for batch in slices(batches, at, most_bytes=1 << 16):
            if pairs is not None:
                batch = batch.filter(pa.array(scores(shared.value, [r or b"" for r in raw_texts(batch.column(at))], pairs) >= 0.5))
            yield batch

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
