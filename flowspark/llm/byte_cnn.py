"""Quality classifier: a convolutional network over the bytes of whole documents, in numpy.

A document is cut into segments of 256 bytes; two neighbours make a chunk, so that chunks overlap by half. Input
channels are a learned embedding of each byte and a flag for bytes that repeat what stood a few bytes before. Learned
filters of 8 bytes run over every second position, their responses are max-pooled within chunks; the largest and the
mean response of the document's chunks go into one logistic unit.

Training takes at most ``sample_rows`` labelled documents, the first by a hash of doc_id, each as a whole; scoring reads
every byte of every document. Of the rows of one doc_id, the least text teaches.

Nulls: a null text scores as an empty one. Null doc_ids are carried, and never teach; nor do null labels. Repeated rows
score alike. Other columns are ignored. Without labels of both kinds every document scores the share of label 1, or
0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import hashed_sample, sub_batches

SEGMENT, WIDTH, STRIDE = 256, 8, 2
EMBEDDING, FILTERS = 5, 16
LAGS = range(2, 33)
SAMPLE_ROWS = 2500
#: Segments whose filter positions are in memory at once.
TILE = 64
THRESHOLD = 0.7
_PART = SEGMENT // STRIDE
_CHANNELS = EMBEDDING + 1


def repeats(data: np.ndarray) -> np.ndarray:
    """Whether the eight bytes from each position also stand at one of LAGS before it."""
    out = np.zeros(len(data), np.float32)
    tile = 1 << 15
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for a in range(0, len(data), tile):
        b = min(a + tile, len(data))
        lo = max(0, a - LAGS[-1])
        piece = padded[lo : b + 8].astype(np.uint64)
        eight = np.zeros(b - lo, np.uint64)
        for k in range(8):
            eight |= piece[k : k + b - lo] << np.uint64(8 * k)
        hit = np.zeros(b - lo, bool)
        for lag in LAGS:
            if lag < len(eight):
                hit[lag:] |= eight[lag:] == eight[:-lag]
        out[a:b] = hit[a - lo :] & (eight[a - lo :] != 0)
    return out


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each padded to whole segments, and the number of segments of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = (sizes + LAGS[-1] + WIDTH) // SEGMENT + 1  # zeros keep documents out of each other's reach
    data = np.zeros(int(n.sum()) * SEGMENT + WIDTH, np.uint8)
    for t, at in zip(texts, (np.cumsum(n) - n) * SEGMENT, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return data, n


@dataclass
class ByteNet:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float
    constant: float | None = None

    @staticmethod
    def start(seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        f = rng.normal(0, 0.25, (WIDTH * _CHANNELS, FILTERS)).astype(np.float32)
        return ByteNet(rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), f, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def windows(self, data: np.ndarray, flags: np.ndarray, first: int, last: int) -> np.ndarray:
        """Input of each filter position of segments ``first`` to ``last``, one row each."""
        a, b = first * SEGMENT, last * SEGMENT + WIDTH
        x = np.empty((b - a, _CHANNELS), np.float32)
        x[:, :EMBEDDING] = self.embedding[data[a:b]]
        x[:, EMBEDDING] = flags[a:b]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), WIDTH * _CHANNELS)
        return view[: (last - first) * SEGMENT * _CHANNELS : STRIDE * _CHANNELS]

    def responses(self, data: np.ndarray, flags: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each segment, for documents of ``n`` segments."""
        count, last = int(n.sum()), last_segments(n)
        out = np.empty((count, FILTERS), np.float32)
        for a in range(0, count, TILE):
            b = min(a + TILE, count)
            y = np.ascontiguousarray(self.windows(data, flags, a, b)) @ self.filters
            out[a:b] = within(y.reshape(b - a, _PART, FILTERS), last[a:b]).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        data, n = segments(texts)
        top = self.responses(data, repeats(data), n)
        return 1 / (1 + np.exp(-(pool(top, n)[0] @ self.head + self.offset).astype(np.float64)))


def last_segments(n: np.ndarray) -> np.ndarray:
    out = np.zeros(int(n.sum()), bool)
    out[np.cumsum(n) - 1] = True
    return out


def within(y: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Responses by segment and position; those that reach beyond a document's padding get the one before."""
    y[last, 1 - WIDTH // STRIDE :] = y[last, -(WIDTH // STRIDE)][:, None]
    return y


def pool(top: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: largest and mean of its chunks' responses; the chunks' responses; the first segment of each."""
    begin = np.cumsum(n) - n
    chunk = top.copy()
    chunk[:-1] = np.maximum(top[:-1], top[1:])
    chunk[begin + n - 1] = top[begin + n - 1]  # the last segment ends its document
    return np.concatenate([np.maximum.reduceat(chunk, begin), np.add.reduceat(chunk, begin) / n[:, None]], axis=1), chunk, begin


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01) -> ByteNet:
    """Adam on the logistic loss; gradients reach the positions that won a maximum."""
    net = ByteNet.start()
    if len(labels) == 0 or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    rng = np.random.default_rng(11)
    names = ("embedding", "filters", "bias", "head")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in (*names,)}
    step, m_off, v_off = 0, 0.0, 0.0
    parts = [segments([t]) for t in texts]
    flags = [repeats(d) for d, _ in parts]
    weight = np.where(labels == 0, 0.5 / max((labels == 0).mean(), 0.05), 1.0)
    weight /= weight.mean()
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        lr = rate * (1 - 0.9 * epoch / epochs)
        for s in range(0, len(order), batch):
            who = order[s : s + batch]
            n = np.array([int(parts[i][1][0]) for i in who])
            data = np.concatenate([parts[i][0][:-WIDTH] for i in who] + [np.zeros(WIDTH, np.uint8)])
            flag = np.concatenate([flags[i][:-WIDTH] for i in who] + [np.zeros(WIDTH, np.float32)])
            count = int(n.sum())
            last = last_segments(n)
            best, raw = np.empty((count, FILTERS), np.int64), np.empty((count, FILTERS), np.float32)
            for a in range(0, count, TILE):
                b = min(a + TILE, count)
                y = within((np.ascontiguousarray(net.windows(data, flag, a, b)) @ net.filters).reshape(b - a, _PART, FILTERS), last[a:b])
                best[a:b] = y.argmax(axis=1)
                raw[a:b] = np.take_along_axis(y, best[a:b, None], 1)[:, 0] + net.bias
            top = np.maximum(raw, 0)
            z, chunk, begin = pool(top, n)
            p = 1 / (1 + np.exp(-(z @ net.head + net.offset)))
            d = (weight[who] * (p - labels[who]) / len(who)).astype(np.float32)
            g = {"head": z.T @ d + 1e-4 * net.head}
            g_off = float(d.sum())
            doc = np.repeat(np.arange(len(who)), n)
            g_chunk = (d[:, None] * net.head[FILTERS:] / n[:, None])[doc]
            is_top = chunk == z[doc, :FILTERS]
            share = np.add.reduceat(is_top, begin, dtype=np.float32)
            g_chunk = g_chunk + is_top * (d[:, None] * net.head[:FILTERS] / share)[doc]
            g_top = np.zeros_like(top)
            nxt = np.zeros_like(top)
            nxt[:-1] = top[1:]
            nxt[begin + n - 1] = -1
            own = top >= nxt
            g_top += g_chunk * own
            g_top[1:] += (g_chunk * ~own)[:-1]
            g_top *= raw > 0
            g["bias"] = g_top.sum(0)
            g["filters"], g["embedding"] = np.zeros_like(net.filters), np.zeros_like(net.embedding)
            for a in range(0, count, 8 * TILE):
                b = min(a + 8 * TILE, count)
                at = ((np.arange(a, b)[:, None] * _PART + best[a:b]) * STRIDE)[:, :, None] + np.arange(WIDTH)
                byte, g_part = data[at], g_top[a:b]
                won = np.concatenate((net.embedding[byte], flag[at][..., None]), axis=3).reshape(b - a, FILTERS, -1)
                g["filters"] += np.einsum("cfk,cf->kf", won, g_part)
                g_x = (g_part[:, :, None] * net.filters.T[None]).reshape(-1, _CHANNELS)[:, :EMBEDDING]
                for e in range(EMBEDDING):
                    g["embedding"][:, e] += np.bincount(byte.reshape(-1), g_x[:, e], 256)
            step += 1
            for k in names:
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] * g[k] - v)
                setattr(net, k, (getattr(net, k) - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32))
            m_off += 0.1 * (g_off - m_off)
            v_off += 0.01 * (g_off * g_off - v_off)
            net.offset -= lr * (m_off / (1 - 0.9**step)) / ((v_off / (1 - 0.99**step)) ** 0.5 + 1e-6)
    return net


def held_out(doc_id) -> object:
    """Column: rows that never teach, by a checksum of doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ByteNet:
    """Fit on ``labels`` (doc_id, quality) of ``docs`` (doc_id, text). At most sample_rows whole texts reach the driver."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    chosen = hashed_sample(known, sample_rows, "doc_id", "quality")
    picked = [(r["doc_id"], r["quality"]) for r in chosen.collect()]
    if not picked:
        return fit([], np.zeros(0))
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["quality"], (r["text"] or "").encode()) for r in found.collect())
    return fit([b for _, _, b in rows], np.array([q for _, q, _ in rows], np.float32))


def score(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.score(texts), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (with a column text) that score at least ``threshold``, all columns kept."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
            yield batch.filter(pa.array(net.score(texts) >= threshold))

    return docs.mapInArrow(sift, docs.schema)
