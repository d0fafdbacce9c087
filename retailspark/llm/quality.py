"""Quality by a byte-level convolutional network in numpy.

The bytes of the whole text, in overlapping chunks, go through learned byte
embeddings (and a channel that tells how recently a byte's four-gram was seen in
the chunk), a convolution and a max-pool over each chunk; the strongest and the
mean response of the chunks feed a logistic output, so one probability comes from
all of the document.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from retailspark.llm.common import bounded_batches, labelled_sample, whole, with_scores

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows of each label that are learned from, and chunks that are kept of
#: each (a run from a place picked by hash; some 15 KB, which few texts exceed).
TRAIN_ROWS, KEPT_CHUNKS = 2_000, 32
#: The decision that goes with the score: 1 from here on.
THRESHOLD = 0.3
EMBEDDING, FILTERS, WIDTH, STRIDE = 8, 32, 8, 2
#: Bytes of a chunk and the distance of two starts; neighbours overlap by more than a filter.
CHUNK, STEP = 512, 480
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 3e-3, 1e-4, 11
#: Chunks of a training step, but for its last text.
STEP_CHUNKS = 384
#: Chunks that are convolved at once.
AT_ONCE = 256
PAD = 256


@dataclass(frozen=True)
class ByteNet:
    embedding: np.ndarray  # 257 x EMBEDDING; the last for padding
    filters: np.ndarray  # (WIDTH * (EMBEDDING + 1)) x FILTERS
    bias: np.ndarray
    output: np.ndarray  # 2 * FILTERS: of the strongest and the mean chunk
    intercept: float

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses of (n x CHUNK) byte numbers."""
        return np.concatenate([_convolve(self, chunks[i : i + AT_ONCE])[0].max(axis=1) for i in range(0, len(chunks), AT_ONCE)]) if len(chunks) else np.zeros((0, len(self.bias)))

    def probability(self, texts: list[bytes]) -> np.ndarray:
        """Of each whole text, in the order given."""
        chunks, owner = cut(texts)
        pooled = self.responses(chunks)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.maximum.reduceat(pooled, first, axis=0)
        mean = np.add.reduceat(pooled, first, axis=0) / np.diff(np.append(first, len(owner)))[:, None]
        z = np.concatenate([best, mean], axis=1) @ self.output + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def encode(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover all bytes of each text, padded at its end,
    and the number of the text each belongs to.  An empty text has one of padding."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, dtype=np.uint8).astype(np.int16)
        n = max(1, -(-(len(raw) - CHUNK) // STEP) + 1) if len(raw) > CHUNK else 1
        padded = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.int16)
        padded[: len(raw)] = raw
        parts.append(np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP])
        owner += [i] * n
    return np.concatenate(parts), np.array(owner)


def recency(chunks: np.ndarray) -> np.ndarray:
    """16 / (16 + distance) to the last place in the chunk where the four bytes up
    to here stood too, by a 16-bit hash of them; 0 where they are new."""
    c = chunks.astype(np.uint32)
    code = (c[:, 3:] * 40503 + c[:, 2:-1] * 30011 + c[:, 1:-2] * 20011 + c[:, :-3] * 10007) & 0xFFFF
    order = np.argsort(code.astype(np.uint16), axis=1, kind="stable")
    code = np.take_along_axis(code, order, axis=1)
    near = np.where(code[:, 1:] == code[:, :-1], 16.0 / (16.0 + np.abs(order[:, 1:] - order[:, :-1])), 0.0).astype(np.float32)
    out = np.zeros(chunks.shape, dtype=np.float32)
    np.put_along_axis(out[:, 3:], order[:, 1:], near, axis=1)
    out[chunks == PAD] = 0
    return out


def _convolve(net: ByteNet, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectified responses (n x positions x FILTERS) and the embedded windows."""
    embedded = np.concatenate([net.embedding[chunks], recency(chunks)[:, :, None]], axis=2)
    windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1)[:, ::STRIDE]
    windows = windows.transpose(0, 1, 3, 2).reshape(len(chunks), -1, WIDTH * embedded.shape[2])
    return np.maximum(windows @ net.filters + net.bias, 0), windows


def fit(texts: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
    """Adam on the logistic loss, both labels weighing the same in all; for one
    label only, a net that always says so.  Every step sees all chunks of its texts,
    as scoring does: up to ``BATCH`` texts, or as many as have ``STEP_CHUNKS`` chunks."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = [
        (rng.normal(size=(257, EMBEDDING)) * 0.5).astype(f32), (rng.normal(size=(WIDTH * (EMBEDDING + 1), FILTERS)) / np.sqrt(WIDTH * EMBEDDING)).astype(f32),
        np.zeros(FILTERS, f32), (rng.normal(size=2 * FILTERS) * 0.1).astype(f32), np.zeros(1, f32),
    ]
    moment, spread, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    y = labels.astype(f32)
    if not len(y) or y.min() == y.max():
        share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
        return ByteNet(p[0], p[1], p[2], p[3] * 0, float(np.log(share / (1 - share))))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(f32)
    cuts = [cut([t])[0] for t in texts]
    sizes = np.array([len(c) for c in cuts])
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for rows in _steps(order, sizes):
            chunks, size = np.concatenate([cuts[r] for r in rows]), sizes[rows]
            first = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(rows)), size)
            net = ByteNet(p[0], p[1], p[2], p[3], float(p[4][0]))
            relu, windows = _convolve(net, chunks)
            where = relu.argmax(axis=1)  # chunk x filter: the position that won
            pooled = np.take_along_axis(relu, where[:, None, :], axis=1)[:, 0]
            best = np.maximum.reduceat(pooled, first, axis=0)
            mean = np.add.reduceat(pooled, first, axis=0) / size[:, None]
            joined = np.concatenate([best, mean], axis=1)
            z = joined @ p[3] + p[4]
            dz = (1 / (1 + np.exp(-z)) - y[rows]) * weight[rows] / len(rows)
            d_joined = dz[:, None] * p[3]
            # The strongest chunk gets the gradient of the maximum, all get the mean's share.
            won = pooled == best[owner]
            d_pooled = d_joined[owner, :FILTERS] * won / np.maximum(np.add.reduceat(won, first, axis=0, dtype=f32)[owner], 1) + d_joined[owner, FILTERS:] / size[owner][:, None]
            d_pooled = (d_pooled * (pooled > 0)).astype(f32)
            winners = np.take_along_axis(windows, where[:, :, None], axis=1)  # chunk x filter x window
            d_filters = np.einsum("cf,cfw->wf", d_pooled, winners)
            d_windows = d_pooled[:, :, None] * p[1].T[None]
            byte = chunks[np.arange(len(chunks))[:, None, None], where[:, :, None] * STRIDE + np.arange(WIDTH)]
            d_embedding = np.zeros_like(p[0])
            np.add.at(d_embedding, byte.reshape(-1), d_windows.reshape(-1, EMBEDDING + 1)[:, :EMBEDDING])
            gradients = [d_embedding, d_filters, d_pooled.sum(axis=0), joined.T @ dz, dz.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(gradients):
                g = g.astype(f32) + (DECAY * p[k] if k in (1, 3) else 0)
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                p[k] = (p[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)).astype(f32)
    return ByteNet(p[0], p[1], p[2], p[3], float(p[4][0]))


def _steps(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """``order`` in batches of bounded work."""
    start = chunks = 0
    for i, r in enumerate(order.tolist()):
        chunks += sizes[r]
        if chunks >= STEP_CHUNKS or i + 1 - start == BATCH or i == len(order) - 1:
            yield order[start : i + 1]
            start, chunks = i + 1, 0


def _kept(text: bytes) -> bytes:
    n = -(-(len(text) - CHUNK) // STEP) + 1
    if n <= KEPT_CHUNKS:
        return text
    start = zlib.crc32(text) % (n - KEPT_CHUNKS + 1) * STEP
    return text[start : start + (KEPT_CHUNKS - 1) * STEP + CHUNK]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> ByteNet:
    """Learns from at most ``rows`` labelled documents of each label, the first by
    hash of the id; some 15 KB of each, at most, reach the driver, where the net is fitted."""
    sample = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows)
    sample = bounded_batches(sample.select("id", F.col("label").cast("int").alias("label"), whole(F.col("text")).alias("text")))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "text": [_kept(t) for t in encode(batch["text"].tolist())]})

    got = sample.mapInPandas(kept, f"id {dict(sample.dtypes)['id']}, label int, text binary").orderBy("id").collect()
    return fit([bytes(r["text"]) for r in got], np.array([r["label"] for r in got]))


def score(docs: DataFrame, net: ByteNet, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of good quality, from
    all bytes of the text alone.  Null is an empty text.  Every row is scored by
    itself: repeats agree, and an empty table stays empty."""

    def judge(texts: list[str]) -> list[np.ndarray]:
        raw, parts = encode(texts), []
        at = size = 0
        for i, t in enumerate(raw):  # some 2 MB at a time
            size += len(t)
            if size > 2_000_000 or i == len(raw) - 1:
                parts.append(net.probability(raw[at : i + 1]))
                at, size = i + 1, 0
        return [np.concatenate(parts)]

    return with_scores(docs, text_col, judge, [StructField(out, DoubleType())])
