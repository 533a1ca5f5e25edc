"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of 32 bytes that overlap by half and together cover the whole text (the last
one is filled up with a mark of its own). A chunk's input is a learned vector for each of its bytes, and
how much of the chunk equals the bytes 1, 2, ... LAGS before and the largest of these shares, which show
repeats whatever is repeated.
Learned filters over this input, rectified, are max-pooled over all chunks of the text; the pooled
values are combined by one more layer of learned weights into the probability of label 1.

The fit is a plain gradient descent (Adam) on at most FIT_ROWS labelled texts of at most FIT_BYTES
bytes, with the classes in their own shares, on the driver. Scoring takes whole texts in one narrow
pass; the filters' values are held for a block of chunks only, the chunks' lag shares (about 28 bytes per byte) for the whole
text at hand. The model has a few thousand numbers.

Null and empty texts are one chunk of marks. Without labels of both classes every score is the share of
label 1 (0.5 without labels). Repeated rows get equal scores. An old column ``out`` is replaced; an empty
table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, labelled_sample, remainder, table, with_columns

CHUNK, STEP = 32, 16
DIM, FILTERS, LAGS = 6, 24, 32
INPUTS = CHUNK * DIM + LAGS + 1
MARK = 256  # what stands after the end of a text
FIT_ROWS = 3_000
FIT_BYTES = 16_384
STEPS = 500
BATCH = 64
RATE = 0.01
DECAY = 1e-4
CHUNKS_AT_ONCE = 8_192
ACCEPT = 0.3


def chunks(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of one text as rows of byte codes, and their shares of equal bytes by lag."""
    n = max(1, -(-max(len(body) - CHUNK, 0) // STEP) + 1)
    padded = np.full((n - 1) * STEP + CHUNK, MARK, np.int16)
    padded[:len(body)] = body
    codes = np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (2 * STEP, 2))
    halves = np.empty((n + 1, LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(padded), np.uint8)
        same[lag:len(body)] = body[lag:] == body[:len(body) - lag] if lag < len(body) else 0
        halves[:, lag - 1] = same.reshape(-1, STEP).sum(1, dtype=np.float32)
    share = (halves[:-1] + halves[1:]) / CHUNK
    return codes, np.concatenate([share, share.max(1, keepdims=True)], axis=1)


@dataclass
class Model:
    vectors: np.ndarray  # (257, DIM)
    filters: np.ndarray  # (INPUTS, FILTERS)
    offsets: np.ndarray
    weights: np.ndarray  # (FILTERS,)
    intercept: float

    def pooled(self, body: np.ndarray, where: bool = False):
        """The filters' largest rectified values over all chunks of a text (and the chunks that have them)."""
        codes, lags = chunks(body)
        best, at = np.zeros(len(self.weights), np.float32), np.zeros(len(self.weights), np.int64)
        for first in range(0, len(codes), CHUNKS_AT_ONCE):
            part = codes[first:first + CHUNKS_AT_ONCE]
            x = self.vectors[part].reshape(len(part), -1) @ self.filters[:CHUNK * DIM]
            x += lags[first:first + CHUNKS_AT_ONCE] @ self.filters[CHUNK * DIM:]
            x += self.offsets
            top = x.argmax(0)
            value = x[top, np.arange(x.shape[1])]
            at = np.where(value > best, first + top, at)
            best = np.maximum(best, value)
        return (best, at, codes, lags) if where else best

    def scorer(self):
        def compute(column: pa.Array) -> list:
            body, ends = flat(column)
            logits = np.array([self.pooled(body[a:b]) @ self.weights + self.intercept for a, b in zip(ends[:-1], ends[1:])], float)
            return [1 / (1 + np.exp(-np.clip(logits, -500, 500)))]

        return compute


def fit(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 7) -> Model:
    """A network from (text, 0 or 1) pairs; the same for the same pairs."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.5, (257, DIM)).astype(np.float32), rng.normal(0, 0.1, (INPUTS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    y = np.array([label for _, label in rows], float)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    model.intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        model.weights[:] = 0
        return model
    bodies = [np.frombuffer(text.encode(), np.uint8) for text, _ in rows]
    names = ("vectors", "filters", "offsets", "weights")
    first = {n: np.zeros_like(getattr(model, n)) for n in names}
    second = {n: np.zeros_like(getattr(model, n)) for n in names}
    bias_first = bias_second = 0.0
    for t in range(1, steps + 1):
        rate = RATE * (1 - t / (steps + 1))
        batch = rng.choice(len(rows), min(BATCH, len(rows)), replace=False)
        slope = {n: DECAY * getattr(model, n) for n in names}
        bias_slope = 0.0
        for i in batch:
            best, at, codes, lags = model.pooled(bodies[i], where=True)
            error = (1 / (1 + np.exp(-float(best @ model.weights + model.intercept))) - y[i]) / len(batch)
            slope["weights"] += error * best
            bias_slope += error
            live = np.flatnonzero(best > 0)
            back = (error * model.weights[live]).astype(np.float32)
            seen = codes[at[live]]
            x = np.concatenate([model.vectors[seen].reshape(len(live), -1), lags[at[live]]], axis=1)
            slope["filters"][:, live] += (x * back[:, None]).T
            slope["offsets"][live] += back
            into = (model.filters[:CHUNK * DIM, live] * back).T.reshape(-1, DIM)
            np.add.at(slope["vectors"], seen.ravel(), into)
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * slope[n]
            second[n] = 0.99 * second[n] + 0.01 * slope[n] ** 2
            move = rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.99**t)) + 1e-7)
            setattr(model, n, (getattr(model, n) - move).astype(np.float32))
        bias_first = 0.9 * bias_first + 0.1 * bias_slope
        bias_second = 0.99 * bias_second + 0.01 * bias_slope**2
        model.intercept -= rate * (bias_first / (1 - 0.9**t)) / (np.sqrt(bias_second / (1 - 0.99**t)) + 1e-7)
    return model


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The network of the labelled rows; rows whose crc32(doc_id) mod 5 is 0 are held out."""
    return fit(labelled_sample(docs, labels, "quality", remainder(5, 0), FIT_ROWS, FIT_BYTES, balance=False))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of good quality of every whole text."""
    return with_columns(docs, text, {out: T.DoubleType()}, model.scorer())


def op1_quality(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fitted(docs, table(spark, folder, "labels"))).drop("text")
    return scored.select(
        "doc_id", remainder(5, 0)(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
