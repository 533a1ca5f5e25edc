"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its lower-cased character n-grams of 3 to 6 characters, hashed into 2**20
features. The fit first takes, per feature, the log ratio of its smoothed document frequencies in
toxic and other texts, then learns one logistic weight per scaled feature with an L2 penalty. Both
are folded into one weight per feature, so that a score is one sum over the features of a text.

Every whole text is scored in one narrow pass; the model (4 MB whatever the input) travels with the
task. Only the fit is bounded: at most FIT_ROWS labelled texts of at most FIT_BYTES bytes each.

Null and empty texts have no feature and get the score of the intercept. Without labels of both
classes the score is the share of toxic labels (0 without labels) for every text. Repeated rows get
equal scores; an empty table gives an empty one; memory for a very long text is about 50 bytes per character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, labelled_sample, remainder, table, with_columns

BITS = 20
SIZES = (3, 4, 5, 6)
FIT_ROWS = 4_000
FIT_BYTES = 32_768
ROUNDS = 60
PENALTY = 1e-4
SMOOTHING = 0.5
ERRORS = 4.0  # standard errors by which the classes' document shares of a feature must differ
RATE = 0.3
PACK = 256  # texts whose features are added up together
REJECT = 0.7


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct hashed n-grams of one text, in order of a last occurrence."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, rolled = [], codes
    for size in range(2, max(SIZES) + 1):
        if len(codes) < size:
            break
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1:]
        if size in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * size)
            parts.append((mixed >> np.uint64(64 - bits)).astype(np.int32))
    if not parts:
        return np.zeros(0, np.int32)
    return np.concatenate(parts)


def distinct(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each value of found once; last is scratch space with an entry per possible value."""
    order = np.arange(len(found), dtype=np.int32)
    last[found] = order
    return found[last[found] == order]


@dataclass
class Model:
    weights: np.ndarray  # float32, one per feature: log-count ratio times learned weight
    intercept: float

    def scorer(self):
        weights, intercept = self.weights, self.intercept

        def compute(column: pa.Array) -> list:
            last = np.empty(len(weights), np.int32)
            logits = np.empty(len(column))
            for i, text in enumerate(column):
                found = distinct(grams(text.as_py() or ""), last)
                logits[i] = intercept + weights[found].sum(dtype=np.float64)
            return [1 / (1 + np.exp(-np.clip(logits, -500, 500)))]

        return compute


def fit(rows: list[tuple[str, int]], bits: int = BITS, rounds: int = ROUNDS) -> Model:
    """Weights from (text, 0 or 1) pairs."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    last = np.empty(1 << bits, np.int32)
    # n-grams are taken twice, so that only those of features that stay are held
    # document frequencies by class; a feature stays if the classes' shares differ by many standard errors
    toxic, other = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    for text, label in rows:
        (toxic if label else other)[distinct(grams(text), last)] += 1
    n_toxic, n_other = y.sum(), len(y) - y.sum()
    known = np.flatnonzero(toxic + other)
    toxic, other = toxic[known], other[known]
    pooled = (toxic + other) / len(y)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_other))
    stays = (error > 0) & (np.abs(toxic / n_toxic - other / n_other) >= ERRORS * error)
    known, toxic, other = known[stays], toxic[stays], other[stays]
    ratio = np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING))
    ratio -= np.log((other + SMOOTHING) / (n_other + 2 * SMOOTHING))
    slot = np.full(1 << bits, -1, np.int32)
    slot[known] = np.arange(len(known), dtype=np.int32)
    sets = [k[k >= 0] for k in (slot[distinct(grams(text), last)] for text, _ in rows)]

    # full-batch Adam on the mean logistic loss, both classes weighted alike; texts are added up some at a time
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    packs = []
    for first in range(0, len(sets), PACK):
        part = sets[first:first + PACK]
        packs.append((slice(first, first + len(part)), np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.int32), [len(s) for s in part])))
    del sets, slot, last
    weight, m, v = np.zeros(len(known)), np.zeros(len(known)), np.zeros(len(known))
    bias, bias_m, bias_v = 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        slope, bias_slope, scaled = PENALTY * weight, 0.0, weight * ratio
        for rows_of, columns, row in packs:
            own = y[rows_of]
            logit = np.bincount(row, weights=scaled[columns], minlength=len(own)) + bias
            error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - own) * balance[rows_of] / len(y)
            slope += np.bincount(columns, weights=error[row], minlength=len(known)) * ratio
            bias_slope += error.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        bias_m, bias_v = 0.9 * bias_m + 0.1 * bias_slope, 0.99 * bias_v + 0.01 * bias_slope**2
        a, b = 1 - 0.9**t, 1 - 0.99**t
        weight -= RATE * 0.1 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= RATE * (bias_m / a) / (np.sqrt(bias_v / b) + 1e-8)
    out = np.zeros(1 << bits, np.float32)
    out[known] = weight * ratio
    return Model(out, float(bias))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows; rows whose crc32(doc_id) mod 3 is 1 are held out."""
    rows = labelled_sample(docs, labels, "toxic", remainder(3, 1), FIT_ROWS, FIT_BYTES, balance=True)
    return fit(rows)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a toxicity score from 0 to 1 of every whole text; an old column ``out`` is replaced."""
    return with_columns(docs, text, {out: T.DoubleType()}, model.scorer())


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns only."""
    [name] = fresh("score")
    scored = score(docs, fitted(docs, labels), out=name)
    return scored.filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fitted(docs, table(spark, folder, "labels"))).drop("text")
    return scored.select(
        "doc_id", remainder(3, 1)(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )
