"""A text encoder fitted to the pool: leading singular directions of its TF-IDF matrix of character trigrams.

Rows of the matrix A are texts, scaled to unit length; columns are hash slots of trigrams. The
directions come from randomised subspace iteration: in every pass, tasks multiply their rows with the present basis
and back (A'(AQ)), Spark adds the parts up by slot, and the driver orthonormalises the sum. The sums have
``slots`` x (dim + MORE) numbers, however many texts there are. The fit reads all of them unless it is asked for fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_strict
from ..session import cut_lineage
from .vectors import EMBED_DIM, TEXT_STEP, text_steps

SLOTS = 2**13
MORE = 16  # directions beyond dim that the iteration carries along
PASSES = 4
FIT_TASKS = 64  # tasks, at least, whose partial sums are added up
TASK_ROWS = 250_000  # texts of a task beyond that
STEP = 2**14  # characters of texts multiplied at once: as many rows of the basis
MIX = np.uint64(0x9E3779B97F4A7C15)


def trigram_counts(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of the trigrams of every text with one blank on either side, by row and slot."""
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    flat = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(flat) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    row = np.repeat(np.arange(len(texts)), size)
    code = (flat[:-2] << np.uint64(42) | flat[1:-1] << np.uint64(21) | flat[2:]) * MIX
    slot = ((code >> np.uint64(40)) % np.uint64(slots)).astype(np.int64)
    inside = row[:-2] == row[2:]
    key, count = np.unique(row[:-2][inside] * slots + slot[inside], return_counts=True)
    return key // slots, key % slots, count


def weighted(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): TF-IDF with rows of unit length; a text without trigrams has no entries."""
    row, slot, count = trigram_counts(texts, len(idf))
    value = count * idf[slot]
    norm = np.sqrt(np.bincount(row, value**2, len(texts)))
    return row, slot, value / norm[row]


def products(texts: list[str], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(texts, basis columns): A times the basis."""
    row, slot, value = weighted(texts, idf)
    out = np.zeros((len(texts), basis.shape[1]))
    if len(row):
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[start]] = np.add.reduceat(value[:, None] * basis[slot], start, axis=0)
    return out


class FittedEncoder:
    """``idf`` of the slots and ``basis`` (slots, dim); ``singular`` are the singular values of the fitted matrix."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, singular: np.ndarray):
        self.idf, self.basis, self.singular = idf, basis, singular

    def project(self, texts: list[str]) -> np.ndarray:
        parts = [products(some, self.idf, self.basis) for some in text_steps(texts, STEP)]
        return np.concatenate(parts) if parts else np.zeros((0, self.basis.shape[1]))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; 0 for a text without trigrams, or with none that the pool has."""
        out = self.project(texts)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

    def maker(self) -> Callable:
        """What ``embed`` and ``Engine`` take as make_encoder."""
        return lambda: self

    @classmethod
    def fit(
        cls, pool: DataFrame, text: Column | str = "query", dim: int = EMBED_DIM, slots: int = SLOTS, passes: int = PASSES,
        fit_rows: int | None = None, seed: int = 42,
    ) -> FittedEncoder:
        """From strictly normalised texts, all of them or about ``fit_rows`` taken by hash; null counts as empty. A pool without
        trigrams gives zero vectors."""
        texts = pool.select(normalize_strict(text).alias("text"))
        rows = texts.count()
        if fit_rows is not None and rows > fit_rows:
            share = int(fit_rows / rows * 2**32)
            texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(2**32)) < share)
        texts = cut_lineage(texts.repartition(max(FIT_TASKS, -(-rows // TASK_ROWS)), F.xxhash64("text")))  # read by every pass

        def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, df = 0, np.zeros(slots, np.int64)
            for batch in batches:
                n += len(batch)
                for some in text_steps(batch["text"].tolist(), TEXT_STEP):
                    df += np.bincount(trigram_counts(some, slots)[1], minlength=slots)
            at = np.flatnonzero(df)
            yield pd.DataFrame({"slot": np.append(at, -1), "n": np.append(df[at], n)})

        counted = texts.mapInPandas(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # slots + 1 rows
        df = np.zeros(slots + 1, np.int64)
        df[counted["slot"].to_numpy()] = counted["n"].to_numpy()  # place -1 is the number of texts
        idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
        width = min(dim + MORE, max(int((df[:-1] > 0).sum()), 1))
        basis = np.random.default_rng(seed).normal(size=(slots, width)) * (df[:-1] > 0)[:, None]
        basis, _ = np.linalg.qr(basis)
        for _ in range(passes):
            image = cls._image(texts, idf, basis)
            square = basis.T @ image
            last = basis
            basis, _ = np.linalg.qr(image)
        # the directions within the basis that the last image was taken of
        values, turn = np.linalg.eigh((square + square.T) / 2)
        order = np.argsort(-values, kind="stable")[:dim]
        directions = np.zeros((slots, dim))
        directions[:, :len(order)] = last @ turn[:, order]
        singular = np.zeros(dim)
        singular[:len(order)] = np.sqrt(np.maximum(values[order], 0))
        directions[:, singular < 1e-9] = 0
        return cls(idf, directions, singular)

    @staticmethod
    def _image(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """A'A times the basis."""
        shared = texts.sparkSession.sparkContext.broadcast((idf, basis))

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            idf, basis = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                for some in text_steps(batch["text"].tolist(), STEP):
                    row, slot, value = weighted(some, idf)
                    if not len(row):
                        continue
                    order = np.argsort(slot, kind="stable")
                    start = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) > 0]))
                    sent = value[order, None] * products(some, idf, basis)[row[order]]
                    total[slot[order[start]]] += np.add.reduceat(sent, start, axis=0)
            at = np.flatnonzero(total.any(axis=1))
            if len(at):
                yield pd.DataFrame({"slot": at, "part": list(total[at])})

        added = texts.mapInPandas(parts, "slot long, part array<double>").groupBy("slot").agg(
            vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")).toPandas()  # at most ``slots`` rows
        shared.unpersist()
        out = np.zeros_like(basis)
        if len(added):
            out[added["slot"].to_numpy()] = np.stack(added["total"].to_numpy())
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(slot, idf, direction), and the singular values as the row of slot -1."""
        rows = [(-1, 0.0, self.singular.tolist())] + [(i, float(w), d.tolist()) for i, (w, d) in enumerate(zip(self.idf, self.basis))]
        return spark.createDataFrame(rows, "slot long, idf double, direction array<double>")

    @classmethod
    def read(cls, table: DataFrame) -> FittedEncoder:
        rows = table.orderBy("slot").toPandas()
        matrix = np.stack(rows["direction"].to_numpy())
        return cls(rows["idf"].to_numpy()[1:], matrix[1:], matrix[0])
