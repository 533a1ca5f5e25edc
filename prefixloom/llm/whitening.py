"""Embedding whitening by weighted multiplicity covariance.

An entry c of a vector, as double, becomes the integer x = floor(1024 c) + 100000. Identical x vectors are
grouped, with their number as weight (or one, ``weights="one"``: every distinct vector counts once in the
fit). Sums of the fit give the mean S / n; a weighted product of the centred distinct vectors gives the
covariance V, task by task, of which only the sums by cell meet on the driver (they depend on the length of
the vectors alone). Each distinct vector is projected once on the first unit eigenvectors of V over the roots
of their eigenvalues, and the rows get the result by a join on x.

Scale. Copies are counted before the shuffle, so a vector with a third of all rows is one row of the fit. In
the join back the vectors that have more than a HOT-th part of all rows (less than HOT of them) are broadcast
and their rows stay where they are; the rest is a plain join. Distinct and whitened vectors are written
to the shared folder, nothing is held in executors.

Rows whose vector is null, or holds null, NaN or infinite entries, are dropped; so are empty vectors and those
of another length than most (of equally frequent lengths the larger). Entries beyond 2**52 count as 2**52
(below -2**52 as that). Components with no variance (an eigenvalue under 1e-12 of the largest) have no
whitened value and are left out, so a table whose vectors are all equal gives no rows, as does an empty one.
A ``deviation`` that a long cannot hold is null. Repeated rows keep their number, rows with a null key theirs.
Eigenvectors have a positive largest entry. Other columns of the table are not returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EDGE = float(1 << 62)
FLAT = 1e-12
HOT = 256
BATCH = 4_096


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the usable rows of the prevailing length."""
    wide = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    lengths = wide.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not lengths:
        return wide.select("key", F.col("vector").cast("array<long>").alias("x")).limit(0)
    whole = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-EDGE)), F.lit(EDGE))) + SHIFT
    return wide.filter(F.size("vector") == lengths[0]["length"]).select("key", F.transform("vector", whole).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass
class Whitening:
    """What a fit gives: n, the sums S, eigenvalues and eigenvectors (rows) of the kept components, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part is taken off first, without rounding."""
        return (x - np.array([s // self.n for s in self.sums])) - np.array([s % self.n for s in self.sums]) / self.n

    def deviations(self, x: np.ndarray) -> list:
        """The sums of (n x - S)**2 over the dimensions, exact; null where they leave the range of a long."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums])
        near = ((self.n * (x.astype(float) - whole) - rest) ** 2).sum(axis=1)
        small = near < 9e18
        with np.errstate(over="ignore"):
            exact = ((self.n * (x - whole) - rest) ** 2).sum(axis=1)
        out = exact.astype(object)
        for i in np.flatnonzero(~small):
            value = sum((self.n * int(c) - s) ** 2 for c, s in zip(x[i], self.sums))
            out[i] = value if value < 1 << 63 else None
        return list(out)

    def project(self, distinct: DataFrame) -> DataFrame:
        """distinct (x, copies) with ``deviation`` and the array ``whitened``."""
        own = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("x"))
                w = own.centred(x) @ own.vectors.T / np.sqrt(own.values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x"), batch.column("copies"), pa.array(own.deviations(x), pa.int64()),
                     pa.array(list(w), pa.list_(pa.float64()))], ["x", "copies", "deviation", "whitened"])

        return distinct.mapInArrow(run, "x array<long>, copies long, deviation long, whitened array<double>")


def cell_sums(distinct: DataFrame, cells, dtype: str) -> dict[int, object]:
    """Sums by cell number: cells(x, weight) gives the part of one batch, a task adds its batches up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = cells(matrix(batch.column("x")), batch.column("weight").to_numpy())
                total = part if total is None else total + part
        if total is not None:
            kind = pa.float64() if dtype == "double" else pa.string()
            values = pa.array(total, kind) if dtype == "double" else pa.array([str(v) for v in total], kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), values], ["cell", "part"])

    fed = distinct.select("x", "weight").mapInArrow(run, f"cell long, part {'double' if dtype == 'double' else 'string'}")
    kind = "double" if dtype == "double" else "decimal(38,0)"
    return {r["cell"]: r["total"] for r in fed.groupBy("cell").agg(F.sum(F.col("part").cast(kind)).alias("total")).collect()}


def exact_sums(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """n and the weighted sums by dimension as Python integers."""
    if float(np.abs(x).max()) * float(weight.sum()) < 9e18:
        return np.concatenate([[weight.sum()], (x * weight[:, None]).sum(axis=0)]).astype(object)
    return np.concatenate([[weight.astype(object).sum()], (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0)])


def fit(distinct: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The fit of distinct vectors x with an integer ``weight``; None without variance."""
    distinct.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    sums = cell_sums(distinct, exact_sums, "exact")
    if not sums:
        return None
    n, sums = int(sums[0]), [int(sums[i]) for i in range(1, len(sums))]
    dim = len(sums)
    mean = Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0)
    upper = np.triu_indices(dim)

    def products(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        c = mean.centred(x)
        return (c.T @ (c * weight[:, None]))[upper]

    cells = cell_sums(distinct, products, "double")
    cov = np.zeros((dim, dim))
    cov[upper] = np.array([cells[i] for i in range(len(upper[0]))]) / n
    cov = np.triu(cov) + np.triu(cov, 1).T
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1].T[:most]
    kept = values > FLAT * max(values[0], 0)
    if not kept.any():
        return None
    values, vectors = values[kept], vectors[kept]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return Whitening(n, sums, values, vectors * sign[:, None], float(np.trace(cov)))


def identity_error(whitened: DataFrame, n: int, size: int) -> float:
    """The largest absolute entry of the weighted covariance of ``whitened`` minus the identity."""
    w = [F.col("whitened")[i] for i in range(size)]
    means = whitened.agg(*[(F.sum(w[i] * F.col("weight")) / n).alias(f"m{i}") for i in range(size)]).first()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    cov = whitened.agg(*[
        (F.sum((w[i] - means[i]) * (w[j] - means[j]) * F.col("weight")) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, weights: str = "copies") -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    if weights not in ("copies", "one"):
        raise ValueError("weights is copies or one")
    result = (f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    rows = written(integers(df, key, vector))
    weight = F.col("copies") if weights == "copies" else F.lit(1).cast("long")
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("copies")))
    model = fit(distinct.withColumn("weight", weight), most)
    if model is None:
        return df.sparkSession.createDataFrame([], result)
    done = written(model.project(distinct))
    error = identity_error(done.withColumn("weight", weight), model.n, len(model.values))
    n_rows = rows.count()
    hot = F.broadcast(done.filter(F.col("copies") * HOT > n_rows))  # fewer than HOT vectors
    cold = done.filter(F.col("copies") * HOT <= n_rows)
    got = ["key", "deviation", "whitened"]
    joined = rows.join(hot, "x").select(*got).unionByName(
        rows.join(hot.select("x"), "x", "left_anti").join(cold, "x").select(*got))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return joined.select("key", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op11_whitening(spark, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
