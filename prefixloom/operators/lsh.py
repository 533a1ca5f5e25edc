"""Approximate vector search by random hyperplanes: equal signatures are an equi-join.

A band is a set of hyperplanes through the mean of the pool. The sides on which a vector lies are its
signature, and band and signature together its bucket. A pool row lies in one bucket per band. A query asks, in every band, its
own bucket and those next to it: the sides that it is least sure of are changed first, in the
order of the sum of squared distances to the planes crossed. What shares a bucket is compared as a
matrix product. Small buckets are packed, many to a task; a large one is cut into blocks on both sides, so one
that holds a third of the rows is many tasks.

Signature length and number of bands are taken from the recall of a bounded sample of queries against
the exact search. All rows are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_up_to
from ..sources.tables import kept
from .lexical import Keep, lazy
from .ranking import best, top_k
from .vectors import POOL_BLOCK, PROBE_SAMPLE, QUERY_BLOCK, RECALL, TILE_VALUES, _matrix, _result_schema, _round, vector_topk

MOST_BITS = 20
MOST_BANDS = 32
PROBES = 8  # buckets of a band that a query asks
GROUP_COST = 64  # a bucket costs as much as comparing with so many vectors
STEP = 512  # vectors whose buckets are sought together


def flips(margins: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes) signatures to add by exclusive or, least sum of squared margins first; -1 where there are fewer.

    Of the ``probes`` least sums of subsets each has at most log2(probes) members, all among the probes - 1 smallest.
    """
    rows, bits = margins.shape
    cost = margins**2
    order = np.argsort(cost, axis=1, kind="stable")[:, :max(probes - 1, 0)]
    near = np.take_along_axis(cost, order, axis=1)
    size = min(int(np.log2(probes)), order.shape[1])
    subsets = [s for r in range(size + 1) for s in combinations(range(order.shape[1]), r)]
    member = np.zeros((len(subsets), order.shape[1]))
    for i, s in enumerate(subsets):
        member[i, list(s)] = 1
    sums = near @ member.T
    first = np.argsort(sums, axis=1, kind="stable")[:, :probes]
    values = (np.int64(1) << order.astype(np.int64))[:, None, :] * member[first].astype(np.int64)
    out = np.full((rows, probes), -1, np.int64)
    out[:, :first.shape[1]] = values.sum(axis=2)
    return out


class Planes:
    """Random hyperplanes (band, bit, component) through a centre; ``bits`` of each of ``bands`` bands are used."""

    def __init__(self, centre: np.ndarray, bits: int, bands: int, seed: int = 42):
        self.centre, self.bits, self.bands, self.seed = np.asarray(centre, np.float64), bits, bands, seed
        drawn = np.random.default_rng(seed).normal(size=(MOST_BANDS, MOST_BITS, len(self.centre)))
        self.planes = drawn[:bands, :bits]

    def margins(self, vecs: np.ndarray) -> np.ndarray:
        """(rows, bands, bits): signed distances to the planes, times the planes' lengths."""
        if not self.bits:
            return np.zeros((len(vecs), self.bands, 0))
        flat = self.planes.reshape(-1, len(self.centre))
        return ((vecs - self.centre) @ flat.T).reshape(len(vecs), self.bands, self.bits)

    def signatures(self, margins: np.ndarray) -> np.ndarray:
        return ((margins > 0).astype(np.int64) << np.arange(self.bits)).sum(axis=2)

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        """Numbers of (band, signature) for signatures of shape (rows, bands, ...)."""
        band = np.arange(self.bands, dtype=np.int64).reshape(1, -1, *[1] * (signature.ndim - 2))
        return band << MOST_BITS | signature

    def cells(self, vec: Column | str) -> Column:
        """The bucket of a vector in every band."""
        planes = self

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                yield pd.Series(list(planes.buckets(planes.signatures(planes.margins(_matrix(v))))) if len(v) else [], dtype=object)

        return of(vec)

    def asked(self, vec: Column | str, probes: int = PROBES) -> Column:
        """The buckets that a query asks, over all bands."""
        planes = self

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                parts = (v.iloc[i:i + STEP] for i in range(0, len(v), STEP))
                yield pd.Series([x for some in parts for x in planes.probed(_matrix(some), probes)], dtype=object)

        return of(vec)

    def probed(self, vecs: np.ndarray, probes: int) -> list[np.ndarray]:
        margins = self.margins(vecs)
        change = flips(margins.reshape(len(vecs) * self.bands, self.bits), probes).reshape(len(vecs), self.bands, probes)
        number = self.buckets(self.signatures(margins)[:, :, None] ^ np.maximum(change, 0))
        return [n[c >= 0] for n, c in zip(number, change)]

    def first_bands(self, queries: np.ndarray, found: np.ndarray, probes: int) -> np.ndarray:
        """(rows, bits): for signatures of 1, 2, .. bits the first band in which row i of ``queries`` asks the bucket of row i of ``found``; else ``bands``."""
        ours, theirs = self.margins(queries), self.margins(found)
        out = np.full((len(queries), self.bits), self.bands, np.int32)
        for bits in range(1, self.bits + 1):
            weight = np.int64(1) << np.arange(bits)
            apart = (((ours > 0) != (theirs > 0))[:, :, :bits] * weight).sum(axis=2)
            change = flips(ours[:, :, :bits].reshape(-1, bits), probes).reshape(len(queries), self.bands, probes)
            hit = (change == apart[:, :, None]).any(axis=2)
            out[:, bits - 1] = np.where(hit.any(axis=1), hit.argmax(axis=1), self.bands)
        return out

    @classmethod
    def fit(
        cls, queries: DataFrame, pool: DataFrame, k: int = 20, probes: int = PROBES, recall: float = RECALL, group_cost: int = GROUP_COST, seed: int = 42
    ) -> Planes:
        """The bits and bands of least work that hold ``recall`` of the exact top-k of PROBE_SAMPLE queries taken by hash.

        Work of a query is (bands x probes) buckets, each of rows / 2^bits vectors and ``group_cost``. Where that is
        more than comparing with all rows, there are no bits: one bucket holds all rows.
        """
        pool = usable(pool, "pid")
        rows = pool.count()
        if not rows:
            return cls(np.zeros(0), 0, 1, seed)
        centre = pool.agg(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))).first()[0].toArray()
        most = min(MOST_BITS, int(np.log2(rows)))
        if not most:
            return cls(centre, 0, 1, seed)
        trial = cls(centre, most, MOST_BANDS, seed)
        some = usable(queries, "qid").orderBy(F.xxhash64("qid"), "qid").limit(PROBE_SAMPLE)
        exact = vector_topk(some, pool, k).select("qid", "pid")
        pairs = exact.join(pool.withColumnRenamed("vec", "theirs"), "pid").join(some, "qid").select("vec", "theirs")

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def first(q: pd.Series, p: pd.Series) -> pd.Series:
            parts = (slice(i, i + STEP) for i in range(0, len(q), STEP))
            return pd.Series([x for at in parts for x in trial.first_bands(_matrix(q.iloc[at]), _matrix(p.iloc[at]), probes)], dtype=object)

        counts = np.zeros((most, MOST_BANDS + 1))
        per_band = pairs.select(F.posexplode(first("vec", "theirs")).alias("bit", "band")).groupBy("bit", "band").count()
        for r in per_band.collect():  # at most MOST_BITS x (MOST_BANDS + 1) counts
            counts[r["bit"], r["band"]] = r["count"]
        total = counts[0].sum()
        choices = [(float(rows), 0, 1)]
        for bit in range(most):
            held = np.cumsum(counts[bit, :MOST_BANDS])
            enough = np.flatnonzero(held >= recall * total)
            if total and len(enough):
                bits, bands = bit + 1, int(enough[0]) + 1
                choices.append((bands * min(probes, 2**bits) * (rows / 2**bits + group_cost), bits, bands))
        _, bits, bands = min(choices)
        return cls(centre, bits, bands, seed)


def usable(rows: DataFrame, key: str) -> DataFrame:
    """(key, vec) without null keys, null vectors, or vectors with null or non-finite components."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return rows.select(key, "vec").filter(F.col(key).isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad))


@dataclass
class LshIndex:
    """buckets(cell, pid, vec), one row per band, sizes(cell, n), and the planes."""

    buckets: DataFrame
    sizes: DataFrame
    planes: Planes

    @classmethod
    def read(cls, spark: SparkSession, folder: str, prefix: str = "lsh") -> LshIndex:
        row = kept(spark, f"{folder}/{prefix}_planes").first()
        buckets, sizes = (kept(spark, f"{folder}/{prefix}_{name}") for name in ("buckets", "sizes"))
        return cls(buckets, sizes, Planes(np.array(row["centre"]), row["bits"], row["bands"], row["seed"]))


def lsh_index(pool: DataFrame, planes: Planes, keep: Keep = lazy, name: str = "lsh") -> LshIndex:
    """The index of pool(pid, vec); rows that are not ``usable`` take no part.

    The planes are kept beside the buckets; what was kept before is used, planes too.
    """
    spark = pool.sparkSession
    row = [([float(x) for x in planes.centre], planes.bits, planes.bands, planes.seed)]
    row = keep(spark.createDataFrame(row, "centre array<double>, bits int, bands int, seed int"), f"{name}_planes").first()
    planes = Planes(np.array(row["centre"]), row["bits"], row["bands"], row["seed"])
    rows = usable(pool, "pid")
    buckets = rows.select(F.explode(planes.cells("vec")).alias("cell"), "pid", "vec")
    buckets = keep(buckets, f"{name}_buckets")
    return LshIndex(buckets, keep(buckets.groupBy("cell").agg(F.count("*").alias("n")), f"{name}_sizes"), planes)


def nearest_in_buckets(queries: pd.DataFrame, pool: pd.DataFrame, k: int) -> pd.DataFrame:
    """(qid, pid, score): the k best pool rows of every query within equal (cell, qb, pb), ties by pid."""
    keys = ["cell", "qb", "pb"]
    pool = pool.sort_values("pid", kind="stable")
    here, there = queries.groupby(keys).indices, pool.groupby(keys).indices
    qids, pids = queries["qid"].to_numpy(), pool["pid"].to_numpy()
    asked, vecs = (_matrix(x["vec"]) if len(x) else None for x in (queries, pool))
    parts = []
    for key in here.keys() & there.keys():
        at = there[key]
        keep, step = min(k, len(at)), max(1, TILE_VALUES // len(at))
        for i in range(0, len(here[key]), step):
            some = here[key][i:i + step]
            tile = _round(asked[some] @ vecs[at].T)
            floor = np.partition(tile, len(at) - keep, axis=1)[:, len(at) - keep]
            row, near = np.nonzero(tile >= floor[:, None])
            score = tile[row, near]
            order = np.lexsort((near, -score, row))
            row, near, score = row[order], near[order], score[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < keep
            parts.append((qids[some][row[top]], pids[at][near[top]], score[top]))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], []]
    return pd.DataFrame(dict(zip(("qid", "pid", "score"), columns)))


def vector_topk_lsh(queries: DataFrame, index: LshIndex, k: int = 20, probes: int = PROBES) -> DataFrame:
    """(qid, pid, score, rk): approximate top-k by inner product of queries(qid, vec).

    Only rows in buckets that some query asks are shuffled. A pair found in several bands counts once.
    """
    asked = usable(queries, "qid")
    asked = asked.select("qid", "vec", F.explode(index.planes.asked("vec", probes)).alias("cell"))
    n_q = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("nqb"))
    sizes = n_q.join(index.sizes, "cell").withColumn("npb", F.ceil(F.col("n") / F.lit(POOL_BLOCK)).cast("int"))
    packs = sizes.agg(F.ceil(F.sum(F.col("n") * F.col("nqb")) / F.lit(POOL_BLOCK))).scalar()
    sizes = broadcast_up_to(sizes.select("cell", "nqb", "npb"))
    pack = F.pmod(F.xxhash64("cell", "qb", "pb"), F.greatest(packs, F.lit(1)))

    def blocks(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def block_of(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    q = asked.join(sizes, "cell").withColumn("qb", block_of("qid", "nqb")).withColumn("pb", blocks("npb"))
    p = index.buckets.join(sizes, "cell").withColumn("pb", block_of("pid", "npb")).withColumn("qb", blocks("nqb"))
    q = q.select(pack.alias("pack"), F.struct("cell", "qb", "pb", "qid", "vec").alias("q"))
    p = p.select(pack.alias("pack"), F.struct("cell", "qb", "pb", "pid", "vec").alias("p"))
    schema = _result_schema(asked, index.buckets)

    def local(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        names = {"q": ["cell", "qb", "pb", "qid", "vec"], "p": ["cell", "qb", "pb", "pid", "vec"]}
        sides = (pd.DataFrame(list(x[c]), columns=names[c]) for x, c in ((qs, "q"), (ps, "p")))
        return nearest_in_buckets(*sides, k)

    pairs = q.groupBy("pack").cogroup(p.groupBy("pack")).applyInPandas(local, schema).dropDuplicates(["qid", "pid"])
    return top_k(pairs, ["qid"], best("score", "pid"), k)
