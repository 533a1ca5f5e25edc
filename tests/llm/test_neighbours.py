"""Nearest neighbours against brute force."""

import math

import numpy as np
from compare import oracle_rows, spark_rows, views
from pyspark.sql import functions as F

from prefixloom.llm import neighbours as X


def added(values):
    total = 0.0  # the built-in sum compensates rounding
    for x in values:
        total += x
    return total


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = set()
    for q, a in good.items():
        if q % 3 == 0:
            scored = sorted((-added(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s + 0.0) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_odd_rows_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "LEAST_ROWS", 16)
    monkeypatch.setattr(X, "QUERY_BLOCK", 7)
    monkeypatch.setattr(X, "CANDIDATE_BLOCK", 11)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.25]) for i in range(200, 260)]  # ties
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 10**e]) for i, e in zip(range(300, 310), range(-5, 5))]
    rows += [(400, None), (402, [0.0] * 8), (405, [1.0, None] + [0.0] * 6), (408, [float("nan")] * 8), (411, [float("inf")] + [0.0] * 7),
             (None, [1.0] * 8), (414, []), (3, rows[3][1]), (6, [2.0] * 8), (417, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = X.nearest(df, F.col("vec_id") % 3 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {(r[0], r[1], r[2], r[3] + 0.0) for r in got.collect()} == brute(rows, 5)
    assert X.nearest(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 64)) * 100, rng.normal(size=(70, 64))
    q, c = X.Block(np.arange(50), a, None), X.Block(np.arange(70), b, 3)
    tile = (q.codes.astype(float) @ c.codes.astype(float).T) * q.scale[:, None] * c.scale
    bound = q.error[:, None] * c.norm + q.near_norm[:, None] * c.error
    assert (np.abs(tile - q.vectors @ c.vectors.T) <= bound + 1e-9).all()


def test_very_small_and_large_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1e-3).tolist()) for i in range(40)]
    rows += [(100 + i, [x, 0.0, 0.0, 0.0]) for i, x in enumerate([5e-324, 1e-310, 1e-200, 1e-120, 1e120, 1e200, -1e200, 1e300])]
    rows += [(201, [-1.0, 0.0, 0.0, 0.0]), (210, [5e-324, 1.0, 0.0, 0.0]), (300, [5e-324, 5e-324, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r[0], r[1], r[2], r[3] + 0.0) for r in X.nearest(df, F.col("vec_id") % 3 == 0, k=20).collect()}
    assert got == brute(rows, 20)
    few = [(3, [-1.0, 0.0, 0.0, 0.0]), (4, [5e-324, 0.0, 0.0, 0.0])] + [(10 + i, [1.0 + i, 0.0, 0.0, 0.0]) for i in range(30)]
    best = X.nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>"), F.col("vec_id") == 3, k=20).collect()
    assert len(best) == 20 and min(best, key=lambda r: r["rank"])["vec_id"] == 4


def test_single_precision_travels_as_such(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r[0], r[1], r[2], r[3] + 0.0) for r in X.nearest(df, F.col("vec_id") % 3 == 0, k=7).collect()}
    assert got == brute(rows, 7)


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(X.op6_neighbours(spark, folder)) == oracle_rows(views(folder), X.SQL)
