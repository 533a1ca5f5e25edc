"""Whitening against plain numpy over all rows."""

import math

import numpy as np
import pytest

from prefixloom.llm import whitening as W


def plain(rows, most=8, weights="copies"):
    """key -> (deviation, whitened up to sign), n, explained from (key, vector) rows of usable vectors."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows]
    fit = x if weights == "copies" else [list(v) for v in sorted({tuple(v) for v in x})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array([s / n for s in sums])
    cov = (np.array(fit) - centre).T @ (np.array(fit) - centre) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    kept = values > 1e-12 * values[0]
    values, vectors = values[kept], vectors[:, kept]
    out = {}
    for (key, _), v in zip(rows, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        out[key] = (deviation, (np.array(v) - centre) @ vectors / np.sqrt(values))
    return out, n, values / np.trace(cov)


def check(got, want, n, explained):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(want)
    size = len(explained)
    ours = np.array([[by[k][c + 1]["whitened"] for c in range(size)] for k in want])
    theirs = np.array([want[k][1] for k in want])
    flip = np.sign((ours * theirs).sum(axis=0))
    assert np.allclose(ours, theirs * flip, atol=1e-7)
    for k in want:
        assert sorted(by[k]) == list(range(1, size + 1))
        for c, r in by[k].items():
            assert (r["n"], r["deviation"]) == (n, want[k][0])
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9
            assert r["identity_error"] < 1e-9


def test_query_as_by_numpy(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(W.op11_whitening(spark, folder).collect(), *plain(rows))


@pytest.mark.parametrize("weights", ["copies", "one"])
def test_copies_and_odd_rows(spark, weights):
    rng = np.random.default_rng(2)
    some = rng.normal(0, 1, (40, 5)).tolist()
    good = [(i, v) for i, v in enumerate(some)] + [(100 + i, some[0]) for i in range(60)] + [(200 + i, some[i % 7]) for i in range(30)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] * 5),
           (904, []), (905, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n string, component string, key int, x array<int>"
    df = spark.createDataFrame([(k, v, "a", "b", 1, None) for k, v in good + odd], schema)
    got = W.whiten(df, weights=weights).collect()
    want, n, explained = plain(good, weights=weights)
    if weights == "one":  # the fit is of distinct vectors, identity holds over them
        assert n == 40
    check(got, want, n, explained)
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.filter("vec_id >= 900 and vec_id < 905")).count() == 0


def test_repeated_keys_null_keys_and_flat_dimensions(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0]), (3, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = W.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 4), (1, 1, 4), (1, 1, 4), (3, 1, 4)]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert W.whiten(df.filter("vec_id = 1")).count() == 0  # all equal: no variance


def test_deviations_are_exact_or_null(spark):
    rows = [(1, [0.0]), (2, [1e6]), (3, [1e9]), (4, [1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] is None
    part = {r["vec_id"]: r["deviation"] for r in W.whiten(df.filter("vec_id < 3")).collect()}
    assert part == {1: (1024 * 10**6) ** 2, 2: (1024 * 10**6) ** 2}
    model = W.Whitening(3, [10, 3], np.zeros(0), np.zeros((0, 2)), 1.0)
    assert model.deviations(np.array([[3, 1], [10**9, 1], [2 * 10**9, 1]])) == [1, (3 * 10**9 - 10) ** 2, None]
