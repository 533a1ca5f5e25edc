"""The fitted encoder against plain numpy, and odd texts."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from prefixloom.functions.text import normalize_strict
from prefixloom.operators import encoder as E
from prefixloom.operators.vectors import embed, text_steps
from prefixloom.sources.tables import shared_folder, store


def matrix(texts, slots):
    """TF-IDF in plain loops, with unit rows."""
    counts = np.zeros((len(texts), slots))
    for i, t in enumerate(texts):
        padded = f" {t} "
        for j in range(len(padded) - 2):
            a, b, c = map(ord, padded[j:j + 3])
            counts[i, ((a << 42 | b << 21 | c) * int(E.MIX) % 2**64 >> 40) % slots] += 1
    weights = counts * (np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1)
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    return np.divide(weights, norm, out=np.zeros_like(weights), where=norm > 0)


def test_singular_values_are_those_of_numpy(spark, tables):
    pool = tables.pool()
    texts = [r["text"] for r in pool.select(normalize_strict("query").alias("text")).orderBy("text").collect()]
    fitted = E.FittedEncoder.fit(pool, dim=24)
    a = matrix(texts, E.SLOTS)
    exact = np.linalg.svd(a, compute_uv=False)[:24]
    assert np.all(np.abs(fitted.singular - exact) <= 0.01 * exact)
    assert np.allclose(fitted.basis.T @ fitted.basis, np.eye(24), atol=1e-8)
    want = a @ fitted.basis
    assert np.allclose(fitted(texts), want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-9)
    # a written encoder answers alike, also within tasks
    kept = E.FittedEncoder.read(store(spark, shared_folder(spark))(fitted.table(spark), "encoder"))
    rows = embed(pool.select(normalize_strict("query").alias("text")), "text", kept.maker()).collect()
    assert np.allclose([r["vec"] for r in rows], fitted([r["text"] for r in rows]))


def test_odd_texts(spark):
    """Null and empty texts and unknown trigrams are zero; repeated rows count as often as they are there."""
    pool = spark.createDataFrame([(t,) for t in ["red shoe", "red shoe", "blue hat", "a" * 50_000, "", None, "  "]], "query string")
    fitted = E.FittedEncoder.fit(pool, dim=8)
    out = fitted(["red shoe", "", "qqq zzz"])
    assert np.isclose(np.linalg.norm(out[0]), 1) and not out[1:].any()
    exact = np.linalg.svd(matrix(["red shoe", "red shoe", "blue hat", "a" * 50_000, "", "", ""], E.SLOTS), compute_uv=False)
    assert np.allclose(fitted.singular[:3], exact[:3], rtol=0.01) and np.allclose(fitted.singular[3:], 0, atol=1e-6)
    empty = E.FittedEncoder.fit(pool.limit(0), dim=4)
    assert not empty(["red shoe"]).any() and fitted([]).shape == (0, 8)


def test_the_fit_of_a_sample_is_bounded(spark):
    pool = spark.range(3_000).select(F.concat(F.lit("item "), F.hex(F.xxhash64("id"))).alias("query"))
    fitted = E.FittedEncoder.fit(pool, dim=4, passes=1, fit_rows=300)
    assert fitted.singular[0] ** 2 < 450  # no more than the rows that were read


def test_the_fit_reads_every_text(spark):
    """Beyond two million texts too: every text's trigrams are counted."""
    n, kinds = 2_100_000, 200
    fitted = E.FittedEncoder.fit(spark.range(n).select(F.concat(F.lit("t"), 100 + F.col("id") % kinds).alias("query")), dim=2, passes=1)
    _, slot, _ = E.trigram_counts([f"t{100 + i}" for i in range(kinds)], E.SLOTS)
    assert fitted.idf[slot].max() <= np.log((n + 1) / (n // kinds + 1)) + 1 + 1e-9


def test_memory_goes_by_characters_not_by_texts():
    """What is multiplied at once is bounded by characters; the vectors are those of single texts."""
    rng = np.random.default_rng(0)
    texts = ["", "a" * 50_000] + ["".join(map(chr, rng.integers(97, 123, 30 * (i % 40)))) for i in range(600)]
    assert [t for some in text_steps(texts, 1_000) for t in some] == texts
    assert all(len(some) == 1 or sum(map(len, some)) <= 1_000 for some in text_steps(texts, 1_000))
    fitted = E.FittedEncoder(np.ones(E.SLOTS), rng.normal(size=(E.SLOTS, 64)), np.ones(64))
    tracemalloc.start()
    got = fitted.project(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    assert np.array_equal(got, np.concatenate([fitted.project([t]) for t in texts]))
