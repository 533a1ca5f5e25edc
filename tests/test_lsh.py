"""Hyperplane search: order of probes, buckets, recall, hot buckets and odd rows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.operators import graph, vectors
from prefixloom.operators import lsh as H
from prefixloom.sources.tables import shared_folder, store


def clustered(rng, n, d=16, centres=40, noise=0.15):
    x = rng.normal(size=(centres, d))[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, ids, vecs, name="pid"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, vecs)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("bits,probes", [(0, 8), (1, 8), (3, 8), (6, 1), (6, 8), (9, 16)])
def test_probes_are_the_cheapest_changes(bits, probes):
    """Against all 2^bits changes, sorted by their cost."""
    margins = np.random.default_rng(bits).normal(size=(20, bits))
    got = H.flips(margins, probes)
    for m, row in zip(margins, got):
        every = [s for r in range(bits + 1) for s in combinations(range(bits), r)]
        cost = {sum(1 << i for i in s): sum(m[i] ** 2 for i in s) for s in every}
        want = sorted(cost, key=cost.get)[:probes]
        assert row.tolist() == want + [-1] * (probes - len(want))


def test_buckets_by_plain_loops():
    rng = np.random.default_rng(1)
    planes = H.Planes(rng.normal(size=5), 4, 3)
    vecs = rng.normal(size=(30, 5))
    got = planes.buckets(planes.signatures(planes.margins(vecs)))
    for v, row in zip(vecs, got):
        for band in range(3):
            signature = sum(1 << j for j in range(4) if (v - planes.centre) @ planes.planes[band, j] > 0)
            assert row[band] == band * 2**H.MOST_BITS + signature
    first = planes.first_bands(vecs[:10], vecs[10:20], 2)
    for i in range(10):
        for bits in range(1, 5):
            short = H.Planes(planes.centre, bits, 3)
            ours, theirs = short.probed(vecs[i:i + 1], 2)[0], short.buckets(short.signatures(short.margins(vecs[10 + i:11 + i])))[0]
            hits = [b for b in range(3) if theirs[b] in ours]
            assert first[i, bits - 1] == (hits[0] if hits else 3)


def test_recall_of_fitted_planes_with_few_pairs(spark):
    rng = np.random.default_rng(2)
    every = clustered(rng, 4_060)
    pool, queries = frame(spark, range(4_000), every[60:]), frame(spark, range(60), every[:60], "qid")
    planes = H.Planes.fit(queries, pool, 10, group_cost=0)
    assert planes.bits >= 5
    folder = store(spark, f"{shared_folder(spark)}/lsh")
    index = H.lsh_index(pool, planes, folder)
    found = H.vector_topk_lsh(queries, index, 10)
    rows = found.collect()
    exact = vectors.vector_topk(queries, pool, 10)
    assert graph.recall(exact, found).first()["recall"] >= 0.9
    asked = queries.select("qid", F.explode(planes.asked("vec")).alias("cell"))
    compared = asked.join(index.buckets.select("cell", "pid"), "cell").select("qid", "pid").distinct().count()
    assert compared < 0.25 * 60 * 4_000
    assert all(abs(r["score"] - every[r["qid"]] @ every[60 + r["pid"]]) < 1e-5 for r in rows)
    assert len({(r["qid"], r["pid"]) for r in rows}) == len(rows) == 600
    assert sorted(H.vector_topk_lsh(queries, H.LshIndex.read(spark, folder.folder), 10).collect()) == sorted(rows)


def test_all_planes_on_one_side_are_the_exact_search(spark):
    """Every bucket asked: the rows of the exact search, ties and ranks included."""
    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(200, 4)), 1)
    pool, queries = frame(spark, range(200), vecs), frame(spark, range(9), vecs[:9], "qid")
    planes = H.Planes(vecs.mean(axis=0), 2, 3)
    got = H.vector_topk_lsh(queries, H.lsh_index(pool, planes), 15, probes=4).collect()
    assert sorted(got) == sorted(vectors.vector_topk(queries, pool, 15).collect())


def test_a_hot_bucket_is_many_tasks(spark, monkeypatch):
    """A vector that most rows have: its bucket is cut into blocks on both sides, and the smallest ids come first."""
    rng = np.random.default_rng(4)
    vecs = clustered(rng, 300)
    pool = frame(spark, range(900), np.concatenate([vecs, np.repeat(vecs[:1], 600, axis=0)]))
    queries = frame(spark, range(50), np.repeat(vecs[:1], 50, axis=0), "qid")
    index = H.lsh_index(pool, H.Planes(vecs.mean(axis=0), 5, 4))
    want = H.vector_topk_lsh(queries, index, 20).collect()
    monkeypatch.setattr(H, "POOL_BLOCK", 64)
    monkeypatch.setattr(H, "QUERY_BLOCK", 16)
    assert sorted(H.vector_topk_lsh(queries, index, 20).collect()) == sorted(want)
    assert {r["pid"] for r in want} == {0, *range(300, 319)}


def test_odd_rows(spark):
    """Null ids, null vectors and non-finite components take no part; an empty side gives no rows."""
    vecs = [[1.0, 0.0], [0.0, 1.0]]
    odd = [(None, [1.0, 1.0]), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])]
    pool = frame(spark, [1, 2], vecs).union(spark.createDataFrame(odd, "pid long, vec array<double>"))
    queries = pool.withColumnRenamed("pid", "qid")
    planes = H.Planes.fit(queries, pool, 5)
    got = {(r["qid"], r["pid"], r["rk"]) for r in H.vector_topk_lsh(queries, H.lsh_index(pool, planes), 5).collect()}
    assert got == {(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)}
    assert H.vector_topk_lsh(queries.limit(0), H.lsh_index(pool, planes), 5).count() == 0
    nothing = pool.limit(0)
    assert H.vector_topk_lsh(queries, H.lsh_index(nothing, H.Planes.fit(queries, nothing)), 5).count() == 0
    assert H.Planes.fit(queries.limit(0), pool).bits == 0
