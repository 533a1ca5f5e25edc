"""Graph search: links, reach, recall, copies and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.operators import graph as G
from prefixloom.operators.vectors import vector_topk
from prefixloom.sources.tables import shared_folder, store


def unit(rng, n, d=16, centres=20):
    x = rng.normal(size=(centres, d))[rng.integers(centres, size=n)] + 0.5 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, ids, vecs, name="pid"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, vecs)], f"{name} long, vec array<float>")


@pytest.mark.parametrize("n", [1, 2, 5, 700])
def test_a_graph_reaches_every_node_within_its_limits(n):
    vecs = unit(np.random.default_rng(n), n)
    layers = G.graph_of(vecs)
    assert len(layers[0][0]) == n and all(set(b[0]) <= set(a[0]) for a, b in zip(layers, layers[1:]))
    for level, (at, links) in enumerate(layers):
        entry = layers[level + 1][0][0] if level + 1 < len(layers) else at[0]
        seen, todo, of = {entry}, [entry], dict(zip(at.tolist(), links))
        while todo:
            for x in of[todo.pop()].tolist():
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        assert seen == set(at.tolist())
        assert all(i not in x and len(set(x.tolist())) == len(x) for i, x in of.items())


def test_links_are_diverse():
    """The rule in plain loops: nearest first, unless nearer to a chosen one than to the node; then the nearest of the rest."""
    vecs = unit(np.random.default_rng(0), 60, 8, 4)
    sims = vecs @ vecs.T
    near = np.argsort(-np.where(np.eye(60, dtype=bool), -np.inf, sims), axis=1)[:, :40]
    got = G.diverse(vecs, near, np.take_along_axis(sims, near, axis=1), 12)
    for i in range(60):
        chosen = []
        for j in near[i].tolist():
            if len(chosen) < 12 and all(sims[j, c] < sims[i, j] for c in chosen):
                chosen.append(j)
        rest = [j for j in near[i].tolist() if j not in chosen]
        assert got[i].tolist() == (chosen + rest)[:12] and len(chosen) < 12
    # links run both ways unless a node has its fill
    links = G.linked(vecs, 16, width=40)
    assert all(i in links[j] or len(links[j]) == 16 for i in range(60) for j in links[i][:8])


def test_levels_fall_geometrically():
    top = G.levels(100_000)
    assert top.min() == 0 and abs((top >= 1).mean() - 1 / G.LINKS) < 0.003 and 2 <= top.max() <= 6


@pytest.mark.parametrize("shard_rows,beam", [(8_192, 64), (300, 64)])
def test_recall_over_shards(spark, shard_rows, beam):
    rng = np.random.default_rng(5)
    vecs, asked = unit(rng, 2_000), unit(rng, 50)
    pool, queries = frame(spark, range(2_000), vecs), frame(spark, range(50), asked, "qid")
    folder = store(spark, f"{shared_folder(spark)}/graph-{shard_rows}")
    found = G.vector_topk_graph(queries, G.graph_index(pool, shard_rows, keep=folder), 20, beam)
    exact = vector_topk(queries, pool, 20)
    assert G.recall(exact, found).first()["recall"] >= 0.95
    # what is found has its exact score, and an index read again answers alike
    pairs = {(r["qid"], r["pid"]): r["score"] for r in found.collect()}
    assert all(abs(s - float(asked[q].astype(float) @ vecs[p].astype(float))) < 1e-5 for (q, p), s in pairs.items())
    again = G.vector_topk_graph(queries, G.GraphIndex.read(spark, folder.folder), 20, beam)
    assert {(r["qid"], r["pid"]) for r in again.collect()} == set(pairs)


def test_the_stored_graph_is_read_without_a_shuffle(spark):
    rng = np.random.default_rng(6)
    folder = store(spark, f"{shared_folder(spark)}/graph-plan")
    index = G.graph_index(frame(spark, range(300), unit(rng, 300)), keep=folder)
    plan = G.vector_topk_graph(frame(spark, range(5), unit(rng, 5), "qid"), index)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas"):plan.index("nsw_graph")]
    assert "Exchange" not in below


def test_many_queries_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    index = G.graph_index(frame(spark, range(400), unit(rng, 400)), shard_rows=150)
    queries = frame(spark, range(40), unit(rng, 40), "qid")
    want = sorted(map(tuple, G.vector_topk_graph(queries, index, 7).collect()))
    monkeypatch.setattr(G, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(G, "QUERY_BLOCK", 16)
    assert sorted(map(tuple, G.vector_topk_graph(queries, index, 7).collect())) == want


def test_copies_and_odd_rows(spark):
    """A vector that most rows have gives its smallest ids; null rows take no part."""
    rng = np.random.default_rng(8)
    vecs = unit(rng, 50)
    rows = [(i, vecs[0]) for i in range(500, 800)] + [(i, vecs[i]) for i in range(50)]
    pool = frame(spark, *zip(*rows)).union(spark.createDataFrame([(None, [1.0] * 16), (900, None)], "pid long, vec array<float>"))
    index = G.graph_index(pool)
    queries = frame(spark, [1], [vecs[0]], "qid").union(spark.createDataFrame([(2, None)], "qid long, vec array<float>"))
    got = [(r["qid"], r["pid"], r["rk"]) for r in G.vector_topk_graph(queries, index, 20).orderBy("rk").collect()]
    assert got == [(1, p, i + 1) for i, p in enumerate([0, *range(500, 519)])]
    assert G.vector_topk_graph(queries.limit(0), index).count() == 0
    assert G.vector_topk_graph(queries, G.graph_index(pool.limit(0))).count() == 0
    few = G.vector_topk_graph(queries, G.graph_index(pool.filter(F.col("pid") < 3)), 20)
    assert few.count() == 3
    with pytest.raises(ValueError):
        G.vector_topk_graph(queries, index, G.COPIES + 1)
