"""The paths for hot groups and large sides give the same rows as the plain ones."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefixloom.operators import dictionary, history, learn, lexical, ranking, vectors
from prefixloom.operators.candidates import with_engagement
from prefixloom.plans.complete import Engine
from prefixloom.sources.fixtures import Tables
from prefixloom.sources.tables import shared_folder, store


def rows(df, *cols):
    return sorted(map(tuple, df.select(*(cols or df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """A pool in which one token and its grams are in every query, and prefixes that use it."""
    pool = spark.range(400).select(
        F.concat(F.lit("brand x"), F.col("id") % 7, F.when(F.col("id") % 3 == 0, " red").otherwise(" blue brand "), F.col("id")).alias("query")
    )
    prefixes = spark.createDataFrame([("bra",), ("brand",), ("brand red",), ("x3 blue",), ("",), ("zzz",)], "prefix string")
    return prefixes, pool


def plain_trigrams(prefixes, pool, k):
    def grams(t):
        t = t.replace(" ", "")
        return {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}

    out = []
    queries = [r.query for r in pool.collect()]
    for (p,) in prefixes.collect():
        scored = []
        for q in queries:
            a, b = grams(p), grams(q)
            if a & b:
                scored.append((-float(f"{len(a & b) / len(a | b):.6f}"), q))
        out += [(p, q, -s, i + 1) for i, (s, q) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell_rows", [1_000_000, 5])
def test_trigrams_on_a_hot_gram(hot, monkeypatch, cell_rows):
    monkeypatch.setattr(lexical, "CELL_ROWS", cell_rows)
    prefixes, pool = hot
    got = rows(lexical.trigram_topk(prefixes, lexical.trigram_index(pool), 10), "prefix", "query", "score", "rk")
    want = plain_trigrams(prefixes, pool, 10)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_bm25_on_a_hot_token(hot, monkeypatch):
    prefixes, pool = hot
    plain = lexical.bm25_topk(prefixes, lexical.bm25_index(pool, head_rows=1000), 20)
    monkeypatch.setattr(lexical, "CELL_ROWS", 5)
    split = lexical.bm25_topk(prefixes, lexical.bm25_index(pool, head_rows=3), 20)
    assert rows(plain) == rows(split)


def test_same_rows_under_any_partitioning(hot):
    prefixes, pool = hot
    index = lexical.trigram_index(pool)
    other = lexical.trigram_index(pool.repartition(7))
    assert rows(lexical.trigram_topk(prefixes, index)) == rows(lexical.trigram_topk(prefixes.repartition(5), other))


def test_vector_blocks_equal_broadcast(spark, tables, monkeypatch):
    q, p = tables.query_vectors(), tables.pool_vectors()
    whole = rows(vectors.vector_topk(q, p, 7))
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "POOL_BLOCK", 50)
    assert rows(vectors.vector_topk(q, p, 7)) == whole


def plain_topk(queries, pool, k):
    """(qid, pid, score) in plain loops, from lists of (id, vector)."""
    out = []
    for qid, q in queries:
        scored = sorted((-round(float(np.dot(q, v)), 6), pid) for pid, v in pool)
        out += [(qid, pid, -s + 0.0) for s, pid in scored[:k]]
    return out


@pytest.mark.parametrize("copies", [1, 40])
@pytest.mark.parametrize("k", [1, 5, 30])
def test_score_block_as_by_plain_loops(k, copies):
    rng = np.random.default_rng(k)
    pool = [(int(i), v) for i, v in enumerate(np.repeat(rng.normal(size=(1_200 // copies, 8)), copies, axis=0))]
    pool += [(2_000 + i, np.eye(8)[0] * (0.5 + i * 1e-7)) for i in range(40)]  # equal once rounded
    queries = [(i, v) for i, v in enumerate(rng.normal(size=(30, 8)))] + [(90, np.eye(8)[0]), (91, np.zeros(8))]
    frames = [pd.DataFrame({name: [i for i, _ in rows], "vec": [v for _, v in rows]}) for name, rows in (("qid", queries), ("pid", pool[::-1]))]
    got = vectors.score_block(*frames, k)
    assert [(q, p, round(s, 6)) for q, p, s in got.itertuples(index=False)] == plain_topk(queries, pool, k)


def test_score_block_holds_one_tile():
    """The products of a step are held once, not once per step of the rounding and the ranking."""
    rng = np.random.default_rng(0)
    queries = pd.DataFrame({"qid": range(1_000), "vec": list(rng.normal(size=(1_000, 16)))})
    pool = pd.DataFrame({"pid": range(10_000), "vec": list(rng.normal(size=(10_000, 16)))})
    tracemalloc.start()
    vectors.score_block(queries, pool, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * vectors.TILE_VALUES


def test_running_best_holds_few_rows(monkeypatch):
    """Many queries times k: rows are handed on in pieces, and nothing of the k best is lost."""
    monkeypatch.setattr(vectors, "HELD", 400)
    rng = np.random.default_rng(1)
    pool = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (600, 4)).astype(float))]
    queries = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (90, 4)).astype(float))]
    frames = [pd.DataFrame({name: [i for i, _ in some], "vec": [v for _, v in some]})
              for name, some in [("qid", queries)] + [("pid", pool[i:i + 50]) for i in range(0, 600, 50)] + [("pid", [])]]
    handed = list(vectors._running_best(frames[0], iter(frames[1:]), 10))
    assert max(map(len, handed)) <= 800
    got = vectors._trim(pd.concat(handed), 10)
    assert list(got.itertuples(index=False, name=None)) == plain_topk(queries, pool, 10)


def test_large_cells_get_larger_query_blocks(spark, monkeypatch):
    """A pool row is copied once per query block."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    every = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7)).alias("vec"))
    found = vectors.block_topk(every.select(F.col("id").alias("qid"), "vec", F.lit(0).alias("cell")),
                               every.select(F.col("id").alias("pid"), "vec", F.lit(0).alias("cell")), 3)
    listed = [(r["id"], np.array(r["vec"])) for r in every.collect()]
    assert rows(found, "qid", "pid") == sorted(((q, p) for q, p, _ in plain_topk(listed, listed, 3)), key=repr)
    counts = spark.createDataFrame([(0,), (10,), (33,), (300,), (4_000,)], "n long").select(vectors._query_blocks(F.col("n"), 3)).collect()
    assert [r[0] for r in counts] == [0, 5, 16, 19, 250]
    assert spark.range(1).select(vectors._query_blocks(F.lit(4_000), 50_000)).first()[0] == 2_000  # as many results as before


def test_cell_probing_recall(tables):
    q, p = tables.query_vectors(), tables.pool_vectors()
    exact = {r[:2] for r in rows(vectors.vector_topk(q, p, 10), "qid", "pid")}
    cells = vectors.Cells.fit(p, 8)
    some = {r[:2] for r in rows(vectors.vector_topk_cells(q, p, 10, nprobe=4, cells=cells), "qid", "pid")}
    every = {r[:2] for r in rows(vectors.vector_topk_cells(q, p, 10, nprobe=8, cells=cells), "qid", "pid")}
    assert every == exact
    assert len(some & exact) / len(exact) >= 0.5


def test_kth_smallest_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SORT_ROWS", 50)
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("v"), (F.col("id") % 3).alias("few"))
    for k in (0, 1, 12_345, 59_999):
        assert ranking.kth_smallest(df, "v", lambda n, k=k: k) == (k, 60_000)
    assert ranking.kth_smallest(df, "few", lambda n: n // 2) == (1, 60_000)
    assert ranking.kth_smallest(df, "v", lambda n: n)[0] is None


@pytest.mark.parametrize("sort_rows", [2_000_000, 40])
def test_ranked_values_bracket(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(ranking, "SORT_ROWS", sort_rows)
    df = spark.range(50_000).select(
        (F.col("id") * 7919 % 50_000).cast("double").alias("a"),
        F.when(F.col("id") % 100 < 98, 0.0).otherwise(F.col("id").cast("double")).alias("b"),
    )
    pdf = df.toPandas()
    got = ranking.ranked_values(df, ["a", "b"], [0.25, 0.99])
    for c in ("a", "b"):
        assert np.allclose(got[c], pdf[c].quantile([0.25, 0.99]).tolist())


def test_large_limits_equal_small_ones(spark, monkeypatch):
    df = spark.range(5_000).select(F.concat(F.lit("q"), "id").alias("query"), (F.col("id") % 50).alias("popularity"))
    small = rows(ranking.sample_rows(df, 700, ["query"]))
    top = df.orderBy(F.desc("popularity")).limit(720).agg(F.sum("popularity")).first()[0]
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 10)
    assert rows(ranking.sample_rows(df, 700, ["query"])) == small
    large = ranking.popular(df, "popularity", 720)
    assert large.count() == 720 and large.agg(F.sum("popularity")).first()[0] == top


def test_prefix_lists_in_pages(spark):
    log = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 10)).alias("prefix"),
        F.concat(F.lit("q"), F.col("id") % 500).alias("query"),
    )
    lists = history.prefix_queries(log, 100).collect()
    assert len({r.page for r in lists if r.prefix == "hot"}) > 1
    assert max(len(r.queries) for r in lists) < 250
    assert sum(sum(r.freqs) for r in lists) == 3_000


def test_engine_from_files(spark, tables):
    folder = f"{shared_folder(spark)}/engine"
    built = Engine.build(tables.pool(), tables.features(), keep=store(spark, folder))
    again = Engine.read(spark, folder)
    assert rows(built.complete(tables.prefixes())) == rows(again.complete(tables.prefixes()))


def test_engine_with_cells(tables):
    e = Engine.build(tables.pool(), tables.features())
    exact = rows(e.semantic(tables.prefixes()))
    e.cells = vectors.Cells.fit(e.vectors, 4)
    assert rows(e.semantic(tables.prefixes())) == exact  # all four cells are probed


def test_ranks_are_dense(tables):
    e = Engine.build(tables.pool(), tables.features())
    for prefix, rks in (
        e.complete(tables.prefixes()).groupBy("prefix").agg(F.sort_array(F.collect_list("rk")).alias("r")).collect()
    ):
        assert rks == list(range(1, len(rks) + 1)) and len(rks) <= 10


def test_ranker_learns(spark, tables):
    cands = dictionary.prefix_match(tables.train(), tables.pool(), 20)
    drawn = learn.groups(tables.train().limit(300), cands)
    labelled = with_engagement(drawn, tables.features())
    zeros = {s: F.lit(0.0) for s in ("sem", "bm25", "ngram", "fuzzy")}
    from prefixloom.functions.scores import pair_features

    data = pair_features(
        labelled.withColumns(zeros).withColumn("label", F.when(F.col("is_truth"), learn.graded_label()).otherwise(0)),
        ["group_id", "prefix", "query", "label"],
    )
    model = learn.Ranker.fit(data, trees=3, depth=3)
    assert model.importances(5).count() == 5
    assert "prediction" in model.score(data, own_stats=True).columns


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_fitted_cells(spark, folder):
    t = Tables(spark, folder)
    q, p = t.query_vectors(), t.pool_vectors()
    exact = {r[:2] for r in rows(vectors.vector_topk(q, p, 10), "qid", "pid")}
    some = {r[:2] for r in rows(vectors.vector_topk_cells(q, p, 10), "qid", "pid")}
    recall = len(exact & some) / len(exact)
    print(folder, p.count(), "rows, recall", recall)
    assert recall >= 0.9
