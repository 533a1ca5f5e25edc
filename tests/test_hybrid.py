"""Sparse weights and projected vectors of the hybrid index."""

import pytest
from pyspark.sql import functions as F

from prefixloom.operators import hybrid
from prefixloom.operators.vectors import CentredPca, embed
from prefixloom.sources.tables import shared_folder, store


def test_small_weights_are_left_out(tables):
    pool = tables.pool()
    every = {(r["query"], r["term"]): r["weight"] for r in hybrid.hashed_bm25(pool).collect()}
    least = sorted(every.values())[len(every) // 2] + 1e-5
    some = {(r["query"], r["term"]): r["weight"] for r in hybrid.hashed_bm25(pool, least_weight=least).collect()}
    assert some == {key: w for key, w in every.items() if w >= least} and 0 < len(some) < len(every)
    kept = hybrid.sparse_pool(pool, least_weight=least)
    assert kept.count() == pool.count() and kept.filter("term_weight > 0").select(F.min("term_weight")).first()[0] >= least


@pytest.mark.parametrize("dim", [8, 64])
def test_a_projected_index_answers_alike_after_reading(spark, tables, dim):
    pool, prefixes = tables.pool(), tables.prefixes()
    vecs, prefix_vecs = embed(pool, "query"), embed(prefixes, "prefix")
    pca = CentredPca.fit(vecs, dim)
    folder = f"{shared_folder(spark)}/projected-{dim}"
    index = hybrid.HybridIndex(pool, tables.features(), vecs, keep=store(spark, folder), hashed=hybrid.feature_hash, pca=pca)
    assert index.vecs.filter(F.size("vec") != dim).count() == 0
    pca.write(f"{folder}/pca")
    again = hybrid.HybridIndex.read(folder, pool, vecs, hashed=hybrid.feature_hash, pca=CentredPca.read(f"{folder}/pca"))
    rows = [sorted(hybrid.hybrid_full(prefixes, prefix_vecs, i, 10).collect()) for i in (index, again)]
    assert rows[0] == rows[1] and rows[0]
    assert hybrid.hybrid_blocked(prefixes, prefix_vecs, again, 10).count() > 0


def test_terms_are_made_once_per_distinct_text(spark):
    pool = spark.range(1_000).select(F.concat(F.lit("red shoe "), F.col("id") % 3).alias("query")).distinct()
    rows = hybrid.hashed_bm25(pool, hashed=hybrid.feature_hash, least_weight=hybrid.LEAST_WEIGHT)
    # with the DISTINCT in the plan, the filter on weights ran below it
    assert "Aggregate [query" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 9
