"""Mixing: weights, limits, and which rows are dealt out."""

from collections import Counter, defaultdict

import pytest
from compare import oracle_rows, spark_rows, views
from pyspark.sql import functions as F

from prefixloom.llm import mixing as X

SCHEMA = "doc_id long, source string, text string, epoch string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for source, n in (("a", 900), ("b", 130), ("c", 40), (None, 25)):
        rows += [(len(rows) + i, source, "w " * (1 + i % 7), "old") for i in range(n)]
    rows += [(5000, "empty", None, None), (5001, "empty", " \n", None), (5002, "c", "", None), (None, "a", "x y", None), (3, "a", "w w", "old")]
    return spark.createDataFrame(rows, SCHEMA)


def spent(rows):
    tokens, copies = Counter(), Counter()
    for r in rows:
        tokens[r["source"]] += len((r["text"] or "").split())
        copies[r["doc_id"], r["source"], r["text"]] += 1
    return tokens, copies


def test_every_row_once_and_no_source_too_often(docs):
    base, _ = spent(docs.collect())
    out = X.mix(docs, repeats=2.0)
    assert out.columns == ["doc_id", "source", "text", "epoch", "block", "pace"]
    tokens, copies = spent(out.collect())
    once, rows = spent(docs.collect())[1], docs.count()
    assert set(copies) == set(once) and all(once[k] <= copies[k] <= 2 * once[k] for k in once) and out.count() > rows
    assert max(tokens[s] / base[s] for s in base if base[s]) == pytest.approx(2, rel=0.1)
    assert tokens["a"] == base["a"]


def test_entropy_target_and_budget(docs):
    import math

    base, _ = spent(docs.collect())
    out = X.mix(docs, entropy=0.9, budget=2000.0).collect()
    tokens, _ = spent(out)
    total = sum(tokens.values())
    h = -sum(t / total * math.log(t / total) for t in tokens.values() if t) / math.log(sum(t > 0 for t in base.values()))
    assert 1900 < total <= 2000 and h == pytest.approx(0.9, abs=0.02)


def test_blocks_stay_together_and_pace_orders(docs):
    out = X.mix(docs, repeats=2.0).collect()
    paces = defaultdict(set)
    for r in out:
        assert 0 <= r["pace"] <= 1
        paces[r["source"], r["epoch"], r["block"]].add(r["pace"])
    assert all(len(p) == 1 for p in paces.values())


def test_without_targets_and_empty(docs):
    same = X.mix(docs, budget=float(sum(len((r["text"] or "").split()) for r in docs.collect())))
    assert same.count() == docs.count()
    assert X.mix(docs.limit(0), repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        X.mix(docs, repeats=2.0, entropy=0.5).count()


def test_many_sources_by_plain_joins(docs, monkeypatch):
    want = sorted(map(tuple, X.mix(docs, repeats=2.0).collect()), key=str)
    monkeypatch.setattr(X, "FEW_SOURCES", 2)
    assert sorted(map(tuple, X.mix(docs, repeats=2.0).collect()), key=str) == want


def test_columns_of_any_name_stay(docs):
    odd = ["name", "_name", "_place", "_full", "_rest", "_block", "_turn", "n_tokens", "place"]
    wide = docs.select("*", *[F.lit(c).alias(c) for c in odd])
    got = X.mix(wide, repeats=2.0)
    assert got.columns == ["doc_id", "source", "text", *odd, "epoch", "block", "pace"]
    assert got.count() == X.mix(docs, repeats=2.0).count()
    assert [tuple(r) for r in got.select(*odd).distinct().collect()] == [tuple(odd)]


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(X.op7_mixing(spark, folder)) == oracle_rows(views(folder), X.SQL)


def test_words_are_counted_as_described(spark):
    rows = spark.createDataFrame([(" a\tb\u00a0c \x0bd",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(X.tokens(F.col("t"))).collect()] == [3, 0, 0]
