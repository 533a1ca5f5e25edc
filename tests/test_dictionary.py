"""The sorted dictionary against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from prefixloom.functions.text import normalize_strict
from prefixloom.operators import dictionary as D
from prefixloom.sources.tables import shared_folder, store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["red", "Red", "shoe", "shoes", "sh", "blue!", "hat", "é", "中文", "\U0001f600", "a", "aa"]
    found = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(400)}
    return sorted(found)


@pytest.fixture(scope="module")
def asked(texts):
    heads = {t[:n] for t in texts[::7] for n in (0, 1, 2, 5, 9, 40)}
    return sorted(heads | {"zzz", "red shoe", "\U0010ffff", "aa ", texts[0], texts[-1], texts[3] + "x"})


@pytest.fixture(params=["one part", "many parts", "written", "dealt", "dealt often"])
def way(request, monkeypatch):
    if request.param != "one part":
        monkeypatch.setattr(D, "PART_ROWS", 40)
    if request.param.startswith("dealt"):
        monkeypatch.setattr(D, "BROADCAST_PREFIXES", 3)
    if request.param == "dealt often":
        monkeypatch.setattr(D, "ASKED_ROWS", 2)
        monkeypatch.setattr(D, "EMIT_ROWS", 7)
    return request.param


def built(spark, pool, text, way, name):
    return D.Dictionary.build(pool, text, store(spark, f"{shared_folder(spark)}/dict-{name}")) if way == "written" else D.Dictionary.build(pool, text)


def test_all_rows_that_begin_with_a_prefix(spark, texts, asked, way):
    pool = spark.createDataFrame([(t, len(t)) for t in texts] + [(None, 1)], "query string, popularity int")
    held = built(spark, pool, "query", way, "all")
    if way != "one part":
        assert held.bounds.count() >= 5 and held.rows.groupBy("part").count().agg(F.max("count")).first()[0] < 150
    prefixes = spark.createDataFrame([(p, i) for i, p in enumerate(asked)] + [(None, 0), (asked[1], 99)], "prefix string, n int")
    got = D.edge_match(prefixes, held)
    want = [(p, n, t, len(t)) for p, n in [*((p, i) for i, p in enumerate(asked)), (asked[1], 99)] if p for t in texts if t.startswith(p)]
    assert got.columns == ["prefix", "n", "query", "popularity"] and rows(got) == sorted(want, key=repr)


def test_first_rows_by_query(spark, texts, asked, way):
    def plain(t):
        import re

        return re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")

    pool = spark.createDataFrame([(t,) for t in texts], "query string")
    held = built(spark, pool, normalize_strict("query"), way, "first")
    got = D.prefix_match(spark.createDataFrame([(p,) for p in asked], "prefix string"), held, 4)
    want = [(p, q, i + 1) for p in asked for i, q in enumerate(sorted(t for t in texts if plain(t).startswith(plain(p)))[:4])]
    assert rows(got) == sorted(want, key=repr)


def test_equal_texts_are_cut_between_parts(spark, monkeypatch):
    """One text that most rows have is no part of its own size: the boundaries are of text and query."""
    monkeypatch.setattr(D, "PART_ROWS", 50)
    pool = spark.createDataFrame([(f"q{i:04d}", "same" if i % 3 else f"other {i}") for i in range(600)], "query string, form string")
    held = D.Dictionary.build(pool, "form")
    assert held.rows.groupBy("part").count().agg(F.max("count")).first()[0] < 200
    got = held.begins(spark.createDataFrame([("same",), ("other 5",)], "prefix string"))
    assert got.filter("prefix = 'same'").count() == 400 and got.filter("prefix = 'other 5'").count() == sum(str(i).startswith("5") for i in range(0, 600, 3))


def test_only_the_parts_that_are_met_are_read(spark, texts, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 40)
    held = built(spark, spark.createDataFrame([(t,) for t in texts], "query string"), "query", "written", "met")
    plan = held.begins(spark.createDataFrame([("blue! red",)], "prefix string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "part" in plan.split("PushedFilters")[1]


def test_empty_tables(spark):
    pool = spark.createDataFrame([], "query string")
    held = D.Dictionary.build(pool)
    prefixes = spark.createDataFrame([("a",)], "prefix string")
    assert D.edge_match(prefixes, held).count() == 0 and D.prefix_match(prefixes, held).count() == 0
    some = D.Dictionary.build(spark.createDataFrame([("ab",)], "query string"))
    assert D.edge_match(prefixes.limit(0), some).count() == 0 and D.prefix_match(prefixes, some).count() == 1
