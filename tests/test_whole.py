"""Nothing is capped, dropped or answered from other rows."""

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import similarity
from prefixloom.operators import cascade, dictionary, learn, lexical, ranking, vectors
from prefixloom.plans.complete import Engine
from prefixloom.sources.tables import shared_folder, store


def rows(df, *cols):
    return sorted(map(tuple, df.select(*(cols or df.columns)).collect()), key=repr)


def test_ties_by_text_for_any_n(spark, monkeypatch):
    texts = [f"{'long leading text ' * (i % 3)}{i * 7919 % 1000:04d}é{'x' * (i % 5)}" for i in range(1000)]
    df = spark.createDataFrame([(t, 1 + i % 2) for i, t in enumerate(texts)], "query string, popularity int")
    for n in (3, 40, 490, 730, 1000, 2000):
        want = rows(df.orderBy(F.desc("popularity"), "query").limit(n))
        with monkeypatch.context() as m:
            m.setattr(ranking, "SMALL_LIMIT", 5)
            assert rows(ranking.popular(df, "popularity", n)) == want
    with monkeypatch.context() as m:
        m.setattr(ranking, "SMALL_LIMIT", 2)
        same = spark.createDataFrame([("same", 1)] * 20, "query string, popularity int")
        assert ranking.popular(same, "popularity", 7).count() == 7


def test_begins_with_prefixes_of_any_length(spark):
    pool = spark.createDataFrame([(f"samsung galaxy s{i} phone with a long name", i) for i in range(30)] + [("sam", 1)], "query string, popularity int")
    asked = ["sam", "samsung galaxy ", "samsung galaxy s", "samsung galaxy s2", "samsung galaxy s29 phone with a long name", "samsung x", ""]
    got = dictionary.edge_match(spark.createDataFrame([(p,) for p in asked], "prefix string"), pool)
    want = [(p, q) for p in asked if p for (q, _) in map(tuple, pool.collect()) if q.startswith(p)]
    assert rows(got, "prefix", "query") == sorted(want, key=repr)


def test_fuzzy_search_over_all_blocks_and_long_texts(spark, monkeypatch):
    pool = spark.createDataFrame([(f"red shoe {i}",) for i in range(300)] + [("x" * 5000 + "blue hat",), (None,)], "query string")
    asked = spark.createDataFrame([("red sho 299",), ("blue hat",), ("a prefix of well over twenty characters",)], "prefix string")
    whole = rows(cascade.fuzzy_partial_topk(asked, pool, limit=7))
    monkeypatch.setattr(cascade, "FUZZY_BLOCK", 13)
    assert rows(cascade.fuzzy_partial_topk(asked, pool, limit=7)) == whole
    assert any(r[1].endswith("blue hat") for r in whole) and sum(r[0] == "red sho 299" for r in whole) == 7


def test_unclean_inputs(spark):
    pool = spark.createDataFrame([("red shoe 1",), ("red shoe 1",), ("red shoe 2",), (None,), ("blue hat",)], "query string")
    features = spark.createDataFrame(
        [("red shoe 1", 5, 1, 1, 1), ("red shoe 1", None, 2, None, 1), ("blue hat", 1, 1, 1, 1)],
        "query string, orders long, volume long, catalog_clicks long, catalog_views long")
    done = Engine.build(pool, features).complete(spark.createDataFrame([("red sho",), ("r",)], "prefix string"))
    got = rows(done, "prefix", "query")
    assert len(got) == len(set(got)) and {q for p, q in got if p == "r"} == {"red shoe 1", "red shoe 2"}


def test_last_features_count(spark, tables):
    rows_ = spark.createDataFrame([("a", 9, 9, 9, 9, 1), ("a", 1, 1, 1, 1, 2)], "query string, orders long, volume long, catalog_clicks long, catalog_views long, day int")
    e = Engine.build(spark.createDataFrame([("a",)], "query string"), rows_, order="day")
    assert e.features.select("orders").first()[0] == 1


def test_stale_index_is_refused(spark, tables):
    folder = f"{shared_folder(spark)}/guarded"
    some = tables.pool().limit(20)
    Engine.build(some, tables.features(), keep=store(spark, folder))
    Engine.build(some, tables.features(), keep=store(spark, folder))
    with pytest.raises(ValueError, match="another pool"):
        Engine.build(tables.pool(), tables.features(), keep=store(spark, folder))
    renewed = Engine.build(tables.pool(), tables.features(), keep=store(spark, folder, force=True))
    assert renewed.pool.count() == tables.pool().count()


def test_metric_with_cells(spark, tables):
    p = tables.pool_vectors().select(F.col("pid").cast("string").alias("query"), "vec")
    q = tables.query_vectors().select(F.col("qid").cast("string").alias("prefix"), "vec")
    cells = vectors.Cells.fit(p.select(F.col("query").alias("pid"), "vec"), 4)
    assert rows(vectors.semantic_topk(q, p, 5, "l2_raw", cells)) == rows(vectors.semantic_topk(q, p, 5, "l2_raw"))


def test_names_in_sql(spark):
    similarity.register(spark)
    r = spark.sql("SELECT token_sort_ratio('b a', 'a  b') AS t, ratio('ab', 'ab') AS r, normalize_strict('  Brand#7, RED ') AS s, normalize_loose(' A\t b') AS l, normalize_loose(NULL) AS n").first()
    assert tuple(r) == (1.0, 1.0, "brand 7 red", "a b", "")


def test_ranker_from_files(spark, tables):
    from prefixloom.functions.scores import pair_features
    from prefixloom.operators.candidates import with_engagement

    drawn = learn.groups(tables.train().limit(60), dictionary.prefix_match(tables.train(), tables.pool(), 20))
    zeros = {s: F.lit(0.0) for s in ("sem", "bm25", "ngram", "fuzzy")}
    data = pair_features(
        with_engagement(drawn, tables.features()).withColumns(zeros).withColumn("label", F.col("is_truth").cast("int")),
        ["group_id", "prefix", "query", "label"])
    model = learn.Ranker.fit(data, trees=2, depth=2, most_groups=40)
    folder = f"{shared_folder(spark)}/ranker"
    model.write(folder)
    again = learn.Ranker.read(folder)
    assert rows(again.score(data), "group_id", "query", "prediction") == rows(model.score(data), "group_id", "query", "prediction")
