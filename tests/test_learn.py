"""Training rows: the same by plain Python, and plans that do not grow beyond their input."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from prefixloom.functions.digests import md5_many
from prefixloom.operators import learn


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_md5_as_by_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé|1") for _ in range(n)) for n in [0, 1, 54, 55, 56, 57, 63, 64, 65, 119, 120, 128, 300] * 20]
    for some in (pa.array(texts), pa.array(texts)[7:], pa.array([], pa.string()), pa.array([""])):
        want = [hashlib.md5(t.encode()).digest() for t in some.to_pylist()]
        assert (md5_many(some) == np.array(want, "S16")).all() and len(md5_many(some)) == len(some)


def test_drawn_negatives_as_by_plain_python(spark):
    lists = {"a": [f"a{i}" for i in range(25)], "b": ["b", "é" * 80], "": ["", "x"]}
    cands = spark.createDataFrame([(p, q) for p, qs in lists.items() for q in [*qs, None]], "prefix string, query string")
    logged = [(1, "a", "a3"), (1, "a", "a3"), (None, "a", "zz"), (-7, "b", "b"), (8, "none", "q"), (9, "", "x"), (10, None, "q"), (11, "a", None)]
    train = spark.createDataFrame(logged, "row_id long, prefix string, query string")
    want = []
    for row, prefix, query in logged:
        others = [q for q in lists.get(prefix, []) if query is not None and q != query]
        head = "42" if row is None else f"42|{row}"
        drawn = sorted(others, key=lambda q: hashlib.md5(f"{head}|{q}".encode()).hexdigest())[:10]
        want += [(row, prefix, query, True), *[(row, prefix, q, False) for q in drawn]]
    drawn = learn.groups(train, cands)
    assert sorted(map(tuple, drawn.collect()), key=repr) == sorted(want, key=repr)
    # no function runs per element of an array, and the logged rows are not shuffled
    assert "lambda" not in plan(drawn) and "Aggregate" not in plan(drawn)


def test_negatives_carry_columns_and_stay_with_their_group(spark):
    cands = spark.createDataFrame([("a", f"a{i}", 0, i) for i in range(25)] + [("b", None, 0, 1)], "prefix string, query string, label int, pop long")
    logged = [(1, "a", "a3", 3, 7), (1, "a", "a3", 3, 7), (2, "b", "b", 1, 8), (None, "a", "zz", 2, 9), (3, None, "q", 1, 1)]
    train = spark.createDataFrame(logged, "row_id long, prefix string, query string, label int, pop long")
    got = learn.groups(train, cands, carried=["label", "pop"], dealt=True)
    plain_rows = learn.groups(train.drop("label", "pop"), cands).collect()
    assert sorted(map(tuple, got.drop("label", "pop").collect()), key=repr) == sorted(map(tuple, plain_rows), key=repr)
    own = {(r[0], r[1], r[2]): r[3:] for r in logged}
    for r in got.collect():
        assert (r["label"], r["pop"]) == (own[r["group_id"], r["prefix"], r["query"]] if r["is_truth"] else (0, int(r["query"][1:])))


def test_gradients_shuffle_logged_rows_only(spark):
    """One shuffle, before the rows become many; the groups' rows lie where it put them."""
    from prefixloom.plans.registered import REGISTRY

    steps = REGISTRY["lambda_gradients"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange hashpartitioning") == 1
    assert steps.index("Generate explode") < steps.index("Exchange hashpartitioning")  # printed from the last step to the first


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    import glob
    import os

    from pyspark.sql import functions as F

    from prefixloom.sources.tables import materialise

    def files():
        return set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))

    folder = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = files()
    df = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    materialise(spark, str(tmp_path / "t"), lambda: df.repartition(5, "n"))
    for _ in range(50):  # removed behind the scenes
        if not files() - before:
            break
        import time

        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_ranker_reads_every_group(spark):
    """More groups than a sample of 50,000: what is fitted is the fit of all rows, however they are counted."""
    from pyspark.sql import functions as F

    from prefixloom.functions.scores import FEATURES

    n = 60_000
    once = spark.range(n).select(F.col("id").alias("group_id"), (F.col("id") % 4).cast("int").alias("label"), *[
        ((F.col("id") * (2 * i + 7)) % (i + 3)).cast("double").alias(c) for i, c in enumerate(FEATURES)])
    model = learn.Ranker.fit(once, trees=1, depth=1)
    for i, c in enumerate(FEATURES[:5]):
        values = (np.arange(n) * (2 * i + 7)) % (i + 3)
        assert np.isclose(model.scaler.stats[c][1], values.mean(), rtol=1e-12)
    assert model.model.getMaxBins() ** 2 >= n


def test_counted_rows_fit_as_rows_do(spark):
    from pyspark.sql import functions as F

    from prefixloom.functions.scores import FEATURES

    rows = spark.range(900).select(
        (F.col("id") % 30).alias("kind"), (1 + F.col("id") % 30 % 4 * (F.col("id") % 30 % 3)).cast("int").alias("label"),
        *[((F.col("id") % 30 * (i + 1)) % 11 / 4).alias(c) for i, c in enumerate(FEATURES)])
    uneven = rows.unionByName(rows.filter("kind < 7"))
    counted = uneven.groupBy(uneven.columns).agg(F.count("*").alias("n"))
    a, b = learn.Ranker.fit(uneven, trees=3, depth=3), learn.Ranker.fit(counted, trees=3, depth=3, weight="n")
    for c in FEATURES:
        assert np.allclose(a.scaler.stats[c], b.scaler.stats[c], rtol=1e-12)
    got = [[r["prediction"] for r in m.score(counted).orderBy("kind").collect()] for m in (a, b)]
    assert np.allclose(*got, rtol=1e-9)


def test_all_groups_of_a_part_are_counted(spark, tables):
    from pyspark.sql import functions as F

    from prefixloom.plans import registered as R

    rows = R._split(tables)
    counted = rows.counted("train").agg(F.sum("n"), F.sum(F.when(F.col("is_truth"), F.col("n")))).first()
    whole = rows.rows("train", 10**9).agg(F.count("*"), F.count_if("is_truth")).first()
    assert tuple(counted) == tuple(whole) and whole[1] == rows._of("train").count()
