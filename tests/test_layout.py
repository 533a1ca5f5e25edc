"""Index tables in buckets: batches join postings without shuffling them."""

import pytest

from prefixloom.operators import lexical
from prefixloom.plans.complete import Engine
from prefixloom.sources.tables import kept, shared_folder, store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tables):
    path = f"{shared_folder(spark)}/layout"
    Engine.build(tables.pool(), tables.features(), keep=store(spark, path))
    return path


def above(df, table):
    """The operators between a table's scan and the first join over it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth = line.index("FileScan")
            for one in reversed(lines[:i]):
                at = next((k for k, c in enumerate(one) if c.isalpha()), depth)
                if at < depth:
                    depth = at
                    out.append(one[at:])
                    if "Join" in one:
                        return out
    return out


@pytest.mark.parametrize("name", ["trigram", "bm25"])
def test_no_exchange_above_the_postings(spark, tables, folder, name):
    engine = Engine.read(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        found = lexical.trigram_topk(tables.prefixes(), engine.trigrams) if name == "trigram" else lexical.bm25_topk(tables.prefixes(), engine.bm25)
        path = above(found, f"{name}_postings")
        assert "SortMergeJoin" in path[-1] and not any("Exchange" in p for p in path), path
        got = rows(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = lexical.trigram_index(tables.pool()) if name == "trigram" else lexical.bm25_index(tables.pool())
    assert got == rows(lexical.trigram_topk(tables.prefixes(), plain) if name == "trigram" else lexical.bm25_topk(tables.prefixes(), plain))


def test_a_later_session_names_the_table_again(spark, folder):
    """The layout is beside the files, so the catalog may forget the table."""
    path = f"{folder}/trigram_postings"
    want = rows(kept(spark, path))
    from prefixloom.sources.tables import table_name

    spark.sql(f"DROP TABLE {table_name(path)}")
    again = kept(spark, path)
    assert rows(again) == want and again.columns == ["gram", "n_grams", "query", "grams", "salt"]
    detail = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table_name(path)}").collect()}
    assert "gram" in detail["Bucket Columns"] and int(detail["Num Buckets"]) >= 4


def test_buckets_follow_the_rows_and_force_renews(spark, tmp_path, monkeypatch):
    from prefixloom.sources import tables as S

    monkeypatch.setattr(S, "BUCKET_ROWS", 10)
    df = spark.range(100).selectExpr("id % 7 AS k", "id AS v")
    one = store(spark, str(tmp_path))(df, "t", by=["k"])
    assert rows(one) == rows(df) and one.rdd.getNumPartitions() <= 10
    assert rows(store(spark, str(tmp_path))(df.limit(3), "t", by=["k"])) == rows(df)  # it is there
    assert store(spark, str(tmp_path), force=True)(df.limit(3), "t", by=["k"]).count() == 3
