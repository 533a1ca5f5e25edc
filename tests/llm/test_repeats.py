"""Exact substring dedup against a plain version."""

import hashlib
import random
from collections import Counter

import pytest
from compare import oracle_rows, spark_rows, views

from prefixloom.llm import repeats as X


def plain(texts):
    n = X.LENGTH
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if count[r[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (60, 100, 130, 250, 400)]
    exact = "".join(rng.choice("xyz") for _ in range(400))
    out = [None, "", "short", passages[3], passages[3], passages[3] + " end", "a" * 1500, "b" * 400, "b" * 401, "ab" * 700, exact, "q" + exact,
           exact[:399], prose(5) + exact + prose(5), passages[4], passages[4][1:], passages[4][:-1], prose(3000)]
    for _ in range(40):  # passages between other text, some with an edit
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p)) for _ in range(2))
            p = rng.choice([p, p[a:b], p[:a] + "!" + p[a:], p[:a] + p[b:]])
            parts += [prose(rng.randrange(60)), p]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_by_a_plain_version(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_spans string").repartition(5)
    out = X.without_repeats(docs, kept="kept")
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(plain(rows)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (i, rows[i] and rows[i][:60])
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == want[3]


@pytest.mark.parametrize("size", [399, 400, 401])
def test_planted_passages_at_the_limit(spark, size):
    """A passage of 399 bytes in two documents stays, of 400 and 401 it goes from both, also within one document."""
    rng = random.Random(size)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = prose(size), prose(size)
    rows = [prose(300) + "<" + one + ">" + prose(200), prose(90) + "[" + one + "]" + prose(700), prose(50) + "(" + two + ")" + prose(600) + "{" + two + "}", prose(2_000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in X.without_repeats(docs).collect()}
    assert got == dict(enumerate(plain(rows)))
    gone = size if size >= 400 else 0
    assert [got[i][1] for i in range(4)] == [gone, gone, 2 * gone, 0]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a" * 401, "w", "x", "y", "z"), (2, None, None, None, None, None)],
                                 "doc_id long, text string, _row string, _body string, _sha string, kept_sha256 string")
    got = X.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r["_row"], r["_body"], r["_sha"], r["n_removed"]) for r in got] == [("w", "x", "y", 401), (None, None, None, 0)]


def test_repeated_and_null_ids(spark):
    long_text = " ".join(str(i * i) for i in range(300))
    docs = spark.createDataFrame([(None, long_text), (1, long_text), (1, "other " * 3), (1, "other " * 3)], "doc_id long, text string")
    got = sorted(X.without_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect(), key=str)
    n = len(long_text)
    assert sorted(map(tuple, got), key=str) == sorted([(None, n, n), (1, n, n), (1, 18, 0), (1, 18, 0)], key=str)
    assert X.without_repeats(docs.limit(0)).count() == 0


def test_query_as_by_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), plain([r["text"] for r in rows])))
    got = X.op3_repeats(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_same_rows_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(X.op3_repeats(spark, folder)) == oracle_rows(views(folder), X.SQL)


def test_no_join_broadcasts(spark, monkeypatch):
    """However small Spark takes a side to be: exploded windows of a small file once filled the driver."""
    plans, write = [], X.written

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(X, "written", written)
    docs = spark.createDataFrame(list(enumerate(texts(3))), "doc_id long, text string")
    written(X.without_repeats(docs))
    joins = [line for plan in plans for line in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in line]
    assert len(joins) >= 8 and all("SortMergeJoin" in line for line in joins), joins
