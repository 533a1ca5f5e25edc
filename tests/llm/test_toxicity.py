"""Toxicity: held-out accuracy, and odd rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.llm import toxicity as X
from prefixloom.llm.common import remainder

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = X.op2_toxicity(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert scored.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert len(rows) > 50 and wrong <= 0.1 * len(rows)
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_odd_rows(spark):
    rows = [(1, "you scum of the town", "a"), (1, "you scum of the town", "a"), (2, "kind words for all", None),
            (3, None, None), (4, "", None), (None, "you scum", None), (5, "ab", None), (6, "scum " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = X.fit([(f"you scum number {i}", 1) for i in range(40)] + [(f"good day number {i}", 0) for i in range(40)])
    got = X.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and dict(got.dtypes)["score"] == "double"
    by = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    assert got.count() == len(rows) and all(0 <= s <= 1 for s in by.values())
    assert by[1, rows[0][1]] > 0.7 > by[2, rows[2][1]]
    assert by[3, None] == by[4, ""]
    assert X.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("rows,share", [([], 0), ([("a", 1)], 1), ([("a", 0), ("b", 0)], 0)])
def test_fit_without_both_classes(rows, share):
    import pyarrow as pa

    score = X.fit(rows).scorer()(pa.array(["text", None]))[0]
    assert score == pytest.approx([share, share], abs=1e-6)


def test_held_out_rows_are_not_learnt_from(spark):
    ids = spark.range(30).select(F.col("id").alias("doc_id"))
    marked = {r["doc_id"]: r["h"] for r in ids.select("doc_id", remainder(3, 1)(F.col("doc_id")).alias("h")).collect()}
    import zlib

    assert marked == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(30)}


def plain_grams(text, bits):
    """The hashed n-grams of a text, by Python integers."""
    codes, out, top = [ord(c) for c in text.lower()], set(), 1 << 64
    for size in X.SIZES:
        for i in range(len(codes) - size + 1):
            rolled = codes[i]
            for c in codes[i + 1:i + size]:
                rolled = (rolled * 0x9E3779B97F4A7C15 + c) % top
            out.add(((rolled ^ (rolled >> 29)) * (0xBF58476D1CE4E5B9 + 2 * size) % top) >> (64 - bits))
    return out


def test_ratios_and_scores_as_by_plain_counts(spark):
    """Features, smoothed log-count ratios and scores against plain counts, given the learned weights."""
    import math

    import pyarrow as pa

    folder = "/root/testdata/sf0.001"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"][:1500] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [(texts[i], y) for i, y in sorted(labels.items()) if i in texts and y is not None]
    bits = X.BITS
    sets = [(plain_grams(t, bits), y) for t, y in rows]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    assert min(n) > 0
    model = X.fit(rows)
    counts = [Counter(f for s, y in sets if y == k for f in s) for k in (0, 1)]
    learned = {}
    assert set(np.flatnonzero(model.weights).tolist()) <= set(counts[0] | counts[1])
    for f in counts[0] | counts[1]:
        other, toxic = counts[0][f], counts[1][f]
        share = (other + toxic) / len(rows)
        error = math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
        if not (error > 0 and abs(toxic / n[1] - other / n[0]) >= X.ERRORS * error):
            assert model.weights[f] == 0  # no feature
            continue
        ratio = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((other + 0.5) / (n[0] + 1))
        learned[f] = model.weights[f] / ratio
    assert learned and sum(w > 0 for w in learned.values()) > 0.5 * len(learned)  # weights on ratios are mostly positive
    for text, (found, _) in list(zip(texts.values(), ((plain_grams(t, bits), 0) for t in texts.values())))[:40]:
        logit = model.intercept + sum(float(model.weights[f]) for f in found)
        assert model.scorer()(pa.array([text]))[0][0] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "good day", "x", 2.0), (2, None, "y", None)], "doc_id long, text string, _toxic string, _toxic_score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(map(tuple, X.accepted(docs, labels).collect())) == [(1, "good day", "x", 2.0), (2, None, "y", None)]
