"""Quality classifier: held-out accuracy, pooling over blocks, and odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from prefixloom.llm import quality as X

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = X.op1_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert len(good) > 20 and len(bad) > 3
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.5 * len(bad)


def test_chunks_cover_whole_texts():
    for n in (0, 1, 15, 16, 31, 32, 33, 48, 49, 1000):
        body = np.arange(n).astype(np.uint8)
        codes, lags = X.chunks(body)
        assert len(codes) == len(lags) and lags.shape[1] == X.LAGS + 1
        whole = np.concatenate([codes[0], codes[1:, X.STEP:].ravel()])
        assert (whole[:n] == body).all() and (whole[n:] == X.MARK).all()


def test_lags_show_repeats():
    _, lags = X.chunks(np.frombuffer(b"abcde " * 30, np.uint8))
    assert (lags[1:-2, 5] == 1).all() and (lags[1:-2, -1] == 1).all()


def test_pooling_in_blocks(monkeypatch):
    model = X.fit([("plain words here", 1), ("XXXX!! XXXX!!", 0)] * 4, steps=1)
    body = np.frombuffer(b"some text of several chunks " * 40, np.uint8)
    want = model.pooled(body)
    monkeypatch.setattr(X, "CHUNKS_AT_ONCE", 3)
    assert np.allclose(model.pooled(body), want, atol=1e-5)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x", None), (None, "y" * 200_000, None), (4, "same", None), (4, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = X.fit([("plain words here", 1), ("XXXX!! XXXX!!", 0)] * 4, steps=2)
    out = X.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], set()).add(r["score"])
        assert 0 <= r["score"] <= 1
    assert by[1] == by[2] and len(by[4]) == 1
    assert X.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("rows,share", [([], 0.5), ([("a", 1)], 1), ([("a", 0)], 0)])
def test_fit_without_both_classes(rows, share):
    assert X.fit(rows).scorer()(pa.array(["text", None]))[0] == pytest.approx([share, share], abs=1e-5)


def plain_score(model, body):
    """The network's probability for one text by Python loops over its chunks."""
    n = max(1, -(-max(len(body) - X.CHUNK, 0) // X.STEP) + 1)
    pooled = [0.0] * len(model.weights)
    for c in range(n):
        at = [c * X.STEP + i for i in range(X.CHUNK)]
        codes = [body[i] if i < len(body) else X.MARK for i in at]
        shares = [sum(lag <= i < len(body) and body[i] == body[i - lag] for i in at) / X.CHUNK for lag in range(1, X.LAGS + 1)]
        inputs = [float(v) for code in codes for v in model.vectors[code]] + shares + [max(shares)]
        for f in range(len(pooled)):
            value = sum(x * float(w) for x, w in zip(inputs, model.filters[:, f])) + float(model.offsets[f])
            pooled[f] = max(pooled[f], value)
    logit = sum(p * float(w) for p, w in zip(pooled, model.weights)) + model.intercept
    return 1 / (1 + math.exp(-logit))


def test_scores_as_by_plain_loops(monkeypatch):
    monkeypatch.setattr(X, "CHUNKS_AT_ONCE", 3)  # chunks come in several blocks
    texts = ["good words are here to stay " * 6, "a" * 200, "x", "", "é " * 31, "ab" * 16, "z" * 33, "one two three, " * 11]
    model = X.fit([(t, i % 2) for i, t in enumerate(texts)], steps=20)
    got = model.scorer()(pa.array([*texts, None]))[0]
    for score, text in zip(got, [*texts, ""]):
        assert abs(score - plain_score(model, text.encode())) < 1e-6
