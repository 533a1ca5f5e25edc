"""SentencePiece encoding against the public library, and exact round trips."""

import random

import numpy as np
import pytest

from prefixloom.llm import pieces as X


@pytest.fixture(scope="module")
def model():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=X.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return X.Vocabulary()


ODD = ["", " ", "   a", "a   ", " a  b", "a\tb\n c", "ﬁ Å ½ \u3000x", "▁x", "é😀\x00z", "<s> </s> <unk> <0x41>", "a" * 3000,
       "😀" * 500, "x" * 5000 + " y", " " * 3000, "漢字かな交じり文", "\x00\x00", "na\u0308ive"]


def split(encoder, texts):
    ids, counts = encoder.encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_same_ids_as_the_library(model, vocabulary):
    rng = random.Random(7)
    letters = "aabcdehilnorstuw  ééñ漢кир😀\n\t.,0123ABTH"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    encoder = X.Encoder(vocabulary)
    assert split(encoder, texts) == [model.encode(t) for t in texts]
    assert split(encoder, texts[::-1]) == [model.encode(t) for t in texts[::-1]]


def test_store_of_units_starts_anew(model, vocabulary, monkeypatch):
    monkeypatch.setattr(X, "MOST_UNITS", 10)
    encoder = X.Encoder(vocabulary)
    for i in range(5):
        texts = [f"some words {i} {j} here" for j in range(20)]
        assert split(encoder, texts) == [model.encode(t) for t in texts]


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(3)
    body = np.concatenate([rng.integers(97, 99, 400).astype(np.uint8), np.full(33, X.END, np.uint8)])
    order, _ = X.suffix_order(body, 32)
    raw = body.tobytes()
    keys = [raw[i:i + 32].split(b"\xff")[0] + b"\xff" for i in order]
    assert sorted(order) == list(range(400)) and keys == sorted(keys)


def test_query_and_round_trip(spark, model, vocabulary):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = X.op8_pieces(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == model.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_odd_rows(spark, model, vocabulary):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, None, "again", "again"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = X.encoded(docs, vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "round_trip"]
    for r in out.collect():
        assert r["ids"] == (model.encode(r["text"]) if r["text"] else [])
        assert r["round_trip"] == ("▁" not in (r["text"] or ""))
    back = X.decoded(out.select("doc_id", "ids"), vocabulary)
    plain = {i: (t or "").replace("▁", " ") for i, t, _ in rows}
    assert {r["doc_id"]: r["text"] for r in back.collect()} == plain
    assert X.encoded(docs.limit(0), vocabulary).count() == 0
