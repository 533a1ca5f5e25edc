"""The pipeline against plain versions of its stages."""

from collections import Counter

import pytest
import sentencepiece
from compare import views
from pyspark.sql import functions as F
from test_secrets import base, entropy
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from prefixloom.llm import mixing, pieces, toxicity

FOLDER = "/root/testdata/sf0.001"


def masked(text):
    spans, out, at = sorted((a, b) for _, a, b in base(text) + entropy(text)), "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages_as_by_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    score = toxicity.fitted(docs, labels).scorer()
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    import pyarrow as pa

    scores = score(pa.array([r["text"] for r in rows.values()]))[0]
    rows = {i: r for (i, r), s in zip(rows.items(), scores) if s < 0.7}
    component = plain_components({i: plain_fingerprint(r["text"]) for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if component[i] == i}
    for r in rows.values():
        r["text"] = masked(r["text"])
    con = views(FOLDER)
    con.execute("DROP VIEW documents")
    import pandas as pd

    documents = pd.DataFrame(list(rows.values()))  # noqa: F841  DuckDB reads it by name
    dealt = con.execute(mixing.SQL.replace("<= 2.0 + 1e-12", f"<= {corpus_pipeline.REPEATS} + 1e-12")).fetchall()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter()
    for doc_id, *_ in dealt:
        want[doc_id, tuple(model.encode(rows[doc_id]["text"]))] += 1
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == want


def test_stages_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, long_text, "en", "s", 9), (2, long_text + " end", "en", "s", 9), (2, long_text + " end", "en", "s", 9),
            (3, None, None, None, None), (4, "", "en", "s", 0), (None, "no id here at all", "en", None, 3), (6, "password=abcdef12", None, "t", 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, FOLDER)
            n = out.count()
            assert n == 0 if table is not docs else n > 0, name
            if name != "token_ids":
                assert out.columns == docs.columns
    kept = corpus_pipeline.near_copies(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3, 6]
    masked_row = corpus_pipeline.without_secrets(spark, docs, FOLDER).filter("doc_id = 6").first()
    assert masked_row["text"] == "[SECRET]" and masked_row["n_chars"] == 8


@pytest.mark.parametrize("name", ["toxicity", "mixing"])
def test_clean_documents_stay(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 1").select("doc_id")
    clean = docs.join(toxic, "doc_id", "left_anti")
    kept = stage(spark, clean, FOLDER).select("doc_id").distinct()
    assert kept.count() >= 0.98 * clean.count()
    assert kept.join(clean, "doc_id", "left_anti").count() == 0 and F is not None
