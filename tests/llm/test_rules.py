"""Quality rules against plain counts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prefixloom.llm import rules as X

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
ODD = [None, "", " \n\n ", "\n", "a", "a b c d e a b c d e", "x\nx\nx", "x \nx\n x\n\n\nx", "é|ß é|ß <漢字> #", "a\x0bb\x0cc d\x1fe\x85",
       "one two three four five six seven eight nine ten", "w " * 30_000, "x" * 100_000, "tail\n", "\nhead", "r\r\nr\r\n"]


def test_counts_of_odd_texts():
    for texts in (ODD, ODD[::-1], ODD * 3):
        words = X.Words(pa.array(texts))
        got = zip(words.counts, words.repeated_lines(), words.repeated_words())
        want = [plain(t) for t in texts]
        assert [tuple(map(int, g)) for g in got] == [(w[0], w[3], w[4]) for w in want]


def test_query_as_by_plain_counts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = X.op9_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == plain(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= X.THRESHOLD)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [r for r in rows if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in rows if quality.get(r["doc_id"]) == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_ratio_table_as_by_plain_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (2, "b"), (3, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = X.ngram_counts(docs, labels)
    assert tuple(got.agg(F.sum("raw"), F.sum("trusted")).first()) == (3 + 2 + 2 + 1, 5)
    values = X.ratios(got)
    one, two = X.Words(pa.array(["a b a"])).buckets()
    t, r = np.log(3 / (5 + 65536)), np.log(3 / (8 + 65536))
    assert values[one[0]] == round((t - r) * X.UNIT) and two[2] == -1
    assert not X.ratios(X.ngram_counts(docs, labels.limit(0))).any()


def test_plain_join_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(100)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    want = X.ratios(X.ngram_counts(docs, labels))
    monkeypatch.setattr(X, "FEW_IDS", 3)
    assert (X.ratios(X.ngram_counts(docs, labels)) == want).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, "a", "a"])], "doc_id long, text string, kept string")
    out = X.judged(docs, np.zeros(1 << X.BITS, np.int64))
    assert len(out.columns) == len(set(out.columns)) and dict(out.dtypes)["kept"] == "boolean"
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in out.collect()} == {i: plain(t) for i, t in enumerate([*ODD, "a", "a"])}
    assert X.judged(docs.limit(0), np.zeros(1 << X.BITS, np.int64)).count() == 0
