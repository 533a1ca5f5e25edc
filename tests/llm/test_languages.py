"""The conditional random field: probabilities and gradients by enumeration, accuracy on held-out rows."""

import itertools
import zlib

import numpy as np
import pytest

from prefixloom.llm import languages as L


def plain_shares(emit, first, change):
    """Label probabilities of one sequence by enumerating all label sequences, and the normaliser."""
    n, size = emit.shape
    total = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n):
        p = first[labels[0]] * np.prod([emit[i, k] for i, k in enumerate(labels)])
        p *= np.prod([change[a, b] for a, b in zip(labels, labels[1:])])
        for i, k in enumerate(labels):
            total[i, k] += p
    return total / total.sum(axis=1, keepdims=True), total[0].sum()


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_forward_backward_by_enumeration(block):
    rng = np.random.default_rng(0)
    lengths = [1, 7, 2, 6, 5, 3, 1]
    starts = np.cumsum([0] + lengths)
    emit, first, change = rng.random((sum(lengths), 3)) + 0.01, rng.random(3) + 0.1, rng.random((3, 3)) + 0.05
    share = L.forward_backward(emit, starts, first, change, block)[2]
    for a, b in zip(starts[:-1], starts[1:]):
        assert np.allclose(share[a:b], plain_shares(emit[a:b], first, change)[0])


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    logits, labels = rng.normal(size=(2 * 4, 3)), rng.integers(0, 3, (2, 4))
    first, change = rng.normal(size=3), rng.normal(size=(3, 3))

    def loss(u, f, c):
        out = 0.0
        for i in range(2):
            part, want = u[4 * i:4 * i + 4], labels[i]
            score = f[want[0]] + part[np.arange(4), want].sum() + c[want[:-1], want[1:]].sum()
            out += np.log(plain_shares(np.exp(part), np.exp(f), np.exp(c))[1]) - score
        return out / 2

    got = L.gradients(np.exp(logits), labels, first, change)
    for which, value in enumerate([logits, first, change]):
        for at in np.ndindex(value.shape):
            moved = [x.copy() for x in (logits, first, change)]
            moved[which][at] += 1e-5
            up = loss(*moved)
            moved[which][at] -= 2e-5
            assert abs((up - loss(*moved)) / 2e-5 - got[which][at]) < 1e-6


def test_slots_do_not_depend_on_neighbours():
    words = ["a", "the", "über", "a", "x" * 300, "1", "né"]
    slots, edge = L.slots_of(words)
    for i, w in enumerate(words):
        alone, _ = L.slots_of([w])
        assert sorted(slots[edge[i]:edge[i + 1]]) == sorted(alone)
        n = len(w) + 2
        assert len(alone) == (n - 1) + (n - 2) + sum(len(w) >= k for k in (1, 2, 3)) + sum(len(w) >= k for k in (1, 2, 3, 4))


EN = "the of and that with from there which their would about other into could more some these than then".split()
DE = "der die und nicht auch sich eine nach oder über werden haben schon zwischen könnte ihre wieder durch".split()


def two_languages():
    rng = np.random.default_rng(4)
    return [(" ".join(rng.choice(words, 60)), lang) for lang, words in (("en", EN), ("de", DE)) for _ in range(30)]


def test_code_switched_words(spark):
    model = L.fit(two_languages(), steps=120)
    text = " ".join(EN[:8] + ["42"] + DE[:8] + EN[8:14])
    got = model.label_words([text, "", "12 34"])
    assert got == [["en"] * 8 + ["und"] + ["de"] * 8 + ["en"] * 6, [], ["und", "und"]]
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, word_langs string")
    assert {r["doc_id"]: r["word_langs"] for r in L.labelled_words(docs, model).collect()} == {1: got[0], 2: []}
    assert model.change[0, 0] > model.change[0, 1] and model.change[1, 1] > model.change[1, 0]


def test_odd_rows(spark):
    model = L.fit(two_languages(), steps=120)
    texts = [None, "", " \n", "12 !? 3", "THE OF AND", "der die und", "der die und", "the " * 40_000 + "der", "x" * 100_000, "中文"]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predicted(docs, model).collect()}
    assert [got[i] for i in range(4)] == [("und", 0.0)] * 4
    assert [got[i][0] for i in (4, 5, 6, 7)] == ["en", "de", "de", "en"] and got[5] == got[6]
    assert all(0 <= s <= 1 for _, s in got.values()) and {got[8][0], got[9][0]} <= {"en", "de"}
    assert L.predicted(docs.limit(0), model).count() == 0


def test_fits_of_few_rows():
    assert L.fit([]).predict(["the of"]) == [("und", 0.0)]
    assert L.fit([("the of", "en")]).predict(["der die", "1"]) == [("en", 1.0), ("und", 0.0)]
    assert L.fit([("", "en"), ("12", "de")]).predict(["der die"])[0][0] in ("de", "en")


def test_fit_rows_leave_held_out_rows_out(spark):
    rows = [(i, f"text {i % 5}", "en" if i % 3 else None) for i in range(60)] + [(None, "null key", "fr"), (61, None, "fr"), (62, "x" * 9_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = L.remainder(4, 2)(docs["doc_id"])
    got = L.fit_rows(docs, held_out, most=7)
    assert sorted(lang for _, lang in got) == ["en"] * 7 + ["fr"]
    assert got == L.fit_rows(docs.repartition(7), held_out, most=7)
    assert L.fit_rows(docs.limit(0), held_out) == []


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = L.op12_languages(spark, folder).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in lang}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
