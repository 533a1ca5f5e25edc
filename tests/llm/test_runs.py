"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from prefixloom.llm import runs as R


def plain_runs(words):
    """Every maximal stretch of every period, the smallest period of a stretch first."""
    found = {}
    for period in range(1, len(words) // 3 + 1):
        i = 0
        while i + period < len(words):
            if words[i] != words[i + period]:
                i += 1
                continue
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i + period - start >= max(24, 3 * period):
                found.setdefault((start, i + period), period)
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(words):
    found = plain_runs(words)
    gone = {i for a, b, p in found for i in range(a + p, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (
        len(found), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
        sha("".join(f"{a},{b - a},{p}\n" for a, b, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def random_words(rng):
    n, kinds = rng.randrange(300), rng.choice([1, 2, 2, 3, 5, 30])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(5)):
        if n < 5:
            break
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 3 + 1))
        for i in range(a, min(n, a + rng.randrange(n))):
            words[i] = words[a + (i - a) % p]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = 99
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(100):
        words = random_words(rng)
        assert R.runs(np.array(words, np.int64)) == plain_runs(words)


def test_runs_within_runs_and_at_the_limits():
    cases = [
        [0] * 23, [0] * 24, [0, 1] * 12, [0, 1] * 11 + [0], list(range(8)) * 3, (list(range(9)) * 3)[:26], list(range(9)) * 3,
        ([0] * 30 + [1]) * 4, (list(range(7)) * 5 + [9]) * 3, ([0, 1] * 20 + [2] + [0, 1] * 20 + [3]) * 5, (list(range(400)) * 3),
        (list(range(400)) * 3)[:1199], [1] + list(range(64)) * 4 + [2], [5] * 100 + [6] * 100,
    ]
    fib, after = [0], [0, 1]
    while len(after) < 900:
        fib, after = after, after + fib
    for words in cases + [after]:
        assert R.runs(np.array(words, np.int64)) == plain_runs(words), words[:50]


def test_equal_contexts_are_selected_alike():
    """Consistency and density of the synchronising sets at one scale."""
    rng = random.Random(3)
    words = np.array([rng.randrange(3) for _ in range(4_000)], np.int64)
    names, size = R.mixed(words.view(np.uint64)), 1
    while size < 8:
        names, size = R.mixed(names[:-size] * np.uint64(0x9E3779B97F4A7C15) + names[size:]), size * 2
    periodic = np.array([any((words[i:i + 8 - p] == words[i + p:i + 8]).all() for p in (1, 2)) for i in range(len(names))])
    at = set(R.selected(names, 8, periodic).tolist())
    by_context = {}
    for i in range(len(words) - 16):
        by_context.setdefault(words[i:i + 16].tobytes(), set()).add(i in at)
    assert all(len(v) == 1 for v in by_context.values())
    for i in range(len(words) - 24):
        if not at & set(range(i, i + 8)):
            part = words[i:i + 23]
            assert any((part[:-p] == part[p:]).all() for p in (1, 2))


def test_texts_of_a_slice_do_not_meet():
    texts = [[b"a"] * 20, [b"a"] * 20, [], [b"a"] * 30, [b"b", b"a"] * 13]
    assert R.by_text(texts) == [[], [], [], [(0, 30, 1)], [(0, 26, 2)]]
    assert R.by_text([]) == []


SCHEMA = "doc_id long, text string, runs string, n_runs string, start int"


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + " x y" * 20
    texts = [None, "", " \n\t", "a", "a " * 24, "A b " * 30, "é ê " * 13, long, "a b " * 12, "a b " * 12, "\x00 " * 30]
    rows = [(i if i else None, t, "x", None, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = R.described(docs).collect()
    want = {i: plain_row((t or "").encode().split()) for i, t in enumerate(texts) if i != 7}
    fields = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r["doc_id"] or 0: tuple(r[f] for f in fields) for r in got if r["doc_id"] != 7} == want
    seven = next(r for r in got if r["doc_id"] == 7)
    assert (seven["n_runs"], seven["start"], seven["length"], seven["period"]) == (1, 30_000, 40, 2)
    assert R.described(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["runs"] for r in R.spans(docs).collect()}[4] == [0, 24, 1]


def test_query_as_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {r["doc_id"]: plain_row(plain_planted(r["doc_id"], (r["text"] or "").encode().split())) for r in docs}
    got = {r["doc_id"]: tuple(r)[1:] for r in R.op13_runs(spark, folder).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_planted_words(spark):
    rows = [(i, t) for i in range(400) for t in ("one", "a b c d e f g h i j k l m n", "", None)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", "text", R.planted(docs["text"], docs["doc_id"]).alias("new")).collect()
    for r in got:
        words = (r["text"] or "").split()
        assert (r["new"] or "").split() == (words if r["doc_id"] is None else plain_planted(r["doc_id"], words))
