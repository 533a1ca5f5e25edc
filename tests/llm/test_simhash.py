"""SimHash: fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prefixloom.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, component string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    rows = [words[i:i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in rows]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """fp by id -> smallest reachable id by id."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def near_prints(n, seed):
    """Chains and clusters: random starts, then up to six bits changed from some earlier one."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64)]
    while len(out) < n:
        base = out[rng.randrange(len(out))] if rng.random() < 0.85 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize("split,seed", [(10**9, 1), (3, 2), (3, 3)])
def test_links_and_components_as_by_brute_force(spark, split, seed):
    prints = dict(enumerate(near_prints(150, seed)))
    signed = [(int(np.array([v], np.uint64).view(np.int64)[0]), k) for k, v in prints.items()]
    nodes = spark.createDataFrame(signed, "fp long, label long").groupBy("fp").agg(F.min("label").alias("label"))
    got = S.components(nodes, S.links(nodes.select("fp"), split=split))
    label = {r["fp"]: r["label"] for r in got.collect()}
    assert {k: label[fp] for fp, k in signed} == plain_components(prints)


@pytest.mark.parametrize("split", [2, 6, 40])
def test_keys_dealt_out_twice(spark, split):
    """A large cluster within few bits: the third segment alone leaves parts above the limit."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    low = [b for b in range(64) if not 13 <= b < 52]
    prints = {i: base ^ sum({1 << b for b in rng.sample(low, rng.randrange(5))}) for i in range(120)}
    signed = [(int(np.array([v], np.uint64).view(np.int64)[0]), k) for k, v in prints.items()]
    nodes = spark.createDataFrame(signed, "fp long, label long").groupBy("fp").agg(F.min("label").alias("label"))
    label = {r["fp"]: r["label"] for r in S.components(nodes, S.links(nodes.select("fp"), split=split)).collect()}
    assert {k: label[fp] for fp, k in signed} == plain_components(prints)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x", "y", "z"), (2, "A b c d e", "x", "y", "z")],
                                 "doc_id long, text string, _row_hash string, _copy string, _key string")
    assert [tuple(r) for r in S.one_of_each(docs).collect()] == [(1, "a b c d e", "x", "y", "z")]


def test_walk_of_a_long_key_finds_all_that_is_connected():
    members = np.unique(np.array(near_prints(60, 5), np.uint64) & np.uint64(~0x3FFFFFF & 2**64 - 1))
    links = S.group_links(members, 0)
    want = plain_components({int(m): int(m) for m in members})
    parent = {int(m): int(m) for m in members}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {m: find(m) for m in parent} == want


def test_documents_with_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (9, base, "x", "y"), (3, base.upper(), "x", None), (7, base + " end", None, None), (7, base + " end", None, None),
        (1, None, None, None), (2, "", None, None), (4, " \n\t", None, None), (5, "one two", None, None),
        (6, "ONE  two", None, None), (8, "É one", None, None), (10, "word " * 50_000, None, None), (None, base, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["fp"] % 2**64, r["component"]) for r in S.near_classes(docs).collect()]
    prints = {i: plain_fingerprint(t) for i, t, _, _ in rows if i is not None}
    want = plain_components(prints)
    assert sorted((x for x in got if x[0] is not None)) == sorted((i, prints[i], want[i]) for i, *_ in rows if i is not None)
    assert [x[2] for x in got if x[0] is None] == [3]
    assert S.near_classes(docs.limit(0)).count() == 0


def test_query_as_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    got = S.op10_simhash(spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        i: (f"{prints[i]:016x}", want[i]) for i in texts}
