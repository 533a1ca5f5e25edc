"""Partial ratios with bounds: the same rows as comparing all, with few compared."""

import random

import numpy as np
import pytest

from prefixloom.functions.similarity import BoundedBlock, TextBlock, partial_ratio_pairs
from prefixloom.operators.cascade import length_blocks, partial_work

ALPHABETS = ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz 0123456789", "абвгдежз" + "".join(map(chr, range(0x4E00, 0x4E60)))]


def plain(texts, pattern, limit, threshold):
    score = np.round(100 * partial_ratio_pairs([pattern] * len(texts), texts), 6)
    return [(-s, t) for s, t in sorted((-s, t) for s, t in zip(score.tolist(), texts) if s >= threshold)[:limit]]


@pytest.mark.parametrize("seed", range(4))
def test_best_rows_as_by_comparing_all(seed, monkeypatch):
    monkeypatch.setattr(BoundedBlock, "FIRST", 3)
    monkeypatch.setattr(BoundedBlock, "BATCH", 7)
    rng = random.Random(seed)
    for _ in range(40):
        letters = rng.choice(ALPHABETS)
        texts = list({"".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 8, 20, 40, 90]))) for _ in range(rng.randrange(1, 120))})
        block = BoundedBlock(texts, length_blocks(texts))
        for _ in range(6):
            pattern = "".join(rng.choice(letters + "!") for _ in range(rng.choice([1, 2, 3, 5, 9, 15, 40, 70])))
            if rng.random() < 0.4:
                pattern = rng.choice(texts)[:rng.randrange(1, 20)] or pattern
            limit, threshold = rng.choice([1, 3, 50]), rng.choice([1.0, 60.0, 90.0])
            found, compared = block.best(pattern, limit, threshold)
            assert found == plain(texts, pattern, limit, threshold)
            assert len(found) <= compared <= len(texts)


def test_window_bounds_hold():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(9, 40))) for _ in range(200)]
    block = TextBlock(texts)
    for m in (1, 2, 5, 8):
        pattern = "".join(rng.choice("abcdefg") for _ in range(m))
        some = np.arange(0, 200, 3)
        assert (block.window_bound(pattern, some) + 1e-9 >= block.partial_ratio(pattern, some)).all()


def test_few_pairs_are_compared(spark):
    """Under a tenth of all pairs where the pool is large beside the limit."""
    from prefixloom.sources.fixtures import Tables

    tables = Tables(spark, "/root/testdata/sf0.1")
    work = partial_work(tables.prefixes(), tables.pool()).first()
    assert work["pairs"] == work["n_prefixes"] * tables.pool().count() > 1_000_000
    assert work["compared"] < work["pairs"] / 10
