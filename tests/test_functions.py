import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixloom.functions import scores, text
from prefixloom.functions.similarity import TextBlock, partial_ratio_pairs, ratio_pairs, register


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        last = row
        row = [0]
        for j, other in enumerate(b):
            row.append(last[j] + 1 if ch == other else max(last[j + 1], row[j]))
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    a, b = sorted((a, b), key=len)

    def one(p, t):
        m, n = len(p), len(t)
        windows = [t[max(s, 0) : s + m] for s in range(1 - m, n)]
        return max(ratio(p, w) for w in windows)

    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def words(n, sizes, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abc é") for _ in range(rnd.choice(sizes))) for _ in range(n)]


def test_ratio_known_values():
    got = ratio_pairs(["kitten", "ifon 16", "", ""], ["sitting", "iphone 16", "", "a"])
    assert np.allclose(got, [8 / 13, 12 / 16, 1, 0])


def test_ratio_against_brute_force():
    a, b = words(150, [0, 1, 5, 12, 64, 65, 70], 1), words(150, [0, 2, 9, 64, 66, 80], 2)
    assert np.allclose(ratio_pairs(a, b), [ratio(x, y) for x, y in zip(a, b)])


def test_partial_ratio_against_brute_force():
    a, b = words(120, [0, 1, 2, 3, 8, 20, 65], 3), words(120, [0, 1, 3, 8, 20, 40, 66], 4)
    assert np.allclose(partial_ratio_pairs(a, b), [partial(x, y) for x, y in zip(a, b)])


def test_partial_ratio_equal_lengths_tries_both_directions():
    assert partial_ratio_pairs(["abcd"], ["cdab"])[0] == partial("abcd", "cdab")


def test_text_block_matches_pairs():
    texts = words(60, [1, 3, 8, 20, 66], 5)
    block = TextBlock(texts)
    for p in words(12, [1, 2, 7, 20], 6):
        assert np.allclose(block.partial_ratio(p), [partial(p, t) for t in texts])


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalizers(spark):
    strict = values(spark, ["  Brand#7, RED  ", None, "É clair", "a b"], text.normalize_strict("s"))
    assert strict == ["brand 7 red", "", "clair", "a b"]
    loose = values(spark, ["  A  \x1c b  ", None], text.normalize_loose("s"))
    assert loose == ["a b", ""]
    assert values(spark, ["Anti-Age cream!"], text.clean_query("s")) == ["anti-age cream"]


def test_tokens_and_trigrams(spark):
    assert values(spark, ["", " a  b "], text.tokenize("s")) == [[], ["a", "b"]]
    grams = values(spark, ["a b", "abcd", "", "aaaa"], text.char_trigrams("s"))
    assert [set(g) for g in grams] == [{"ab"}, {"abc", "bcd"}, {""}, {"aaa"}]


def test_gram_codes_are_one_to_one(spark):
    texts = ["", "a", "ab", "abc", "b", "abd", "0", "zz9"]
    codes = values(spark, texts, text.gram_codes(text.char_trigrams("s")))
    assert len({c[0] for c in codes}) == len(texts)


def test_prefix_position(spark):
    df = spark.createDataFrame([("shoe", "red shoe"), ("x", "red"), ("", "red"), ("a", "")], "p string, q string")
    got = [r[0] for r in df.select(scores.prefix_position(F.col("p"), F.col("q"))).collect()]
    assert got == [4 / 8, 1.0, 1.0, 1.0]


def test_l2_normalize(spark):
    row = spark.range(1).select(scores.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)), 0.5).alias("v")).first()
    assert row.v == pytest.approx([0.3, 0.4])


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT ratio('ifon 16', 'iphone 16')").first()[0] == 0.75


def test_murmur3_of_published_vectors(spark):
    """Published values of MurmurHash3 x86 32, the last ones as signed numbers."""
    known = [
        ("", 0, 0), ("test", 0, 0xBA6BD213), ("Hello, world!", 0, 0xC0363E43), ("The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723),
        ("test", 0x9747B28C, 0x704B81DC), ("Hello, world!", 0x9747B28C, 0x24884CBA), ("The quick brown fox jumps over the lazy dog", 0x9747B28C, 0x2FA826CD),
        ("foo", 0, -156908512 % 2**32), ("foo", 42, -1322301282 % 2**32),
    ]
    for word, seed, want in known:
        got = spark.createDataFrame([(word,)], "w string").select(text.murmur3("w", seed)).first()[0]
        assert got % 2**32 == want and -(2**31) <= got < 2**31


def test_murmur3_of_odd_texts(spark):
    """Against plain loops over the bytes: all lengths modulo 4, several bytes a character, a long text, null."""
    def plain(data):
        m, h = 2**32 - 1, 0
        def mix(k):
            k = k * 0xCC9E2D51 & m
            return (k << 15 | k >> 17) * 0x1B873593 & m
        for i in range(0, len(data) // 4 * 4, 4):
            h ^= mix(int.from_bytes(data[i:i + 4], "little"))
            h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
        h ^= mix(int.from_bytes(data[len(data) // 4 * 4:], "little")) ^ len(data)
        for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> by) * factor & m
        return h - 2**32 if h >= 2**31 else h

    words = ["a", "ab", "abc", "abcd", "abcde", "käse", "日本語", "🙂", "é" * 7, "x\ny", " ", "long " * 20_000]
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", text.murmur3("w").alias("h")).collect()
    assert {r["w"]: r["h"] for r in rows} == {**{w: plain(w.encode()) for w in words}, None: None}
