"""Tiered completion: history, leading text, shortened prefix, fuzzy, popular."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import popularity_10521, rounded, share_of_max
from ..functions.similarity import BoundedBlock, TextBlock
from ..functions.text import normalize_loose
from ..schemas import ENGAGEMENT
from ..session import cut_lineage
from .dictionary import Dictionary, edge_match
from .lexical import EDGE_LEN
from .ranking import best, popular, top_k

DEPTH = 150
FUZZY_BLOCK = 20_000
MOST_CELLS = 2_000_000  # characters of texts, with padding, that are scored together
TOP_LEVEL, LOW_LEVEL = 6, 2


def by_score() -> list[Column]:
    """Rows of equal score go by the popularity itself, then by text."""
    return [F.desc("score"), F.desc("popularity"), F.asc("query")]


def clean_pool(pool: DataFrame, features: DataFrame) -> DataFrame:
    """(query, popularity, pop): the loosely normalised pool with its popularity.

    Both sides are made unique by the clean text before joining; counts of
    several raw texts with one clean text are their maxima.
    """
    queries = pool.select(normalize_loose("query").alias("query")).distinct()
    counts = (
        features.select(normalize_loose("query").alias("query"), *ENGAGEMENT)
        .groupBy("query")
        .agg(*[F.max(c).alias(c) for c in ENGAGEMENT])
    )
    rows = queries.join(counts, "query", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ENGAGEMENT}
    )
    scored = rows.select("query", popularity_10521().alias("popularity"))
    return scored.withColumn("pop", share_of_max(scored, F.col("popularity")))


def length_blocks(texts: list[str]) -> list[TextBlock]:
    """Texts in blocks of about one length, so a long text does not pad the others."""
    out, block = [], []
    for text in sorted(texts, key=len):
        if block and (len(text) > 2 * max(len(block[0]), 8) or (len(block) + 1) * len(text) > MOST_CELLS):
            out.append(TextBlock(block))
            block = []
        block.append(text)
    return [*out, TextBlock(block)] if block else out


def partial_matches(
    prefixes: DataFrame, pool: DataFrame, limit: int = 50, threshold: float = 60.0, min_len: int = 2
) -> DataFrame:
    """(prefix, query, score, compared): per prefix and block the best partial ratios, and a row without query with the texts compared.

    A threshold of 0.6 does not imply a shared bigram, so no join key prunes this exactly: the
    prefixes are a stated query set against all rows, in blocks. A task holds one block of about FUZZY_BLOCK queries,
    in classes of equal characters (BoundedBlock), and lets a part of the prefixes stream by. Bounds from above skip whole
    classes and most of the other rows; a small pool is one block that several tasks hold, so the bounds are those of the whole pool.
    """
    spark = prefixes.sparkSession
    texts = pool.select("query").filter(F.col("query").isNotNull()).distinct()
    blocks = max(-(-texts.count() // FUZZY_BLOCK), 1)
    splits = max(-(-2 * spark.sparkContext.defaultParallelism // blocks), 1)
    each = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    rows = texts.select(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), F.col("query").alias("text"))
    rows = rows.withColumn("split", each)
    asked = prefixes.select("prefix").distinct().filter(F.length("prefix") >= min_len)
    visits = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), F.col("prefix").alias("text"),
        F.pmod(F.xxhash64("prefix"), F.lit(splits)).cast("int").alias("split"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, waiting, block = None, [], None
        for batch in batches:
            out = []
            for key, side, text in zip(zip(batch["block"], batch["split"]), batch["side"], batch["text"]):
                if key != current:
                    current, waiting, block = key, [], None
                if side == 0:
                    waiting.append(text)
                elif waiting:
                    block = block or BoundedBlock(waiting, length_blocks(waiting))
                    found, compared = block.best(text, limit, threshold)
                    out += [(text, query, score, None) for score, query in found]
                    out.append((text, None, None, compared))
            yield pd.DataFrame(out, columns=["prefix", "query", "score", "compared"]).astype({"score": "float64", "compared": "Int64"})

    dealt = rows.unionByName(visits).repartition(blocks * splits, "block", "split").sortWithinPartitions("block", "split", "side", "text")
    return dealt.mapInPandas(match, "prefix string, query string, score double, compared long")


def fuzzy_partial_topk(
    prefixes: DataFrame, pool: DataFrame, limit: int = 50, threshold: float = 60.0, min_len: int = 2
) -> DataFrame:
    """(prefix, query, score, rk): best partial ratios among all pool queries."""
    found = partial_matches(prefixes, pool, limit, threshold, min_len).filter(F.col("query").isNotNull())
    return top_k(found.select("prefix", "query", "score"), ["prefix"], best(), limit)


def partial_work(prefixes: DataFrame, pool: DataFrame, limit: int = 50, threshold: float = 60.0, min_len: int = 2) -> DataFrame:
    """(n_prefixes, pairs, compared): what a search compares of all pairs."""
    n = pool.select("query").filter(F.col("query").isNotNull()).distinct().count()
    sums = partial_matches(prefixes, pool, limit, threshold, min_len).agg(
        F.countDistinct("prefix").alias("n_prefixes"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return sums.select("n_prefixes", (F.col("n_prefixes") * n).alias("pairs"), "compared")


def cascade(
    prefixes: DataFrame, freq: DataFrame, edges: DataFrame, pool: DataFrame, k: int = DEPTH, dictionary: Dictionary | None = None
) -> DataFrame:
    """(prefix, query, score, tier, rk): the k best completions over five tiers.

    A later tier adds only queries no earlier tier gave, and only where fewer
    than k are known: this is a count per prefix over bounded rows, not a loop.
    ``freq`` is (prefix, query, freq), ``pool`` comes from clean_pool, ``edges``
    from edge_index(pool, "popularity") with at least 3k rows per edge: k can be
    known from the first tiers and fewer than k from longer leading texts, so the
    k best new ones are among them and the result is that of the whole pool.
    Padding to k needs no step of its own: after the popular tier fewer than k
    rows means that the whole pool is in. ``dictionary`` is Dictionary.build(pool), kept for more than one call.
    """
    asked = prefixes.select("prefix", normalize_loose("prefix").alias("key")).distinct()
    keys = asked.select("key").distinct()
    n = F.length("key")
    near = edges.filter(F.col("ek") <= 3 * k)

    # tiers 1 and 2 add up; beyond the best k of them nothing can reach the result
    logged = freq.select(F.col("prefix").alias("key"), "query", "freq")
    boost = 50.0 + 20.0 * F.col("pop")
    tier1 = keys.join(logged, "key").join(pool.select("query", "popularity", "pop"), "query", "left").select(
        "key", "query", F.coalesce("popularity", F.lit(0)).alias("popularity"), (100.0 * F.col("freq")).alias("s1"),
        F.when((n > 0) & F.col("query").startswith(F.col("key")), boost).alias("s2"),
    )
    begin = keys.join(near.filter(F.col("ek") <= k), F.col("key") == F.col("edge")).select("key", "query", "popularity", "pop")
    rest = edge_match(keys.filter(n > EDGE_LEN), dictionary or pool, "key")
    begin = begin.unionByName(top_k(rest, ["key"], best("popularity"), k).select("key", "query", "popularity", "pop"))
    tier2 = begin.select("key", "query", "popularity", F.lit(None).cast("double").alias("s1"), boost.alias("s2"))
    first = tier1.unionByName(tier2).groupBy("key", "query").agg(
        F.max("popularity").alias("popularity"), F.max("s1").alias("s1"), F.max("s2").alias("s2")
    )
    score = rounded(F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0)))
    first = first.select("key", "query", "popularity", score.alias("score"), F.when(F.col("s1").isNotNull(), 1).otherwise(2).alias("tier"))
    first = top_k(first, ["key"], by_score(), k).drop("rk")

    # tier 3: longest shared leading text first, one level at a time until k are known
    level = F.explode(F.sequence(F.least(n, F.lit(TOP_LEVEL)), F.lit(LOW_LEVEL), F.lit(-1)))
    tier3 = (
        keys.filter(n >= LOW_LEVEL)
        .withColumn("level", level)
        .withColumn("head", F.substring(F.col("key"), F.lit(1), F.col("level")))
        .join(near, F.col("head") == F.col("edge"))
        .groupBy("key", "query")
        .agg(F.max("level").alias("level"), F.max("pop").alias("pop"), F.max("popularity").alias("popularity"))
        .select(
            "key", "query", "level", "popularity",
            rounded(25.0 * F.col("level") / n + 10.0 * F.col("pop")).alias("score3"),
        )
    )
    # a row without query keeps every key, found or not
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [first, tier3, keys.withColumn("query", F.lit(None).cast("string"))],
    )
    merged = rows.groupBy("key", "query").agg(
        *[F.max(c).alias(c) for c in ("score", "tier", "level", "score3", "popularity")]
    )
    w = Window.partitionBy("key")
    known = F.count("score").over(w)
    before = known + reduce(
        lambda a, b: a + b,
        [
            F.when(F.col("level") < i, F.count_if(F.col("score").isNull() & (F.col("level") == i)).over(w)).otherwise(0)
            for i in range(LOW_LEVEL, TOP_LEVEL + 1)
        ],
    )
    counted = merged.withColumn("before", before).filter(
        F.col("query").isNull() | F.col("score").isNotNull() | (F.col("before") < k)
    )
    upto3 = cut_lineage(
        counted.select(
            "key", "query", "popularity",
            F.coalesce("score", "score3").alias("score"),
            F.coalesce("tier", F.when(F.col("query").isNotNull(), 3)).alias("tier"),
        ).withColumn("n", F.count("query").over(w))
    )

    # tier 4
    open4 = upto3.filter(F.col("query").isNull() & (F.col("n") < k) & (n >= 3))
    fuzzy = fuzzy_partial_topk(open4.select(F.col("key").alias("prefix")), pool)
    tier4 = fuzzy.join(pool.select("query", "pop", "popularity"), "query").select(
        F.col("prefix").alias("key"), "query", "popularity",
        rounded(30.0 * F.col("score") / 100.0 + 10.0 * F.col("pop")).alias("score4"),
    )
    upto4 = cut_lineage(
        upto3.drop("n")
        .unionByName(tier4, allowMissingColumns=True)
        .groupBy("key", "query")
        .agg(*[F.max(c).alias(c) for c in ("score", "tier", "score4", "popularity")])
        .select(
            "key", "query", "popularity",
            F.coalesce("score", "score4").alias("score"),
            F.coalesce("tier", F.when(F.col("query").isNotNull(), 4)).alias("tier"),
        )
        .withColumn("n", F.count("query").over(w))
    )

    # tier 5: popular queries by rank, until 2k are known; broadcast side: 2k rows
    top = popular(pool, "popularity", 2 * k).select(
        "query", "pop", "popularity",
        F.row_number().over(Window.orderBy(F.desc("popularity"), F.asc("query"))).alias("prk"),
    )
    open5 = upto4.filter(F.col("query").isNull() & (F.col("n") < k)).select(
        "key", F.explode(F.sequence(F.lit(1), F.lit(2 * k))).alias("prk")
    )
    tier5 = open5.join(F.broadcast(top), "prk").select(
        "key", "query", "prk", "popularity", rounded(5.0 * F.col("pop")).alias("score5")
    )
    fill = Window.partitionBy("key", F.col("score").isNull()).orderBy("prk")
    upto5 = (
        upto4.filter(F.col("query").isNotNull())
        .drop("n")
        .unionByName(tier5, allowMissingColumns=True)
        .groupBy("key", "query")
        .agg(*[F.max(c).alias(c) for c in ("score", "tier", "prk", "score5", "popularity")])
        .withColumn("known", F.count("score").over(w))
        .withColumn("nth", F.row_number().over(fill))
        .filter(F.col("score").isNotNull() | (F.col("known") + F.col("nth") <= 2 * k))
        .select(
            "key", "query", "popularity",
            F.coalesce("score", "score5").alias("score"),
            F.coalesce("tier", F.lit(5)).alias("tier"),
        )
    )
    ranked = top_k(upto5, ["key"], by_score(), k)
    return asked.join(ranked, "key").select("prefix", "query", "score", "tier", "rk")
