"""Candidate merge, pruning and weighted re-ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rounded
from ..functions.similarity import partial_ratio, ratio
from ..functions.text import normalize_strict
from ..schemas import ENGAGEMENT
from .ranking import best, top_k

SOURCES = ["sem", "bm25", "ngram", "fuzzy"]

# Candidates per source, candidates kept, completions returned.
SEMANTIC_K, BM25_K, TRIGRAM_K, FUZZY_K = 20, 20, 10, 10
MAX_CANDIDATES = 50
FINAL_K = 10

# The two weightings of the re-ranker.
PROFILES = {
    "a": {
        "exact": 50.0, "starts": 20.0, "sem": 30.0, "partial": 25.0, "bm25": 20.0,
        "orders": 15.0, "ratio": 12.0, "ngram": 10.0, "volume": 15.0, "clicks": 15.0,
        "contains": 5.0, "views": 10.0, "len_ratio": 0.0, "fuzzy": 20.0, "len_diff": 0.0,
    },
    "b": {
        "exact": 100.0, "starts": 50.0, "sem": 30.0, "partial": 25.0, "bm25": 20.0,
        "orders": 15.0, "ratio": 12.0, "ngram": 10.0, "volume": 8.0, "clicks": 6.0,
        "contains": 5.0, "views": 4.0, "len_ratio": 3.0, "fuzzy": 2.0, "len_diff": -0.5,
    },
}


def source_rows(ranked: DataFrame, source: str) -> DataFrame:
    """(prefix, query, score) as a row with one source column filled."""
    cols = [F.col("score").alias(s) if s == source else F.lit(None).cast("double").alias(s) for s in SOURCES]
    return ranked.select("prefix", "query", *cols)


def trigram_rows(
    grams: DataFrame, k: int = TRIGRAM_K, fuzzy_k: int = FUZZY_K, threshold: float = 0.7, min_len: int = 3,
    fuzzy: bool = True,
) -> DataFrame:
    """Trigram and fuzzy source columns from one trigram result of depth 3*fuzzy_k.

    The window runs on the partitioning the trigram ranking already has.
    """
    gram = F.when(F.col("rk") <= k, F.col("score"))
    if not fuzzy:
        return source_rows(grams.filter(F.col("rk") <= k), "ngram")
    lcs = ratio(normalize_strict("prefix"), normalize_strict("query"))
    eligible = (F.length("prefix") >= min_len) & (F.col("rk") <= 3 * fuzzy_k) & (F.col("raw") >= threshold)
    w = Window.partitionBy("prefix").orderBy(F.desc_nulls_last("f"), F.asc("query"))
    return (
        grams.withColumn("raw", lcs)
        .withColumn("f", F.when(eligible, rounded(F.col("raw"))))
        .withColumn("frk", F.row_number().over(w))
        .select(
            "prefix", "query",
            F.lit(None).cast("double").alias("sem"), F.lit(None).cast("double").alias("bm25"),
            gram.alias("ngram"), F.when(F.col("frk") <= fuzzy_k, F.col("f")).alias("fuzzy"),
        )
        .filter(F.col("ngram").isNotNull() | F.col("fuzzy").isNotNull())
    )


def merge_sources(*parts: DataFrame) -> DataFrame:
    """One row per (prefix, query) with the score of each source, 0 where absent."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("prefix", "query").agg(
        *[F.coalesce(F.max(s), F.lit(0.0)).alias(s) for s in SOURCES]
    )


def candidates(
    semantic: DataFrame, bm25: DataFrame, grams: DataFrame, fuzzy: bool = True, limit: int | None = MAX_CANDIDATES
) -> DataFrame:
    """(prefix, query, sem, bm25, ngram, fuzzy) from the three retrieval results.

    ``grams`` must reach depth 30 for the fuzzy source.
    """
    merged = merge_sources(
        source_rows(semantic.filter(F.col("rk") <= SEMANTIC_K), "sem"),
        source_rows(bm25.filter(F.col("rk") <= BM25_K), "bm25"),
        trigram_rows(grams, fuzzy=fuzzy),
    )
    return merged if limit is None else prune(merged, limit)


def prune(cands: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """Per prefix the candidates with the highest single score, unscaled."""
    top = cands.withColumn("_top", F.greatest(*SOURCES))
    return top_k(top, ["prefix"], best("_top"), limit, "_rk").drop("_top", "_rk")


def with_engagement(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Engagement counts by query, 0 where unknown; ``features`` has one row per query."""
    out = rows.join(features.select("query", *ENGAGEMENT), "query", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ENGAGEMENT})


def rerank(cands: DataFrame, features: DataFrame, profile: str = "a", k: int = FINAL_K) -> DataFrame:
    """(prefix, query, score, rk): weighted sum of match, similarity, source and popularity terms."""
    weights = PROFILES[profile]
    rows = (
        with_engagement(cands, features)
        .withColumn("_p", normalize_strict("prefix"))
        .withColumn("_q", normalize_strict("query"))
        .withColumn("_ratio", ratio("_p", "_q"))
        .withColumn("_partial", partial_ratio("_p", "_q"))
    )
    p, q = F.col("_p"), F.col("_q")
    raw_len, q_len = F.length("prefix"), F.length(q)
    longest = F.greatest(raw_len, q_len)

    def flag(c: Column) -> Column:
        return c.cast("double")

    terms = {
        "exact": flag(p == q),
        "starts": flag(q.startswith(p)),
        "sem": F.col("sem"),
        "partial": F.col("_partial"),
        "bm25": F.when(F.col("bm25") > 0, F.col("bm25") / 10).otherwise(F.lit(0.0)),
        "orders": F.log1p("orders") / 10,
        "ratio": F.col("_ratio"),
        "ngram": F.col("ngram"),
        "volume": F.log1p("volume") / 15,
        "clicks": F.log1p("catalog_clicks") / 12,
        "contains": flag(q.contains(p)),
        "views": F.log1p("catalog_views") / 12,
        "len_ratio": F.when(longest > 0, F.least(raw_len, q_len) / longest).otherwise(F.lit(0.0)),
        "fuzzy": F.col("fuzzy"),
        "len_diff": F.abs(q_len - raw_len).cast("double"),
    }
    total = reduce(Column.__add__, [terms[t] * F.lit(w) for t, w in weights.items() if w])
    scored = rows.select("prefix", "query", rounded(total).alias("score"))
    return top_k(scored, ["prefix"], best(), k)
