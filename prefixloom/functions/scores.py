"""Pair features, popularity scores and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity as sim
from .text import char_trigrams, col, normalize_strict, tokenize

DIGITS = 6


def rounded(c: Column) -> Column:
    """Scores are kept at six digits, so rankings do not depend on summation order."""
    return F.round(c, DIGITS)


def guarded(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return guarded(inter, F.size(a) + F.size(b) - inter)


def starts(text: Column, head: Column) -> Column:
    return text.startswith(head)


# Popularity in the four weightings in use (fixed values).

def popularity_log() -> Column:
    """0.4/0.3/0.2/0.1 on log1p of orders, volume, clicks, views."""
    return (
        0.4 * F.log1p("orders")
        + 0.3 * F.log1p("volume")
        + 0.2 * F.log1p("catalog_clicks")
        + 0.1 * F.log1p("catalog_views")
    )


def popularity_4321() -> Column:
    return F.col("orders") * 4 + F.col("volume") * 3 + F.col("catalog_clicks") * 2 + F.col("catalog_views")


def popularity_10521() -> Column:
    return F.col("orders") * 10 + F.col("volume") * 5 + F.col("catalog_clicks") * 2 + F.col("catalog_views")


def share_of_max(df: DataFrame, value: Column) -> Column:
    """value / max(value) over df, 0 when the maximum is not positive."""
    top = df.agg(F.max(value)).scalar()
    return F.coalesce(F.when(top > 0, value / top), F.lit(0.0))


def popularity_max_norm(df: DataFrame) -> Column:
    """0.4 orders, 0.3 clicks, 0.2 volume, 0.1 views, each as a share of its maximum."""
    weights = {"orders": 0.4, "catalog_clicks": 0.3, "volume": 0.2, "catalog_views": 0.1}
    tops = df.agg(F.struct(*[F.max(c).alias(c) for c in weights])).scalar()
    parts = [
        F.when(tops[c] > 0, F.col(c) / tops[c]).otherwise(F.lit(0.0)) * w for c, w in weights.items()
    ]
    return parts[0] + parts[1] + parts[2] + parts[3]


# Vectors

def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str, weight: float = 1.0) -> Column:
    """v / (|v| + 1e-10) * weight, in double precision."""
    v = col(v)
    norm = l2_norm(v) + F.lit(1e-10)
    return F.transform(v, lambda x: x.cast("double") / norm * F.lit(weight))


# Features of a (prefix, query) pair

# Names and order of the columns of a training file.
FEATURES = [
    "semantic_cosine", "bm25_score", "ngram_score", "fuzzy_score",
    "edit_distance_ratio", "partial_ratio", "token_sort_ratio",
    "exact_prefix_match", "prefix_in_query",
    "token_jaccard", "token_overlap_count", "token_containment",
    "trigram_jaccard", "trigram_overlap_count",
    "prefix_length", "query_length", "length_diff", "length_ratio",
    "prefix_token_count", "query_token_count", "token_count_diff", "prefix_position",
    "log_orders", "log_volume", "log_clicks", "log_views",
    "orders", "volume", "clicks", "views",
    "click_through_rate", "order_rate", "views_per_click", "popularity_score",
]


def prefix_position(p: Column, q: Column) -> Column:
    """Offset of the first occurrence as a share of the query length, else 1."""
    at = F.instr(q, p)
    found = (F.length(p) > 0) & (F.length(q) > 0) & (at > 0)
    return F.when(found, (at - 1) / F.length(q)).otherwise(F.lit(1.0))


def pair_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """All 34 ranking features, as doubles, next to the ``keep`` columns.

    Needs prefix, query, the four source scores (sem, bm25, ngram, fuzzy) and the
    four engagement counts.
    """
    text = (
        df.withColumn("_p", normalize_strict("prefix"))
        .withColumn("_q", normalize_strict("query"))
        .withColumn("_r", sim.ratio("_p", "_q"))
        .withColumn("_pr", sim.partial_ratio("_p", "_q"))
        .withColumn("_ts", sim.token_sort_ratio("_p", "_q"))
    )
    p, q = F.col("_p"), F.col("_q")
    pt, qt = tokenize(p), tokenize(q)
    pd_, qd = F.array_distinct(pt), F.array_distinct(qt)
    pg, qg = char_trigrams(p), char_trigrams(q)
    shared_t = F.size(F.array_intersect(pd_, qd))
    shared_g = F.size(F.array_intersect(pg, qg))
    lp, lq = F.length(p), F.length(q)
    o, v = F.col("orders"), F.col("volume")
    c, w = F.col("catalog_clicks"), F.col("catalog_views")
    values = [
        F.col("sem"), F.col("bm25"), F.col("ngram"), F.col("fuzzy"),
        F.col("_r"), F.col("_pr"), F.col("_ts"),
        starts(q, p), q.contains(p),
        jaccard(pd_, qd), shared_t, guarded(shared_t, F.size(pd_)),
        jaccard(pg, qg), shared_g,
        lp, lq, F.abs(lq - lp), guarded(lp, lq),
        F.size(pt), F.size(qt), F.abs(F.size(qt) - F.size(pt)), prefix_position(p, q),
        F.log1p(o), F.log1p(v), F.log1p(c), F.log1p(w),
        o, v, c, w,
        guarded(c, v), guarded(o, v), guarded(w, c), popularity_log(),
    ]
    return text.select(
        *keep, *[rounded(x.cast("double")).alias(n) for n, x in zip(FEATURES, values)]
    )
