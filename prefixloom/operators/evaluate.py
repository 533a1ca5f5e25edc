"""Quality measures of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rounded
from ..functions.text import normalize_strict


def hit_at_k(truth: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(total, hits, hit_rate): truth(prefix, query) rows found among the first k.

    Repeated truth rows are counted before the join, so a hot pair is one row.
    """
    asked = truth.groupBy("prefix", "query").agg(F.count("*").alias("n"))
    shown = ranked.filter(F.col("rk") <= k).select("prefix", "query", F.lit(1).alias("hit")).distinct()
    sums = asked.join(shown, ["prefix", "query"], "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hits"),
    )
    rate = F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 6)).otherwise(0.0)
    return sums.withColumn("hit_rate", rate)


def result_analysis(ranked: DataFrame) -> DataFrame:
    """Per prefix: results, mean length, results beginning with it, score mean and range."""
    starts = normalize_strict("query").startswith(normalize_strict("prefix"))
    return ranked.groupBy("prefix").agg(
        F.count("*").alias("n_results"),
        F.round(F.avg(F.length("query")), 6).alias("avg_length"),
        F.count_if(starts).alias("prefix_matches"),
        F.round(F.avg("score"), 5).alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def validate_submission(prefixes: DataFrame, lists: DataFrame, depth: int = 150) -> DataFrame:
    """One row: expected and given prefixes, missing ones, list lengths, all at full depth."""
    size = F.size("retrieved_queries")
    # DISTINCT on both sides, as the set difference of the prefixes is asked for
    missing = (
        prefixes.select("prefix").distinct().join(lists.select("prefix"), "prefix", "left_anti")
        .agg(F.count("*")).scalar()
    )
    expected = prefixes.agg(F.count("*")).scalar()
    return lists.agg(
        F.count("*").alias("n_predictions"),
        F.min(size).alias("min_len"), F.max(size).alias("max_len"),
        F.round(F.avg(size), 6).alias("mean_len"),
        F.coalesce(F.bool_and(size == depth), F.lit(True)).alias("all_full"),
    ).select(
        "n_predictions", expected.alias("n_expected"),
        (F.col("n_predictions") == expected).alias("count_matches"), missing.alias("n_missing"),
        "min_len", "max_len", "mean_len", "all_full",
    )


def ndcg(rows: DataFrame, score: Column | str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, ndcg): mean NDCG over groups of rows(group_id, query, label, score).

    Gain 2^label - 1, discount 1/log2(rank + 1); a group without positive labels
    counts 1. Groups hold one positive and its sampled negatives, so they are small.
    """
    score = F.col(score) if isinstance(score, str) else score
    by = Window.partitionBy("group_id")
    gain = F.pow(F.lit(2.0), F.col("label")) - 1.0
    ranked = (
        rows.withColumn("_rk", F.row_number().over(by.orderBy(score.desc(), F.asc("query"))))
        .withColumn("_ideal", F.row_number().over(by.orderBy(F.desc("label"), F.asc("query"))))
        .withColumn("_gain", gain)
    )

    def dcg(rank: str, k: int) -> Column:
        return F.sum(F.when(F.col(rank) <= k, F.col("_gain") / F.log2(F.col(rank) + 1.0)).otherwise(0.0))

    sums = ranked.groupBy("group_id").agg(
        *[dcg("_rk", k).alias(f"d{k}") for k in ks], *[dcg("_ideal", k).alias(f"i{k}") for k in ks]
    )
    means = sums.agg(
        *[F.avg(F.when(F.col(f"i{k}") > 0, F.col(f"d{k}") / F.col(f"i{k}")).otherwise(1.0)).alias(f"n{k}") for k in ks]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), rounded(F.col(f"n{k}")).alias("ndcg")) for k in ks]))
    return means.select(pairs.alias("r")).select("r.*")
