"""Logged (prefix, query) pairs: frequencies, lists, coverage, prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_loose
from .dictionary import Dictionary
from .ranking import top_k

LIST_PAGE = 10_000


def cleaned_pairs(train: DataFrame) -> DataFrame:
    return train.select(normalize_loose("prefix").alias("prefix"), normalize_loose("query").alias("query"))


def prefix_query_freq(train: DataFrame) -> DataFrame:
    """(prefix, query, freq) on loosely normalised text."""
    return cleaned_pairs(train).groupBy("prefix", "query").agg(F.count("*").alias("freq"))


def queries_per_prefix(train: DataFrame) -> DataFrame:
    return train.groupBy("prefix").agg(F.count("*").alias("n_queries"))


def avg_queries_per_prefix(train: DataFrame) -> DataFrame:
    sizes = cleaned_pairs(train).groupBy("prefix").agg(F.count("*").alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("avg_queries"))


def prefix_queries(train: DataFrame, page_rows: int = LIST_PAGE) -> DataFrame:
    """(prefix, page, queries, freqs): the logged queries of a prefix as lists.

    Repeats are counted before the shuffle. A prefix with n distinct queries has
    ceil(n / page_rows) pages, filled by hash, so no list grows with the log.
    """
    pairs = train.groupBy("prefix", "query").agg(F.count("*").alias("freq"))
    pages = pairs.groupBy("prefix").agg(F.ceil(F.count("*") / F.lit(page_rows)).alias("n_pages"))
    number = F.conv(F.substring(F.md5("query"), 1, 15), 16, 10).cast("bigint")
    keyed = pairs.join(pages, "prefix").withColumn("page", F.pmod(number, F.col("n_pages")).cast("bigint"))
    rows = keyed.groupBy("prefix", "page").agg(
        F.sort_array(F.collect_list(F.struct("query", "freq"))).alias("r")
    )
    return rows.select(
        "prefix", "page",
        F.transform("r", lambda s: s["query"]).alias("queries"),
        F.transform("r", lambda s: s["freq"]).alias("freqs"),
    )


def group_histogram(sizes: DataFrame, value: str = "n_queries", bins: int = 50) -> DataFrame:
    """(bin, bin_start, cnt): equal-width bins from minimum to maximum, the last one closed."""
    span = sizes.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    flat = span["lo"] == span["hi"]
    lo = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    width = F.when(flat, 1.0).otherwise(span["hi"] - span["lo"]) / bins
    at = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return (
        sizes.select(at.alias("bin"), F.round(lo + at * width, 6).alias("bin_start"))
        .groupBy("bin", "bin_start")
        .agg(F.count("*").alias("cnt"))
    )


def history_match(prefixes: DataFrame, freq: DataFrame) -> DataFrame:
    """Logged queries of each prefix: (prefix, query, freq)."""
    p = prefixes.select("prefix", normalize_loose("prefix").alias("key")).distinct()
    logged = freq.withColumnRenamed("prefix", "key")
    return p.join(logged, "key").select("prefix", "query", "freq")


def missing_prefixes(asked: DataFrame, answered: DataFrame) -> DataFrame:
    # a hot prefix is one row on either side
    return asked.select("prefix").distinct().join(answered.select("prefix").distinct(), "prefix", "left_anti")


def strategy_coverage(prefixes: DataFrame, freq: DataFrame, pool: DataFrame | Dictionary) -> DataFrame:
    """(strategy, covered, total, share): prefixes with logged queries, and with pool queries that begin with them."""
    p = prefixes.select("prefix", normalize_loose("prefix").alias("key"))
    total = p.agg(F.count("*")).scalar()

    def row(name: str, keys: DataFrame) -> DataFrame:
        hit = p.join(keys.distinct(), "key", "left_semi").agg(F.count("*").alias("covered"))
        return hit.select(
            F.lit(name).alias("strategy"), "covered", total.alias("total"),
            F.round(100.0 * F.col("covered") / total, 6).alias("share"),
        )

    logged = freq.select(F.col("prefix").alias("key"))
    held = pool if isinstance(pool, Dictionary) else Dictionary.build(pool.select("query"))
    return row("history", logged).unionByName(row("edge", held.begins(p.filter(F.length("key") > 0), "key", 1).select("key")))


def prefix_length_stats(prefixes: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of the prefix lengths.

    Lengths take few values, so percentile's per-value counts stay small.
    """
    n = prefixes.select(F.length(normalize_loose("prefix")).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return n.agg(
        F.count("n").alias("cnt"), F.round(F.avg("n"), 6).alias("mean"),
        F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("min_len"),
        q.alias("q"), F.max("n").alias("max_len"),
    ).select(
        "cnt", "mean", "std", "min_len",
        *[F.round(F.col("q")[i], 6).alias(f"p{s}") for i, s in enumerate((25, 50, 75))],
        "max_len",
    )


def prompt_corpus(train: DataFrame, max_queries: int = 10) -> DataFrame:
    """(prefix, text): 'Prefix: p / Completions: a, b' over the most frequent queries (ties by text)."""
    freq = train.groupBy("prefix", "query").agg(F.count("*").alias("freq"))
    top = top_k(freq, ["prefix"], [F.desc("freq"), F.asc("query")], max_queries)
    names = F.transform(F.sort_array(F.collect_list(F.struct("rk", "query"))), lambda s: s["query"])
    joined = top.groupBy("prefix").agg(F.array_join(names, ", ").alias("qs"))
    text = F.concat(F.lit("Prefix: "), "prefix", F.lit("\nCompletions: "), "qs")
    return joined.select("prefix", text.alias("text"))


def parse_completions(generated: DataFrame, text: str = "text") -> DataFrame:
    """Text after the last 'Completions:' of the rows that hold the marker."""
    marker = "Completions:"
    tail = F.substring_index(F.col(text), marker, -1)
    return generated.filter(F.col(text).contains(marker)).select(
        F.regexp_replace(tail, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("completion")
    )


def _key(c: str) -> Column:
    return F.regexp_replace(F.lower(F.col(c)), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def valid_in_pool(completions: DataFrame, pool: DataFrame) -> DataFrame:
    """(total, valid_in_pool, valid_pct) by lower-cased, stripped membership."""
    keys = pool.select(_key("query").alias("key")).distinct().withColumn("hit", F.lit(1))
    counted = completions.groupBy(_key("completion").alias("key")).agg(F.count("*").alias("n"))
    flagged = counted.join(keys, "key", "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    valid = F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0))
    return flagged.agg(total.alias("total"), valid.alias("valid_in_pool")).withColumn(
        "valid_pct",
        F.when(F.col("total") > 0, F.round(F.col("valid_in_pool") / F.col("total") * 100, 6)).otherwise(0.0),
    )
