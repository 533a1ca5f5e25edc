"""Lexical retrieval: trigram overlap, BM25, fuzzy, leading text.

The trigram and BM25 top-k are exact, but do not join every prefix with every
posting of its common terms. Both run in two steps:

1. A few postings of each term are kept in a table of their own. Scoring those of
   a prefix's terms gives a lower bound for its k-th best score; with fewer than
   k of them there is no bound and nothing is skipped.
2. A posting is joined only if an upper bound of any score first reached
   through it is not below that bound. Terms are tried in a fixed order per
   prefix and a query counts at the first term it shares, so no pair comes twice
   (prefix/positional filters of set-similarity joins, and MaxScore).

Postings are keyed by term and the numbers that decide the bound (set size, or
frequency and length); a term shared by a third of the pool is thereby cut into
classes, of which only the useful ones are read, and classes over CELL_ROWS rows
are cut further by a hash of the query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import jaccard, rounded
from ..functions.similarity import ratio
from ..functions.text import char_trigrams, gram_codes, leading_edges, normalize_strict, tokenize
from ..schemas import require
from ..session import broadcast_up_to
from ..sources.tables import kept
from .ranking import best, popular, top_k

CELL_ROWS = 1_000_000
EDGE_LEN = 15
EDGE_CAP = 500


def distinct_prefixes(prefixes: DataFrame) -> DataFrame:
    return require(prefixes, "prefix").select("prefix").distinct()


# How a table of an index is held: as the lazy DataFrame it is, or written first. A table that batches join by
# the columns ``by`` may be laid out by them, sorted by ``sort``; ``rows`` is their number where it is known.
Keep = Callable[..., DataFrame]


def lazy(df: DataFrame, name: str, by: list[str] | None = None, rows: int | None = None, sort: list[str] | None = None) -> DataFrame:
    return df


@dataclass
class Index:
    """Tables that make up an index, read back from the folder they were kept in."""

    @classmethod
    def read(cls, spark: SparkSession, folder: str, prefix: str):
        return cls(**{f.name: kept(spark, f"{folder}/{prefix}_{f.name}") for f in fields(cls)})


def _split_cells(postings: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Number the postings of oversized cells into salts; all others get salt 0.

    Cells of more than CELL_ROWS rows are broadcast up to 100,000 of them.
    """
    hot = cells.filter(F.col("salts") > 1).select(*keys, "salts")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("query"), F.col("salts")))
    return postings.join(broadcast_up_to(hot), keys, "left").withColumn("salt", salt.cast("int")).drop("salts")


def _cells(postings: DataFrame, keys: list[str]) -> DataFrame:
    salts = F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int")
    return postings.groupBy(*keys).agg(F.count("*").alias("cnt"), salts.alias("salts"))


def _total(cells: DataFrame, keep: Keep) -> int | None:
    """The number of postings, where the table is written."""
    return None if keep is lazy else cells.agg(F.sum("cnt")).first()[0] or 0


def _reaches(score: Column, query: Column) -> Column:
    """At least as good as the k-th row known so far; true if there is none."""
    floor = F.col("floor")
    return floor.isNull() | (score > -floor["neg"]) | ((score == -floor["neg"]) & (query <= floor["query"]))


def _can_reach(bound: Column) -> Column:
    return F.col("floor").isNull() | (bound >= -F.col("floor")["neg"])


def _kth_head(candidates: Column, score, k: int) -> Column:
    """The k-th best of an array of structs with a query, as (neg, query); null if there are fewer."""
    pairs = F.transform(candidates, lambda c: F.struct((-score(c)).alias("neg"), c["query"].alias("query")))
    # sort_array compares structs natively; array_sort would run a lambda per comparison
    return F.try_element_at(F.sort_array(pairs), F.lit(k))


# ---------------------------------------------------------------- trigrams


@dataclass
class TrigramIndex(Index):
    postings: DataFrame
    cells: DataFrame
    heads: DataFrame
    grams: DataFrame


def trigram_index(pool: DataFrame, head_rows: int = 10, keep: Keep = lazy) -> TrigramIndex:
    """postings(gram, n_grams, query, grams, salt), cells(gram, n_grams, cnt, salts), heads, grams(gram, df).

    Grams are integer codes. heads holds head_rows postings of every cell.
    """
    codes = gram_codes(char_trigrams(normalize_strict("query")))
    docs = keep(pool.select("query", codes.alias("grams")), "trigram_docs")
    flat = docs.select(F.explode("grams").alias("gram"), F.size("grams").alias("n_grams"), "query", "grams")
    keys = ["gram", "n_grams"]
    cells = keep(_cells(flat, keys), "trigram_cells")
    heads = top_k(flat, keys, [F.asc("query")], head_rows, "hk").drop("hk")
    return TrigramIndex(
        keep(_split_cells(flat, cells, keys), "trigram_postings", by=[*keys, "salt"], rows=_total(cells, keep)), cells, keep(heads, "trigram_heads"),
        keep(cells.groupBy("gram").agg(F.sum("cnt").alias("df")), "trigram_grams"),
    )


def trigram_topk(prefixes: DataFrame, index: TrigramIndex, k: int = 10, rare: int = 4) -> DataFrame:
    """(prefix, query, score, rk): trigram Jaccard over pairs sharing at least one gram.

    The first bound comes from the heads of the ``rare`` rarest matching grams,
    closest sizes first, until k rows per gram are seen.
    """
    p = distinct_prefixes(prefixes)
    p = p.withColumn("pg", gram_codes(char_trigrams(normalize_strict("prefix"))))
    # per prefix: grams rarest first; those in no query come first and match nothing
    ordered = (
        p.select("prefix", F.explode("pg").alias("gram"))
        .join(index.grams, "gram", "left")
        .groupBy("prefix")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
        .select(
            "prefix",
            F.transform("g", lambda s: s["gram"]).alias("pg"),
            F.size(F.filter("g", lambda s: s["df"] == 0)).alias("unseen"),
        )
    )
    # first shared gram at pos: the pos rarer grams are not shared
    n_p = F.size("pg")
    most = F.least(n_p - F.col("pos"), F.col("n_grams"))
    probes = (
        ordered.select("prefix", "pg", "unseen", F.posexplode("pg").alias("pos", "gram"))
        .join(index.cells, "gram")
        .withColumn("bound", rounded(most / (n_p + F.col("n_grams") - most)))
    )

    head_rows = F.least("cnt", F.lit(10))
    seen = Window.partitionBy("prefix", "pos").orderBy(F.desc("bound"), F.asc("n_grams"))
    first = (
        probes.filter(F.col("pos") < F.col("unseen") + rare)
        .withColumn("before", F.sum(head_rows).over(seen.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.coalesce("before", F.lit(0)) < k)
        .select("prefix", "pg", "gram", "n_grams")
    )
    heads = (
        first.join(index.heads, ["gram", "n_grams"])
        .groupBy("prefix")
        .agg(F.first("pg").alias("pg"), F.collect_set(F.struct("query", "grams")).alias("found"))
    )
    pg = F.col("pg")
    floors = heads.select(
        "prefix", _kth_head(F.col("found"), lambda c: rounded(jaccard(pg, c["grams"])), k).alias("floor")
    )
    open_cells = (
        probes.join(floors, "prefix")
        .filter(_can_reach(F.col("bound")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("prefix", "floor", "pg", "pos", "gram", "n_grams", "salt", "bound")
    )
    shared = F.size(F.array_intersect("pg", "grams"))
    scored = (
        open_cells.join(index.postings, ["gram", "n_grams", "salt"])
        .filter(_reaches(F.col("bound"), F.col("query")))
        .filter(~F.arrays_overlap(F.slice("pg", F.lit(1), F.col("pos")), F.col("grams")))
        .withColumn("shared", shared)
        .withColumn("score", rounded(F.col("shared") / (n_p + F.col("n_grams") - F.col("shared"))))
        .filter(_reaches(F.col("score"), F.col("query")))
        .select("prefix", "query", "score")
    )
    return top_k(scored, ["prefix"], best(), k)


def fuzzy_from_trigrams(grams: DataFrame, k: int = 10, threshold: float = 0.7, min_len: int = 3) -> DataFrame:
    """LCS ratio on the best 3k trigram matches of prefixes of at least min_len raw characters."""
    near = grams.filter((F.col("rk") <= 3 * k) & (F.length("prefix") >= min_len))
    scored = (
        near.select("prefix", "query")
        .withColumn("raw", ratio(normalize_strict("prefix"), normalize_strict("query")))
        .filter(F.col("raw") >= threshold)
        .select("prefix", "query", rounded(F.col("raw")).alias("score"))
    )
    return top_k(scored, ["prefix"], best(), k)


def fuzzy_topk(prefixes: DataFrame, index: TrigramIndex, k: int = 10, threshold: float = 0.7, min_len: int = 3) -> DataFrame:
    return fuzzy_from_trigrams(trigram_topk(prefixes, index, 3 * k), k, threshold, min_len)


# -------------------------------------------------------------------- BM25


@dataclass
class Bm25Index(Index):
    postings: DataFrame
    cells: DataFrame
    heads: DataFrame
    tokens: DataFrame


def _impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _count_in(tokens: Column, token: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def bm25_index(
    pool: DataFrame, k1: float = 1.2, b: float = 0.75, eps: float = 0.25, head_rows: int = 128, keep: Keep = lazy
) -> Bm25Index:
    """Okapi statistics and postings.

    A token in more than half of the pool has a negative idf; it gets eps times
    the mean idf of the vocabulary instead.
    """
    docs = keep(pool.select("query", tokenize(normalize_strict("query")).alias("ts")), "bm25_docs")
    corpus = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("ts")).alias("avgdl"))
    n_docs = corpus.select("n_docs").scalar()
    avgdl = corpus.select("avgdl").scalar()
    flat = docs.select("query", "ts", F.explode(F.array_distinct("ts")).alias("token")).select(
        "token", _count_in(F.col("ts"), F.col("token")).alias("tf"), F.size("ts").alias("dl"), "query", "ts"
    )
    keys = ["token", "tf", "dl"]
    cells = _cells(flat, keys).withColumn("impact", _impact(F.col("tf"), F.col("dl"), avgdl, k1, b))
    cells = keep(cells, "bm25_cells")
    by_token = cells.groupBy("token").agg(
        F.sum("cnt").alias("df"), F.max("impact").alias("hi"), F.min("impact").alias("lo")
    )
    raw = by_token.withColumn("raw_idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf")).scalar()
    idf = F.when(F.col("raw_idf") < 0, eps * mean).otherwise(F.col("raw_idf"))
    tokens = raw.withColumn("idf", idf).select(
        "token", "df", "raw_idf", "idf",
        (F.col("idf") * F.when(F.col("idf") < 0, F.col("lo")).otherwise(F.col("hi"))).alias("top"),
        avgdl.alias("avgdl"), F.lit(k1).alias("k1"), F.lit(b).alias("b"),
    )
    # more occurrences in a shorter query always weigh more
    heads = top_k(
        flat.withColumn("w", _impact(F.col("tf"), F.col("dl"), avgdl, k1, b)),
        ["token"], [F.desc("w"), F.asc("query")], head_rows, "hk",
    )
    return Bm25Index(
        keep(_split_cells(flat, cells, keys), "bm25_postings", by=[*keys, "salt"], rows=_total(cells, keep)), cells,
        keep(heads.select("token", "query", "ts"), "bm25_heads"), keep(tokens, "bm25_tokens"),
    )


def bm25_stats(index: Bm25Index) -> DataFrame:
    """Per token: number of queries, raw idf, idf after the floor."""
    return index.tokens.select(
        "token", "df", rounded(F.col("raw_idf")).alias("raw_idf"), rounded(F.col("idf")).alias("idf")
    )


def bm25_topk(prefixes: DataFrame, index: Bm25Index, k: int = 20, strong: int = 2) -> DataFrame:
    """(prefix, query, score, rk): BM25 over queries sharing at least one token.

    A token repeated in the prefix counts each time. The first bound comes from
    the heads of its ``strong`` strongest tokens, and of more until those are in
    k queries.
    """
    p = distinct_prefixes(prefixes).withColumn("ts", tokenize(normalize_strict("prefix")))
    terms = p.select("prefix", "ts", F.explode(F.array_distinct("ts")).alias("token")).select(
        "prefix", "token", _count_in(F.col("ts"), F.col("token")).alias("qtf")
    )
    # per prefix: its terms, the strongest possible contribution first
    t = index.tokens
    weighted = terms.join(t, "token").select(
        "prefix", "token", "df", "avgdl", "k1", "b",
        (F.col("qtf") * F.col("idf")).alias("w"),
        F.greatest(F.lit(0.0), F.col("qtf") * F.col("top")).alias("most"),
    )
    plan = weighted.groupBy("prefix").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("most")).alias("neg"), "token", "w", "df", "avgdl", "k1", "b"))
        ).alias("plan")
    )

    def score(ts: Column) -> Column:
        dl = F.size(ts)

        def part(s: Column) -> Column:
            tf = _count_in(ts, s["token"])
            norm = s["k1"] * (1 - s["b"] + s["b"] * dl / s["avgdl"])
            return F.when(tf > 0, s["w"] * tf * (s["k1"] + 1) / (tf + norm)).otherwise(F.lit(0.0))

        return rounded(F.aggregate("plan", F.lit(0.0), lambda acc, s: acc + part(s)))

    at = F.col("pos")
    rows_before = F.aggregate(
        F.slice("plan", F.lit(1), at), F.lit(0).cast("bigint"), lambda acc, s: acc + s["df"]
    )
    found = (
        plan.select("prefix", "plan", F.posexplode("plan").alias("pos", "s"))
        .filter((at < strong) | (rows_before < k))
        .select("prefix", F.col("s.token").alias("token"))
        .join(index.heads, "token")
        .groupBy("prefix")
        .agg(F.collect_set(F.struct("query", "ts")).alias("found"))
    )
    floors = plan.join(found, "prefix").select(
        "prefix", "plan", _kth_head(F.col("found"), lambda c: score(c["ts"]), k).alias("floor")
    )
    rest = F.aggregate(
        F.slice("plan", at + 2, F.size("plan")), F.lit(0.0), lambda acc, s: acc - s["neg"]
    )
    probes = (
        floors.select("prefix", "plan", "floor", F.posexplode("plan").alias("pos", "s"))
        .select("prefix", "plan", "floor", "pos", F.col("s.token").alias("token"), F.col("s.w").alias("w"), rest.alias("rest"))
        .join(index.cells.select("token", "tf", "dl", "impact", "salts"), "token")
        .withColumn("bound", rounded(F.col("w") * F.col("impact") + F.col("rest") + 1e-9))
        .filter(_can_reach(F.col("bound")))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("prefix", "plan", "floor", "pos", "token", "tf", "dl", "salt", "bound")
    )
    earlier = F.transform(F.slice("plan", F.lit(1), at), lambda s: s["token"])
    scored = (
        probes.join(index.postings, ["token", "tf", "dl", "salt"])
        .filter(_reaches(F.col("bound"), F.col("query")))
        .filter(~F.arrays_overlap(earlier, F.col("ts")))
        .withColumn("score", score(F.col("ts")))
        .filter(_reaches(F.col("score"), F.col("query")))
        .select("prefix", "query", "score")
    )
    return top_k(scored, ["prefix"], best(), k)


# ------------------------------------------------------------ leading text


def edge_index(pool: DataFrame, score: str, max_len: int = EDGE_LEN, cap: int = EDGE_CAP) -> DataFrame:
    """edges(edge, query, <score>, ek): per leading text of up to max_len characters the first ``cap`` queries by score.

    For uses that need no more than ``cap`` of them; a Dictionary gives all.
    """
    flat = pool.select(F.explode(leading_edges("query", max_len)).alias("edge"), *pool.columns)
    return top_k(flat, ["edge"], best(score), cap, "ek")


def popular_queries(pool_features: DataFrame, score: Column, n: int = 1000) -> DataFrame:
    """(query, popularity): the n most popular queries."""
    return popular(pool_features.select("query", score.alias("popularity")), "popularity", n)


def short_heads(pool_features: DataFrame, score: Column, k: int = 10, max_len: int = 2) -> DataFrame:
    """(edge, query, popularity, rk): the k most popular queries of the whole pool per leading text of 0 to max_len characters."""
    rows = pool_features.select("query", score.alias("popularity"))
    # normalising never makes a text longer
    edges = F.array_append(leading_edges(normalize_strict("query"), max_len), F.lit(""))
    return top_k(rows.select(F.explode(edges).alias("edge"), "query", "popularity"), ["edge"], best("popularity"), k)


def short_prefix(prefixes: DataFrame, heads: DataFrame, max_len: int = 2) -> DataFrame:
    """(prefix, query, score, rk): popular queries beginning with a prefix of at most max_len raw characters.

    ``heads`` comes from short_heads.
    """
    p = distinct_prefixes(prefixes).filter(F.length("prefix") <= max_len)
    return (
        p.withColumn("edge", normalize_strict("prefix"))
        .join(heads, "edge")
        .select("prefix", "query", F.col("popularity").cast("double").alias("score"), "rk")
    )
