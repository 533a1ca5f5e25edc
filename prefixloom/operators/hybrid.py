"""Dense + sparse + popularity retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import l2_normalize, popularity_max_norm, rounded
from ..functions.text import block_key, murmur3, stable_hash, tokenize_words
from ..session import cut_lineage
from ..sources.tables import distinct_queries, feature_map
from .candidates import with_engagement
from .lexical import Keep, lazy
from .ranking import best, top_k
from .vectors import CentredPca, block_topk, vector_topk

K1, B = 1.6, 0.75
N_BUCKETS = 2**14
LEAST_WEIGHT = 0.01  # fixed value: document weights under it may be left out

Hash = Callable[[Column], Column]


def feature_hash(word: Column) -> Column:
    """The absolute value of signed Murmur3, from which feature hashers take buckets."""
    return F.abs(murmur3(word))


def term_set(c: str, n_buckets: int | None, hashed: Hash = stable_hash) -> Column:
    """Distinct words, or distinct hash buckets of words (by ``hashed``, a whole number), as strings."""
    words = F.array_distinct(tokenize_words(c))
    if n_buckets is None:
        return words
    return F.array_distinct(
        F.transform(words, lambda w: F.pmod(hashed(w), F.lit(n_buckets)).cast("string"))
    )


def sparse_pool(
    pool: DataFrame, n_buckets: int | None = N_BUCKETS, k1: float = K1, b: float = B, hashed: Hash = stable_hash, least_weight: float = 0.0
) -> DataFrame:
    """(query, terms, term_weight): binary term frequency, so one weight per query; 0 where it is under ``least_weight``."""
    # written, as Spark would move a filter on the terms below a DISTINCT of the pool, to all rows it came from
    docs = cut_lineage(pool.select("query", term_set("query", n_buckets, hashed).alias("terms")))
    avgdl = docs.agg(F.avg(F.size("terms"))).scalar()
    w = 1.0 / (k1 * (1.0 - b + b * F.size("terms") / avgdl) + 1.0)
    if least_weight:
        w = F.when(w >= least_weight, w).otherwise(0.0)
    return docs.withColumn("term_weight", w)


def term_df(pool: DataFrame, n_buckets: int | None = N_BUCKETS, hashed: Hash = stable_hash) -> DataFrame:
    """(term, df) over the pool."""
    terms = pool.select(F.explode(term_set("query", n_buckets, hashed)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def sparse_prefixes(
    prefixes: DataFrame, pool: DataFrame, df: DataFrame, n_buckets: int | None = N_BUCKETS, hashed: Hash = stable_hash
) -> DataFrame:
    """(prefix, terms, term_weights): idf shares of the distinct terms, summing to 1; df from term_df."""
    n = pool.agg(F.count("*")).scalar()
    p = prefixes.select("prefix").distinct()
    terms = p.select("prefix", F.explode(term_set("prefix", n_buckets, hashed)).alias("term"))
    idf = F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 0.5))
    rows = terms.join(df, "term", "left").withColumn("idf", idf)
    lists = rows.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + x["idf"])
    none = F.array().cast("array<struct<term:string,idf:double>>")
    return p.join(lists, "prefix", "left").withColumn("t", F.coalesce("t", none)).select(
        "prefix",
        F.transform("t", lambda x: x["term"]).alias("terms"),
        F.transform("t", lambda x: x["idf"] / total).alias("term_weights"),
    )


def hashed_bm25(
    pool: DataFrame, n_buckets: int | None = N_BUCKETS, hashed: Hash = stable_hash, least_weight: float = 0.0
) -> DataFrame:
    """Document vectors in long form (query, term, weight), without weights under ``least_weight``."""
    every = sparse_pool(pool, n_buckets, hashed=hashed, least_weight=least_weight).filter("term_weight > 0")
    rows = every.select("query", F.explode("terms").alias("term"), "term_weight")
    return rows.select("query", "term", rounded(F.col("term_weight")).alias("weight"))


class HybridIndex:
    """Pool rows with vector, sparse terms and popularity bias.

    With ``pca`` the vectors of pool and prefixes are centred and projected first. An index that is read again takes
    the same ``hashed`` and ``pca``.
    """

    def __init__(
        self, pool: DataFrame, features: DataFrame, vecs: DataFrame,
        n_buckets: int | None = N_BUCKETS, popularity_weight: float = 0.15, keep: Keep = lazy,
        hashed: Hash = stable_hash, least_weight: float = 0.0, pca: CentredPca | None = None,
    ):
        pool, features = distinct_queries(pool), feature_map(features)
        self.pool, self.n_buckets, self.hashed, self.pca = pool, n_buckets, hashed, pca
        counts = with_engagement(pool, features)
        bias = (popularity_max_norm(counts) * popularity_weight).alias("bias")
        if pca:
            vecs = keep(pca.transform(vecs.select("query", "vec")), "projected")
        self.vecs = vecs.select(F.col("query").alias("pid"), "vec")
        extras = sparse_pool(pool, n_buckets, hashed=hashed, least_weight=least_weight).join(counts.select("query", bias), "query")
        self.extras = keep(extras, "extras").withColumnRenamed("query", "pid")
        self.term_df = keep(term_df(pool, n_buckets, hashed), "term_df")

    @classmethod
    def read(
        cls, folder: str, pool: DataFrame, vecs: DataFrame, n_buckets: int | None = N_BUCKETS,
        hashed: Hash = stable_hash, pca: CentredPca | None = None,
    ) -> HybridIndex:
        """The index a ``store`` of that folder holds, beside its pool and vectors (not used with ``pca``)."""
        read = pool.sparkSession.read.parquet
        index = cls.__new__(cls)
        index.pool, index.n_buckets, index.hashed, index.pca = pool, n_buckets, hashed, pca
        vecs = read(f"{folder}/projected") if pca else vecs
        index.vecs = vecs.select(F.col("query").alias("pid"), "vec")
        index.extras = read(f"{folder}/extras").withColumnRenamed("query", "pid")
        index.term_df = read(f"{folder}/term_df")
        return index

    def prefix_side(self, prefixes: DataFrame, prefix_vecs: DataFrame, alpha: float) -> DataFrame:
        """(qid, vec, terms, term_weights) with both parts at unit length and weighted by alpha."""
        sparse = sparse_prefixes(prefixes, self.pool, self.term_df, self.n_buckets, self.hashed)
        if self.pca:
            prefix_vecs = self.pca.transform(prefix_vecs.select("prefix", "vec"))
        joined = sparse.join(prefix_vecs, "prefix")
        return joined.select(
            F.col("prefix").alias("qid"),
            l2_normalize("vec", alpha).alias("vec"),
            "terms",
            l2_normalize("term_weights", 1 - alpha).alias("term_weights"),
        )


def hybrid_full(
    prefixes: DataFrame, prefix_vecs: DataFrame, index: HybridIndex, k: int = 100, alpha: float = 0.6
) -> DataFrame:
    """(prefix, query, score, rk): the 2k nearest by vector, rescored with terms and popularity."""
    q = index.prefix_side(prefixes, prefix_vecs, alpha)
    dense = vector_topk(q.select("qid", "vec"), index.vecs, 2 * k)
    rows = dense.select("qid", "pid", F.col("score").alias("dense")).join(
        q.drop("vec"), "qid"
    ).join(index.extras.withColumnRenamed("terms", "doc_terms"), "pid")
    weights = F.zip_with(
        "terms", "term_weights",
        lambda t, w: F.when(F.array_contains(F.col("doc_terms"), t), w).otherwise(F.lit(0.0)),
    )
    sparse = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x) * F.col("term_weight")
    scored = rows.select(
        F.col("qid").alias("prefix"), F.col("pid").alias("query"),
        rounded(F.col("dense") + sparse + F.col("bias")).alias("score"),
    )
    return top_k(scored, ["prefix"], best(), k)


def hybrid_blocked(
    prefixes: DataFrame, prefix_vecs: DataFrame, index: HybridIndex, k: int = 100, alpha: float = 0.6
) -> DataFrame:
    """(prefix, query, score, rk): scores every query of the prefix's three-letter block.

    Prefixes under three characters, or whose block is empty, take the full path.
    """
    p = prefixes.select("prefix").distinct()
    blocks = index.pool.select(block_key("query").alias("cell")).distinct()
    keyed = p.filter(F.length("prefix") >= 3).withColumn("cell", block_key("prefix"))
    inside = keyed.join(blocks, "cell", "left_semi")
    q = index.prefix_side(inside, prefix_vecs, alpha).withColumn("cell", block_key("qid"))
    pool = index.vecs.join(index.extras, "pid").withColumn("cell", block_key("pid"))
    found = block_topk(q, pool, k).withColumnsRenamed({"qid": "prefix", "pid": "query"})
    outside = p.join(inside.select("prefix"), "prefix", "left_anti")
    return found.unionByName(hybrid_full(outside, prefix_vecs, index, k, alpha))

