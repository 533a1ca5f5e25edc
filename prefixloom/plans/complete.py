"""Batch completion of a prefix table from end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import popularity_4321
from ..operators.candidates import BM25_K, FINAL_K, FUZZY_K, SEMANTIC_K, candidates, rerank, with_engagement
from ..operators.lexical import (
    Bm25Index, Keep, TrigramIndex, bm25_index, bm25_topk, distinct_prefixes, lazy, popular_queries,
    short_heads, short_prefix, trigram_index, trigram_topk,
)
from ..operators.vectors import Cells, embed, hashed_trigram_encoder, semantic_topk
from ..session import cut_lineage
from ..sources.tables import clean_features, distinct_queries, exists, feature_map, kept

POPULAR_N = 1000  # fixed value: length of the popular list (a report; completions look at the whole pool)


@dataclass
class Engine:
    """The tables a batch of prefixes is completed against."""

    pool: DataFrame
    features: DataFrame
    trigrams: TrigramIndex
    bm25: Bm25Index
    vectors: DataFrame
    popular: DataFrame
    short: DataFrame
    make_encoder: Callable = hashed_trigram_encoder
    cells: Cells | None = None  # set for approximate vector search over a large pool

    @classmethod
    def build(
        cls, pool: DataFrame, features: DataFrame, make_encoder: Callable = hashed_trigram_encoder, keep: Keep = lazy,
        order: str | None = None, n_cells: int | None = None,
    ) -> Engine:
        """All tables, each held by ``keep``: written once (``store``) for reuse over batches, or lazy.

        The inputs may be unclean: the pool becomes a set without nulls, features get one row per
        query (the last by ``order``, else the maxima) and no missing counts. With n_cells the vectors
        are kept by cell and searched approximately (0: the square root of the pool's size).
        """
        guard = getattr(keep, "guard", None)
        if guard:
            # read twice from here on: by the guard and for the tables
            pool, features = cut_lineage(pool.select("query")), cut_lineage(features)
            guard("pool", pool.select("query"))
            guard("features", features)
        pool = keep(distinct_queries(pool).filter(F.col("query").isNotNull()), "pool")
        features = keep(feature_map(features if order else clean_features(features), order=order), "features")
        counts = with_engagement(pool, features)
        vectors, cells = keep(embed(pool, "query", make_encoder), "vectors"), None
        if n_cells is not None:
            cells = Cells.fit(vectors, n_cells or None)
            keep(cells.table(pool.sparkSession), "centres")
            vectors = keep(cells.assigned(vectors), "vectors_by_cell")
        return cls(
            pool, features, trigram_index(pool, keep=keep), bm25_index(pool, keep=keep),
            vectors,
            keep(popular_queries(counts, popularity_4321(), POPULAR_N), "popular"),
            keep(short_heads(counts, popularity_4321(), FINAL_K), "short"),
            make_encoder, cells,
        )

    @classmethod
    def read(cls, spark: SparkSession, folder: str, make_encoder: Callable = hashed_trigram_encoder) -> Engine:
        """The tables a ``store`` of that folder holds."""

        def table(name: str) -> DataFrame:
            return kept(spark, f"{folder}/{name}")

        by_cell = exists(spark, f"{folder}/vectors_by_cell")
        return cls(
            table("pool"), table("features"),
            TrigramIndex.read(spark, folder, "trigram"), Bm25Index.read(spark, folder, "bm25"),
            table("vectors_by_cell" if by_cell else "vectors"), table("popular"), table("short"), make_encoder,
            Cells.read(table("centres")) if by_cell else None,
        )

    def prefix_vectors(self, prefixes: DataFrame) -> DataFrame:
        return embed(distinct_prefixes(prefixes), "prefix", self.make_encoder)

    def semantic(self, prefixes: DataFrame, k: int = SEMANTIC_K, metric: str = "cosine") -> DataFrame:
        return semantic_topk(self.prefix_vectors(prefixes), self.vectors, k, metric, self.cells)

    def candidates(self, prefixes: DataFrame, fuzzy: bool = True, pruned: bool = True) -> DataFrame:
        # each source reads the prefixes, so they are made distinct once
        asked = cut_lineage(distinct_prefixes(prefixes))
        parts = (
            self.semantic(asked),
            bm25_topk(asked, self.bm25, BM25_K),
            trigram_topk(asked, self.trigrams, 3 * FUZZY_K if fuzzy else FUZZY_K),
        )
        return candidates(*parts, fuzzy=fuzzy) if pruned else candidates(*parts, fuzzy=fuzzy, limit=None)

    def reranked(self, prefixes: DataFrame, profile: str = "a", k: int = FINAL_K) -> DataFrame:
        return rerank(self.candidates(prefixes), self.features, profile, k)

    def complete(self, prefixes: DataFrame, k: int = FINAL_K, profile: str = "a") -> DataFrame:
        """(prefix, query, score, rk): popular queries for short prefixes, re-ranked candidates for the rest.

        The kept list for short prefixes holds FINAL_K queries; for a larger k it is made from the whole pool. The other prefixes have at
        most MAX_CANDIDATES candidates.
        """
        asked, heads = distinct_prefixes(prefixes), self.short
        if k > FINAL_K:
            heads = short_heads(with_engagement(self.pool, self.features), popularity_4321(), k)
        short = short_prefix(asked, heads).filter(F.col("rk") <= k)
        rest = asked.join(short.select("prefix"), "prefix", "left_anti")
        return short.unionByName(self.reranked(rest, profile, k))
