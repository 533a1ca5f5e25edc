"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

index_build is the time to write all index tables; the other queries run on them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prefixloom.plans.registered import REGISTRY, engine  # noqa: E402
from prefixloom.session import local  # noqa: E402
from prefixloom.sources.fixtures import Tables  # noqa: E402

HEADLINE = [
    "normalize_strict", "tokenize", "char_trigrams", "prefix_query_freq", "prefix_queries", "pool_features_clean",
    "bm25_topk", "trigram_topk", "fuzzy_topk", "fuzzy_partial", "prefix_match", "edge_prefix_match",
    "semantic_topk", "vector_topk", "vector_topk_blocks", "candidates", "rerank_profile_a", "complete",
    "hybrid_blocked", "cascade", "hit_at_10", "negative_sample", "training_set",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local(cpus)
    tables = Tables(spark, folder)
    tables.table("part").count()  # session start is not measured
    took: dict[str, float] = {}

    start = time.time()
    engine(tables)
    took["index_build"] = round(time.time() - start, 3)
    n_prefixes = tables.prefixes().count()
    n_pool = engine(tables).pool.count()
    for name in HEADLINE:
        start = time.time()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "prefixes": n_prefixes, "pool": n_pool,
        "complete_prefixes_per_sec": round(n_prefixes / took["complete"], 2),
    }))


if __name__ == "__main__":
    main()
