"""One query per operator over the test tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, similarity, text
from ..operators import cascade as tiers
from ..operators import dictionary, encoder, evaluate, graph, history, hybrid, lambdarank, learn, lexical, lsh, ranking, vectors
from ..operators.candidates import SOURCES, prune, with_engagement
from ..schemas import ENGAGEMENT
from ..session import broadcast_up_to, cut_lineage, tune
from ..sources import sinks, tables
from ..sources.fixtures import Tables
from .complete import Engine

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(tune(spark), folder))

    REGISTRY[fn.__name__] = run
    return fn


_ENGINES: dict[tuple[str, str], Engine] = {}


def keep(t: Tables) -> Callable[[DataFrame, str], DataFrame]:
    """Tables derived from one data folder, written once per application."""
    name = hashlib.md5(t.folder.encode()).hexdigest()[:12]
    return tables.store(t.spark, f"{tables.shared_folder(t.spark)}/{name}")


def engine(t: Tables) -> Engine:
    """Indexes over the pool, built by the first query that needs them."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _ENGINES:
        _ENGINES[key] = Engine.build(t.pool(), _features(t), keep=keep(t))
    return _ENGINES[key]


def _features(t: Tables) -> DataFrame:
    """The engagement counts, written once."""
    return keep(t)(t.features(), "counted_features")


def dirty_keep(t: Tables) -> Callable[[DataFrame, str], DataFrame]:
    return tables.store(t.spark, f"{keep(t).folder}/dirty")


def pool_counts(t: Tables) -> DataFrame:
    return with_engagement(t.pool(), t.features())


def clean_pool(t: Tables) -> DataFrame:
    return keep(t)(tiers.clean_pool(t.pool(), t.features()), "clean_pool")


def _texts(t: Tables) -> dictionary.Dictionary:
    """The pool sorted by its strictly normalised text."""
    return dictionary.Dictionary.build(t.pool(), text.normalize_strict("query"), keep(t), "texts")


def _clean_texts(t: Tables) -> dictionary.Dictionary:
    return dictionary.Dictionary.build(clean_pool(t), "query", keep(t), "clean_texts")


# ------------------------------------------------------- sources and sinks


@query
def scan_tables(t):
    inputs = {"pool": t.pool(), "query_features": t.features(), "train": t.train(), "test_prefixes": t.prefixes()}
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in inputs.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query
def features_clean(t):
    gaps = t.features().withColumn("volume", F.when(F.col("volume") % 2 == 0, F.col("volume")))
    return tables.clean_features(gaps)


@query
def feature_map(t):
    rows = t.features().withColumn("query", text.block_key("query"))
    return tables.feature_map(rows)


@query
def dataset_summary(t):
    return tables.summary(
        {"pool": (t.pool(), "query"), "query_features": (t.features(), "query"),
         "train": (t.train(), "prefix"), "test_prefixes": (t.prefixes(), "prefix")}
    )


@query
def index_roundtrip(t):
    folder = f"{tables.shared_folder(t.spark)}/roundtrip-{uuid.uuid4().hex}"
    lexical.trigram_index(t.pool(), keep=tables.store(t.spark, folder))
    index = lexical.TrigramIndex.read(t.spark, folder, "trigram")
    return lexical.trigram_topk(t.prefixes(), index, 10)


@query
def index_roundtrip_all(t):
    """Every kind of index written, read back and used: (source, prefix, query, rk)."""
    folder = _folder(t, "indexes")
    write = tables.store(t.spark, folder)
    Engine.build(t.pool(), t.features(), keep=write)
    e = Engine.read(t.spark, folder)
    hybrid.HybridIndex(e.pool, e.features, e.vectors, None, keep=tables.store(t.spark, f"{folder}/hybrid"))
    mixed = hybrid.HybridIndex.read(f"{folder}/hybrid", e.pool, e.vectors, None)
    prefixes = t.prefixes()
    found = {
        "complete": e.complete(prefixes), "bm25": lexical.bm25_topk(prefixes, e.bm25, 20),
        "trigram": lexical.trigram_topk(prefixes, e.trigrams, 10),
        "hybrid": hybrid.hybrid_full(prefixes, e.prefix_vectors(prefixes), mixed),
    }
    parts = [df.select(F.lit(name).alias("source"), "prefix", "query", "rk") for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def submission_wide(t):
    ranked = dictionary.prefix_match(t.prefixes(), _texts(t), 10)
    return sinks.wide(t.prefixes(), ranked, 10)


@query
def submission_json(t):
    return sinks.json_lists(dictionary.prefix_match(t.prefixes(), _texts(t), 10))


@query
def submission_list(t):
    lists = sinks.lists(dictionary.prefix_match(t.prefixes(), _texts(t), 10))
    return lists.select("prefix", F.posexplode("retrieved_queries").alias("pos", "query"))


def _folder(t: Tables, name: str) -> str:
    return f"{tables.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query
def submission_files(t):
    """The three submission files, written and read back: (kind, prefix, pos, query)."""
    ranked = dictionary.prefix_match(t.prefixes(), _texts(t), 10)
    wide, json_csv, parquet = (_folder(t, name) for name in ("wide", "json", "lists"))
    sinks.write_csv(sinks.wide(t.prefixes(), ranked, 10), wide)
    sinks.write_csv(sinks.json_lists(ranked), json_csv)
    sinks.write_parquet(sinks.lists(ranked), parquet)
    read = t.spark.read.option("header", True).option("escape", '"')
    cells = F.filter(F.array(*[F.col(f"completion_{i}") for i in range(1, 11)]), lambda c: c.isNotNull())
    parts = {
        "wide": read.csv(wide).select("prefix", cells.alias("found")),
        "json": read.csv(json_csv).select("prefix", F.from_json("retrieved_queries", "array<string>").alias("found")),
        "parquet": tables.scan(t.spark, f"{parquet}/*.parquet").select("prefix", F.col("retrieved_queries").alias("found")),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "prefix", F.posexplode("found").alias("pos", "query")) for kind, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def training_sink(t):
    """Logged rows with their negatives, written and read back with a given schema."""
    folder = _folder(t, "training")
    cands = dictionary.prefix_match(t.train(), _texts(t), 20).select("prefix", "query", *[F.lit(0.0).alias(s) for s in SOURCES])
    rows = learn.groups(t.train(), cands)
    sinks.write_parquet(rows, folder)
    return tables.scan(t.spark, folder, rows.schema).groupBy("is_truth").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- text


def _documents(t: Tables, value) -> DataFrame:
    return t.table("documents").select("doc_id", value)


@query
def normalize_strict(t):
    return _documents(t, text.normalize_strict("text").alias("norm"))


@query
def normalize_loose(t):
    return _documents(t, text.normalize_loose("text").alias("norm"))


@query
def clean_query(t):
    return _documents(t, text.clean_query("text").alias("norm"))


def _token_report(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("token_hash")
    )


@query
def tokenize(t):
    return _token_report(_documents(t, text.tokenize(text.normalize_strict("text")).alias("tokens")))


@query
def tokenize_words(t):
    return _token_report(_documents(t, text.tokenize_words("text").alias("tokens")))


@query
def char_trigrams(t):
    grams = text.char_trigrams(text.normalize_strict("text"))
    return _token_report(_documents(t, F.sort_array(grams).alias("tokens")))


@query
def block_key(t):
    return t.pool().select("query", text.block_key("query").alias("block"))


@query
def product_clean(t):
    return tables.clean_products(t.products()).select("page_id", "title", "image_url")


@query
def prompt_corpus(t):
    return history.prompt_corpus(t.train())


@query
def parse_completions(t):
    return history.parse_completions(t.generated())


@query
def prefix_length_stats(t):
    return history.prefix_length_stats(t.prefixes())


@query
def string_similarity(t):
    pairs = lexical.trigram_topk(t.prefixes(), engine(t).trigrams, 10).select("prefix", "query")
    p, q = text.normalize_strict("prefix"), text.normalize_strict("query")
    return pairs.select(
        "prefix", "query",
        scores.rounded(similarity.ratio(p, q)).alias("ratio"),
        scores.rounded(similarity.partial_ratio(p, q)).alias("partial_ratio"),
        scores.rounded(similarity.token_sort_ratio(p, q)).alias("token_sort_ratio"),
    )


@query
def popularity_variants(t):
    rows = pool_counts(t)
    raw = scores.popularity_10521()
    return rows.select(
        "query",
        scores.rounded(scores.popularity_log()).alias("pop_log"),
        scores.popularity_4321().alias("pop_4321"),
        scores.rounded(scores.popularity_max_norm(rows)).alias("pop_max_norm"),
        scores.rounded(scores.share_of_max(rows, raw)).alias("pop_share"),
    )


@query
def vector_normalize(t):
    unit = scores.l2_normalize("embedding", 0.6)
    rows = t.vectors().select("vec_id", F.posexplode(unit).alias("pos", "value"))
    return rows.select("vec_id", "pos", scores.rounded(F.col("value")).alias("value"))


# --------------------------------------------------------------- history


@query
def pool_features(t):
    return pool_counts(t).select("query", *ENGAGEMENT)


@query
def pool_features_clean(t):
    return tiers.clean_pool(t.pool(), t.features()).withColumn("pop", scores.rounded(F.col("pop")))


@query
def prefix_query_freq(t):
    return history.prefix_query_freq(t.train())


@query
def queries_per_prefix(t):
    return history.queries_per_prefix(t.train())


@query
def avg_queries_per_prefix(t):
    return history.avg_queries_per_prefix(t.train())


@query
def prefix_queries(t):
    lists = history.prefix_queries(t.train())
    return lists.select(
        "prefix", "page",
        F.array_join("queries", "|").alias("queries"),
        F.array_join(F.transform("freqs", lambda n: n.cast("string")), "|").alias("freqs"),
    )


@query
def group_histogram(t):
    return history.group_histogram(history.queries_per_prefix(t.train()))


@query
def feature_map_last(t):
    """Several rows per key; the last by text counts."""
    rows = t.features().withColumn("name", F.col("query")).withColumn("query", text.block_key("query"))
    return tables.feature_map(rows, order="name")


@query
def distinct_queries(t):
    return tables.distinct_queries(t.train())


@query
def history_match(t):
    return history.history_match(t.prefixes(), history.prefix_query_freq(t.train()))


def _edges(t: Tables) -> DataFrame:
    return keep(t)(lexical.edge_index(clean_pool(t), "popularity", cap=3 * tiers.DEPTH), "edges")


@query
def edge_prefix_match(t):
    keyed = t.prefixes().withColumn("key", text.normalize_loose("prefix"))
    return dictionary.edge_match(keyed, _clean_texts(t), "key").select("prefix", "query", scores.rounded(F.col("pop")).alias("pop"))


@query
def edge_long(t):
    """Prefixes of 16 to 25 characters."""
    size = (16 + F.col("p_partkey") % 10).cast("int")
    prefixes = t.parts().filter(F.col("p_partkey") % 20 == 1).select(F.substring(F.col("query"), F.lit(1), size).alias("prefix"))
    found = dictionary.edge_match(prefixes.filter(F.length("prefix") > 15).distinct(), _clean_texts(t))
    return found.select("prefix", "query", "popularity")


@query
def missing_prefixes(t):
    return history.missing_prefixes(t.prefixes(), t.train())


@query
def strategy_coverage(t):
    return history.strategy_coverage(t.prefixes(), history.prefix_query_freq(t.train()), _clean_texts(t))


@query
def valid_in_pool(t):
    return history.valid_in_pool(history.parse_completions(t.generated()), t.pool())


# --------------------------------------------------------------- lexical


@query
def prefix_match(t):
    return dictionary.prefix_match(t.prefixes(), _texts(t), 20)


@query
def bm25_stats(t):
    return lexical.bm25_stats(engine(t).bm25)


@query
def bm25_topk(t):
    return lexical.bm25_topk(t.prefixes(), engine(t).bm25, 20)


@query
def trigram_topk(t):
    return lexical.trigram_topk(t.prefixes(), engine(t).trigrams, 10)


@query
def fuzzy_topk(t):
    # short prefixes against whole queries stay below the default threshold of 0.7
    return lexical.fuzzy_topk(t.prefixes(), engine(t).trigrams, 10, threshold=0.4)


@query
def fuzzy_default(t):
    """Whole pool queries with a dropped character as prefixes: the default threshold is reached."""
    typos = t.pool().select(F.concat(F.substring("query", 1, 1), F.expr("substr(query, 3)")).alias("prefix"))
    return lexical.fuzzy_topk(typos, engine(t).trigrams, 10)


@query
def popular_queries(t):
    return engine(t).popular


@query
def popular_ties(t):
    """More rows than one task sorts, most of them tied."""
    pair = F.concat_ws("|", "prefix", "query").alias("query")
    return ranking.popular(t.train().groupBy(pair).agg(F.count("*").alias("popularity")), "popularity", 11_000)


@query
def short_prefix(t):
    return lexical.short_prefix(t.prefixes(), engine(t).short)


@query
def fuzzy_partial(t):
    pool = clean_pool(t)
    keys = t.prefixes().select(text.normalize_loose("prefix").alias("prefix"))
    return tiers.fuzzy_partial_topk(keys, pool)


@query
def fuzzy_partial_work(t):
    """All pairs there are, and whether beside its first two batches a prefix is compared with under a tenth of the pool."""
    keys = t.prefixes().select(text.normalize_loose("prefix").alias("prefix"))
    work = tiers.partial_work(keys, clean_pool(t))
    batches = similarity.BoundedBlock.FIRST + similarity.BoundedBlock.BATCH
    return work.select("n_prefixes", "pairs", (F.col("compared") <= F.col("n_prefixes") * batches + F.col("pairs") / 10).alias("few_compared"))


# --------------------------------------------------------------- vectors


@query
def embed_hashed(t):
    rows = vectors.embed(t.pool(), "query").select("query", F.posexplode("vec").alias("slot", "value"))
    return rows.filter(F.col("value") > 0).select("query", "slot", scores.rounded(F.col("value")).alias("value"))


@query
def vector_topk(t):
    return vectors.vector_topk(t.query_vectors(), t.pool_vectors(), 20)


@query
def vector_topk_l2(t):
    return vectors.vector_topk(t.query_vectors(), t.pool_vectors(), 20, metric="l2_raw")


@query
def vector_topk_blocks(t):
    """The path for query sides too large to broadcast: every vector against every other."""
    every = t.vectors().select("vec_id", F.col("embedding").alias("vec"))
    cell = F.lit(0).alias("cell")
    return vectors.block_topk(
        every.select(F.col("vec_id").alias("qid"), "vec", cell),
        every.select(F.col("vec_id").alias("pid"), "vec", cell), 5,
    )


@query
def vector_topk_cells(t):
    pool = t.pool_vectors()
    return vectors.vector_topk_cells(t.query_vectors(), pool, 20, nprobe=4, cells=vectors.Cells.first(pool, 16))


@query
def vector_recall(t):
    """Of the 10 nearest vectors of each query, those that cell probing finds."""
    pool = t.pool_vectors()
    exact = vectors.vector_topk(t.query_vectors(), pool, 10).select("qid", "pid")
    some = vectors.vector_topk_cells(t.query_vectors(), pool, 10, nprobe=8, cells=vectors.Cells.first(pool, 16)).select("qid", "pid")
    hits = exact.join(some.withColumn("hit", F.lit(1)), ["qid", "pid"], "left")
    return hits.agg(F.count("*").alias("total"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def _graph(t: Tables) -> graph.GraphIndex:
    return graph.graph_index(t.pool_vectors(), keep=keep(t))


@query
def vector_topk_graph(t):
    return graph.vector_topk_graph(t.query_vectors(), _graph(t), 20)


def _recall_report(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(total, enough): exact pairs, and whether 0.9 of them are found."""
    return graph.recall(exact, found).select("total", (F.col("recall") >= 0.9).alias("enough"))


@query
def vector_recall_graph(t):
    """Of the exact 20 nearest vectors, those that the graphs give."""
    exact = vectors.vector_topk(t.query_vectors(), t.pool_vectors(), 20)
    return _recall_report(exact, graph.vector_topk_graph(t.query_vectors(), _graph(t), 20))


def _lsh(t: Tables) -> lsh.LshIndex:
    # without the cost of a group, so that small tables get signatures too
    planes = lsh.Planes.fit(t.query_vectors(), t.pool_vectors(), 20, group_cost=0)
    return lsh.lsh_index(t.pool_vectors(), planes, keep=keep(t))


@query
def vector_topk_lsh(t):
    return lsh.vector_topk_lsh(t.query_vectors(), _lsh(t), 20)


@query
def vector_recall_lsh(t):
    """Of the exact 20 nearest vectors, those in the buckets that the queries ask."""
    exact = vectors.vector_topk(t.query_vectors(), t.pool_vectors(), 20)
    return _recall_report(exact, lsh.vector_topk_lsh(t.query_vectors(), _lsh(t), 20))


@query
def vector_recall_fitted(t):
    """Of the exact 10 nearest vectors, those in fitted cells with as many probes as the recall asks for."""
    pool = t.pool_vectors()
    exact = vectors.vector_topk(t.query_vectors(), pool, 10)
    return _recall_report(exact, vectors.vector_topk_cells(t.query_vectors(), pool, 10))


@query
def semantic_topk(t):
    return engine(t).semantic(t.prefixes())


def _fitted(t: Tables) -> encoder.FittedEncoder:
    name, folder = "fitted_encoder", keep(t)
    if not tables.exists(t.spark, f"{folder.folder}/{name}"):
        folder(encoder.FittedEncoder.fit(t.pool()).table(t.spark), name)
    return encoder.FittedEncoder.read(t.spark.read.parquet(f"{folder.folder}/{name}"))


def _semantic(t: Tables, prefixes: DataFrame, make_encoder: Callable, k: int) -> DataFrame:
    return vectors.semantic_topk(vectors.embed(prefixes, "prefix", make_encoder), vectors.embed(t.pool(), "query", make_encoder), k)


@query
def semantic_fitted(t):
    """The nearest queries by the encoder that is fitted to the pool."""
    return _semantic(t, lexical.distinct_prefixes(t.prefixes()), _fitted(t).maker(), 20)


@query
def fitted_encoder_checks(t):
    """What must be true of any fit: unit vectors, and squared singular values that are the energy of the projected pool."""
    fitted = _fitted(t)

    def project() -> Callable:
        return fitted.project

    def squares(v):
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)

    rows = vectors.embed(vectors.embed(t.pool(), "query", fitted.maker()), "query", project, out="raw")
    energy = float((fitted.singular**2).sum())
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.abs(squares("vec") - 1) < 1e-9).alias("unit"),
        (F.abs(F.sum(squares("raw")) / energy - 1) < 1e-6).alias("energy"))


@query
def semantic_fitted_hits(t):
    """Distinct logged pairs, and whether the fitted encoder finds more of them among the 50 nearest than the hashed one."""
    pairs = cut_lineage(t.train().filter(F.length("prefix") >= 3).select("prefix", "query").distinct())
    prefixes = pairs.select("prefix").distinct()
    found = [
        _semantic(t, prefixes, make, 50).select("prefix", "query", F.lit(name).alias("encoder"))
        for name, make in (("fitted", _fitted(t).maker()), ("hashed", vectors.hashed_trigram_encoder))
    ]
    hits = pairs.join(found[0].unionByName(found[1]), ["prefix", "query"])
    more = hits.agg((F.count_if(F.col("encoder") == "fitted") > F.count_if(F.col("encoder") == "hashed")).alias("more"))
    return pairs.agg(F.count("*").alias("total")).join(F.broadcast(more))


@query
def pca_project(t):
    rows = t.vectors().select("vec_id", F.col("embedding").alias("vec"))
    out = vectors.CentredPca.fit(rows, 16).transform(rows)
    return out.select("vec_id", F.posexplode("vec").alias("pos", "value")).withColumn(
        "value", scores.rounded(F.col("value"))
    )


@query
def pca_norms(t):
    """At full dimension a projection keeps the squared norm of the centred vector."""
    rows = t.vectors().select("vec_id", F.col("embedding").alias("vec"))
    out = vectors.CentredPca.fit(rows, 64).transform(rows)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("vec_id", F.round(total, 4).alias("norm2"))


@query
def product_search(t):
    """Texts against all clean products: words 2 to 4 of every twentieth title."""
    products = tables.clean_products(t.products()).select("page_id", "title", "image_url")
    words = F.array_join(F.slice(F.split("title", " "), 2, 3), " ")
    asked = products.filter(F.col("page_id") % 20 == 0).select(F.col("page_id").alias("qid"), words.alias("asked"))
    vecs = vectors.embed(asked, "asked").select("qid", "vec")
    return vectors.product_search(vecs, vectors.embed(products, "title"), 5)


# ------------------------------------------------- candidates and completion


@query
def candidates(t):
    return engine(t).candidates(t.prefixes(), pruned=False)


@query
def candidate_prune(t):
    return prune(engine(t).candidates(t.prefixes(), pruned=False), 30)


@query
def rerank_profile_a(t):
    return engine(t).reranked(t.prefixes(), "a")


@query
def rerank_profile_b(t):
    return engine(t).reranked(t.prefixes(), "b")


@query
def complete(t):
    return engine(t).complete(t.prefixes())


@query
def complete_30(t):
    return engine(t).complete(t.prefixes(), 30)


@query
def complete_dirty(t):
    """Repeated pool rows and nulls, features in two rows per query, one of them without counts."""
    none = t.spark.createDataFrame([(None,)], "query string")
    pool = t.pool().unionByName(t.pool()).unionByName(none)
    empty = t.features().select("query", *[F.lit(None).cast("bigint").alias(c) for c in ENGAGEMENT])
    dirty = Engine.build(pool, t.features().unionByName(empty), keep=dirty_keep(t))
    return dirty.complete(t.prefixes())


@query
def hashed_bm25(t):
    return hybrid.hashed_bm25(t.pool(), None)


@query
def hashed_bm25_buckets(t):
    return hybrid.hashed_bm25(t.pool())


@query
def hashed_bm25_murmur(t):
    """The buckets of a feature hasher, without small weights."""
    return hybrid.hashed_bm25(t.pool(), hashed=hybrid.feature_hash, least_weight=hybrid.LEAST_WEIGHT)


def _hybrid(t: Tables, n_buckets):
    e = engine(t)
    name = "exact" if n_buckets is None else str(n_buckets)

    def hybrid_keep(df: DataFrame, table: str) -> DataFrame:
        return keep(t)(df, f"hybrid_{name}_{table}")

    index = hybrid.HybridIndex(e.pool, e.features, e.vectors, n_buckets, keep=hybrid_keep)
    return e.prefix_vectors(t.prefixes()), index


@query
def hybrid_full(t):
    prefix_vecs, index = _hybrid(t, None)
    return hybrid.hybrid_full(t.prefixes(), prefix_vecs, index)


@query
def hybrid_blocked(t):
    prefix_vecs, index = _hybrid(t, None)
    return hybrid.hybrid_blocked(t.prefixes(), prefix_vecs, index)


@query
def hybrid_buckets(t):
    prefix_vecs, index = _hybrid(t, hybrid.N_BUCKETS)
    return hybrid.hybrid_blocked(t.prefixes(), prefix_vecs, index)


@query
def hybrid_projected(t):
    """Centred vectors at full dimension: a rotation, which leaves the products."""
    e = engine(t)
    pca = vectors.CentredPca.fit(e.vectors, vectors.EMBED_DIM)
    folder = tables.store(t.spark, f"{keep(t).folder}/hybrid_projected")
    index = hybrid.HybridIndex(e.pool, e.features, e.vectors, None, keep=folder, pca=pca)
    return hybrid.hybrid_full(t.prefixes(), e.prefix_vectors(t.prefixes()), index)


@query
def cascade(t):
    freq = history.prefix_query_freq(t.train())
    return tiers.cascade(t.prefixes(), freq, _edges(t), clean_pool(t), dictionary=_clean_texts(t))


# ------------------------------------------------------------- evaluation


@query
def hit_at_10(t):
    ranked = dictionary.prefix_match(t.train(), _texts(t), 10)
    return evaluate.hit_at_k(t.train(), ranked, 10)


@query
def hit_at_10_complete(t):
    """The whole pipeline on all logged pairs."""
    truth = t.train()
    return evaluate.hit_at_k(truth, engine(t).complete(truth), 10)


@query
def result_analysis(t):
    return evaluate.result_analysis(engine(t).complete(t.prefixes()))


@query
def validate_submission(t):
    lists = sinks.lists(dictionary.prefix_match(t.prefixes(), _texts(t), 20))
    return evaluate.validate_submission(t.prefixes(), lists, 20)


# --------------------------------------------------------------- learning


@query
def training_candidates(t):
    train = t.train()
    return learn.training_candidates(engine(t).candidates(train, fuzzy=False, pruned=False), train)


@query
def graded_labels(t):
    return pool_counts(t).select("query", learn.graded_label().alias("label"))


@query
def pair_features(t):
    e = engine(t)
    rows = with_engagement(e.candidates(t.prefixes()), e.features)
    return scores.pair_features(rows, ["prefix", "query"])


@query
def normalize_features(t):
    return learn.normalize_features(cut_lineage(pair_features(t)))


def _training(t: Tables) -> DataFrame:
    e, train = engine(t), _logged(t)
    cands = e.candidates(train, fuzzy=False, pruned=False)
    return learn.training_set(train, cands, e.features)


@query
def training_set(t):
    return _training(t)


@query
def training_summary(t):
    return learn.training_summary(_training(t))


@query
def negative_sample(t):
    train = t.train()
    cands = dictionary.prefix_match(train, _texts(t), 20).select(
        "prefix", "query", *[F.lit(0.0).alias(s) for s in SOURCES]
    )
    return learn.groups(train, cands)


@query
def group_split(t):
    rows = t.train().select(F.col("row_id").alias("group_id"), "prefix")
    return learn.group_split(rows).groupBy("part").agg(
        F.count("*").alias("n_rows"), F.min("group_id").alias("first_id"), F.max("group_id").alias("last_id")
    )


@query
def text_split(t):
    return learn.text_split(history.prompt_corpus(t.train()))


@query
def sample_rows(t):
    return ranking.sample_rows(t.train(), learn.SAMPLE, ["row_id"])


@query
def pool_reduce(t):
    pool = clean_pool(t).select("query", "popularity")
    return ranking.reduce_pool(pool, 500, 125)


def _logged(t: Tables) -> DataFrame:
    """The logged rows, written once: who needs them again reads files in place of a join of all line items."""
    return keep(t)(t.train(), "train")


def _labelled(t: Tables) -> DataFrame:
    """Logged rows with their negatives, graded labels and popularity, group by group.

    Only the logged rows are shuffled, with the places of their negatives in a list by prefix, from which come label and popularity too.
    """
    features, train = broadcast_up_to(_features(t)), _logged(t)
    label, pop = learn.graded_label().alias("label"), scores.popularity_4321().alias("pop")
    cands = with_engagement(dictionary.prefix_match(train, _texts(t), 20), features).select("prefix", "query", F.lit(0).alias("label"), pop)
    own = with_engagement(train, features).select("row_id", "prefix", "query", label, pop)
    return learn.groups(own, cands, carried=["label", "pop"], dealt=True)


@query
def ndcg(t):
    return evaluate.ndcg(_labelled(t), "pop")


@query
def lambda_gradients(t):
    """One round of the pairwise objective, with the popularity as the present score."""
    return lambdarank.group_gradients(_labelled(t), F.log1p("pop"))


@query
def ranker_importance(t):
    return _ranker(t)[0].importances(15)


@query
def ranker_ndcg(t):
    model, rows = _ranker(t)
    return evaluate.ndcg(rows.scored("validation", model), "prediction")


_SPLITS: dict[tuple[str, str], learn.TrainingParts] = {}
_RANKERS: dict[tuple[str, str], tuple] = {}


def _split(t: Tables) -> learn.TrainingParts:
    """The training set in its parts."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _SPLITS:
        e, train = engine(t), _logged(t)
        cands = e.candidates(train, fuzzy=False, pruned=False)
        _SPLITS[key] = learn.TrainingParts.of(train, cands, e.features, keep(t))
    return _SPLITS[key]


def _ranker(t: Tables):
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _RANKERS:
        rows = _split(t)
        _RANKERS[key] = learn.Ranker.fit(rows.counted("train"), weight="n"), rows
    return _RANKERS[key]


@query
def ranker_lambda_checks(t):
    """What holds for any fit of the pairwise objective: few trees order held-out groups better than none."""
    rows, limit = _split(t), 4
    fifth = F.pmod(F.xxhash64("group_id"), F.lit(5)) == 0
    model = lambdarank.LambdaRanker.fit(
        rows.rows("train", 10_000), fifth, trees=limit, depth=3, rate=0.3, patience=limit, share=1.0, most_groups=10_000)
    held_out = rows.scored("validation", model)
    learned = evaluate.ndcg(held_out, "prediction").withColumnRenamed("ndcg", "learned")
    plain = evaluate.ndcg(held_out.withColumn("none", F.lit(0.0)), "none")
    better = learned.join(plain, "k").agg(F.count("*").alias("n_cuts"), F.min(F.col("learned") > F.col("ndcg")).alias("raised"))
    return better.select("n_cuts", "raised", F.lit(1 <= len(model.trees) <= limit).alias("n_trees_in_range"))


@query
def ranker_checks(t):
    """What holds for any fitted ranker."""
    model, rows = _ranker(t)
    held_out = rows.scored("validation", model)
    weights = model.importances(len(scores.FEATURES)).agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 6).alias("importance_sum"))
    ndcg_ok = evaluate.ndcg(held_out, "prediction").agg(
        F.count("*").alias("n_cuts"), F.min((F.col("ndcg") >= 0) & (F.col("ndcg") <= 1)).alias("ndcg_in_range"))
    counted = held_out.agg(F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_rows"))
    return weights.crossJoin(ndcg_ok).crossJoin(counted)  # one row each
