"""Vector retrieval: exact inner-product top-k, cell-probed top-k, encoders, PCA.

Scoring is a matrix product inside a task. Every task returns at most k rows per
query vector, so pairs are never emitted or shuffled; a ranked window then merges
the tasks. A small query side is broadcast to the pool's own partitions. A larger
one is cut, like the pool, into hash blocks of bounded size, and one task handles
one pair of blocks. Of a product only the maxima of groups of columns are ranked;
the k best are looked for in the groups that can hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import DIGITS, l2_normalize
from ..functions.text import normalize_strict
from ..session import broadcast_up_to
from .ranking import best, top_k

BROADCAST_ROWS = 20_000
BROADCAST_VALUES = 8_000_000  # doubles: 64 MB
QUERY_BLOCK = 2_048
POOL_BLOCK = 16_384
FEW_BLOCKS = 16  # query blocks beyond which a cell gets larger ones, since the pool is copied once per query block
LARGER = 8  # times QUERY_BLOCK at most
BLOCK_RESULTS = 100_000  # rows that a larger query block may return
TILE_VALUES = 4_000_000  # products held at once: 32 MB
HELD = 50_000  # rows that a task with a broadcast query side keeps before it hands them on
TEXT_STEP = 2**17  # characters encoded at once
PRODUCTS = 1_000_000  # that score_block holds at once: 8 MB
GROUP = 64  # columns of a tile of which one maximum is taken
CELL_SAMPLE = 200_000  # vectors that fit the centres
RECALL = 0.92  # of the exact top-k, aimed at on the sample so that 0.9 holds for all queries
PROBE_SAMPLE = 500
LEAST_PROBES = 4
EMBED_DIM = 64


# ---------------------------------------------------------------- encoders


def hashed_trigram_encoder(dim: int = EMBED_DIM) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed character trigram counts.

    The text gets one blank on either side; a trigram with code points a, b, c
    counts in component (961 a + 31 b + c) mod dim. A text without trigrams is 0.
    """

    def encode(texts: list[str]) -> np.ndarray:
        size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
        flat = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), size)
        out = np.zeros((len(texts), dim))
        if len(flat) > 2:
            slots = (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) % dim
            inside = row[:-2] == row[2:]
            out += np.bincount((row[:-2] * dim + slots)[inside], minlength=len(texts) * dim).reshape(len(texts), dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def text_steps(texts: list[str], most: int) -> Iterator[list[str]]:
    """Stretches of texts with at most so many characters, or with one text."""
    end = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    first, done = 0, 0
    while first < len(texts):
        last = max(int(np.searchsorted(end, done + most, "right")), first + 1)
        yield texts[first:last]
        first, done = last, end[last - 1]


def embed(
    df: DataFrame, text: str, make_encoder: Callable = hashed_trigram_encoder, out: str = "vec"
) -> DataFrame:
    """Adds unit vectors of the strictly normalised text.

    ``make_encoder()`` is called once per task and returns list[str] -> matrix;
    a user model is loaded there.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            rows: list = []
            for some in text_steps(texts.tolist(), TEXT_STEP):
                rows += list(np.asarray(encoder(some), dtype=np.float64))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, encode(normalize_strict(text)))


# ------------------------------------------------------- scoring in a task


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _round(x: np.ndarray) -> np.ndarray:
    """Half away from zero, like SQL round (numpy rounds half to even)."""
    scale = 10.0**DIGITS
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale + 0.0


def _term_rows(terms: pd.Series) -> dict:
    where: dict = {}
    for row, ts in enumerate(terms):
        for t in ts:
            where.setdefault(t, []).append(row)
    return {t: np.array(rows) for t, rows in where.items()}


def _near_best(tile: np.ndarray, n: int, keep: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, rounded value): of every row of the tile at least the ``keep`` best of the first n places, ties by place.

    Column c is in group c % groups, and the maxima of the groups bound what can be among the best from below.
    """
    layers = tile.reshape(len(tile), -1, groups)
    most = layers.max(axis=1)
    floor = np.partition(most, groups - keep, axis=1)[:, groups - keep]
    floor -= 2 * 10.0**-DIGITS + 1e-15 * np.abs(floor)  # what rounding can make equal
    open_groups = most >= floor[:, None]
    if not np.isfinite(most).all() or np.count_nonzero(open_groups) > max(open_groups.size // 8, 2 * keep * len(tile)):
        tile = _round(tile[:, :n])  # many equal values, or some that do not compare
        floor = np.partition(tile, n - keep, axis=1)[:, n - keep, None]
        ties = tile == floor
        row, near = np.nonzero((tile > floor) | ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= keep))
        return row, near, tile[row, near]
    row, group = np.nonzero(open_groups)
    values = layers[row, :, group]
    hit, layer = np.nonzero(values >= floor[row, None])
    return row[hit], layer * groups + group[hit], _round(values[hit, layer])


def score_block(queries: pd.DataFrame, pool: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best pool rows of every query row: (qid, pid, score), ties by pid.

    score = vec.vec, plus for shared terms the product of the weights, plus bias,
    where those columns exist.
    """
    pool = pool.sort_values("pid", kind="stable")
    ids, vecs = pool["pid"].to_numpy(), _matrix(pool["vec"])
    bias = pool["bias"].to_numpy() if "bias" in pool else None
    sparse = "terms" in pool
    where = _term_rows(pool["terms"]) if sparse else {}
    weight = pool["term_weight"].to_numpy() if sparse else None
    keep, n = min(k, len(ids)), len(ids)
    parts = []
    step = max(1, PRODUCTS // max(n, 1))
    groups = -(-n // max(1, min(GROUP, n // (8 * keep))))
    vecs = np.concatenate([vecs, np.zeros((-n % groups, vecs.shape[1]))])
    buffer = np.empty((min(step, len(queries)), len(vecs)))
    for first in range(0, len(queries), step):
        some = queries.iloc[first:first + step]
        tile = np.matmul(_matrix(some["vec"]), vecs.T, out=buffer[:len(some)])
        if sparse:
            for row, (terms, weights) in enumerate(zip(some["terms"], some["term_weights"])):
                for t, w in zip(terms, weights):
                    rows = where.get(t)
                    if rows is not None:
                        tile[row, rows] += w * weight[rows]
        if "bias" in pool:
            tile[:, :n] += bias
        tile[:, n:] = -np.inf
        row, near, score = _near_best(tile, n, keep, groups)
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < keep
        parts.append(pd.DataFrame({"qid": some["qid"].to_numpy()[row[top]], "pid": ids[near[top]], "score": score[top]}))
    return pd.concat(parts) if parts else pd.DataFrame({"qid": [], "pid": [], "score": []})


def _result_schema(queries: DataFrame, pool: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("pid", pool.schema["pid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _query_blocks(rows: Column, k: int) -> Column:
    larger = max(QUERY_BLOCK, min(LARGER * QUERY_BLOCK, BLOCK_RESULTS // k))
    plain, fewer = (F.ceil(rows / F.lit(size)) for size in (QUERY_BLOCK, larger))
    return F.least(plain, F.greatest(F.lit(FEW_BLOCKS), fewer)).cast("int")


def block_topk(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Top-k within equal ``cell`` values: queries(cell, qid, vec..), pool(cell, pid, vec..).

    A cell is cut into hash blocks on both sides, QUERY_BLOCK by POOL_BLOCK rows,
    so a cell that holds a third of the rows becomes many tasks; with more than
    FEW_BLOCKS of them its query blocks are larger, as far as their results allow.
    The counts, one row per cell, are broadcast up to 100,000 cells.
    """
    schema = _result_schema(queries, pool)
    n_q = queries.groupBy("cell").agg(_query_blocks(F.count("*"), k).alias("nqb"))
    n_p = pool.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(POOL_BLOCK)).cast("int").alias("npb"))
    sizes = broadcast_up_to(n_q.join(n_p, "cell"))

    def blocks(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = (
        queries.join(sizes, "cell")
        .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")).cast("int"))
        .withColumn("pb", blocks("npb"))
        .drop("nqb", "npb")
    )
    p = (
        pool.join(sizes, "cell")
        .withColumn("pb", F.pmod(F.xxhash64("pid"), F.col("npb")).cast("int"))
        .withColumn("qb", blocks("nqb"))
        .drop("nqb", "npb")
    )

    def local(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ps):
            return pd.DataFrame({"qid": [], "pid": [], "score": []})
        return score_block(qs.rename(columns=lambda c: c.removeprefix("q_")), ps, k)

    keys = ["cell", "qb", "pb"]
    # own names on the query side: both sides may come from one table
    q = q.withColumnsRenamed({c: f"q_{c}" for c in q.columns if c not in keys})
    found = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(local, schema)
    return top_k(found, ["qid"], best("score", "pid"), k)


def vector_topk(queries: DataFrame, pool: DataFrame, k: int = 20, metric: str = "cosine") -> DataFrame:
    """(qid, pid, score, rk): exact top-k by inner product of queries(qid, vec) and pool(pid, vec).

    On unit vectors the product is the cosine. metric='l2_raw' reports the squared
    distance 2-2cos of the same neighbours instead.
    """
    one = queries.select("qid", "vec")
    size = one.agg(F.count("*").alias("rows"), F.sum(F.size("vec")).alias("numbers")).first()
    if size["rows"] <= BROADCAST_ROWS and (size["numbers"] or 0) <= BROADCAST_VALUES:
        out = top_k(_broadcast_topk(one, one.toPandas(), pool, k), ["qid"], best("score", "pid"), k)
    else:
        q = one.withColumn("cell", F.lit(0))
        out = block_topk(q, pool.withColumn("cell", F.lit(0)), k)
    if metric == "l2_raw":
        out = out.withColumn("score", F.round(2.0 - 2.0 * F.col("score"), DIGITS))
    return out


def _broadcast_topk(queries: DataFrame, rows: pd.DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """At least the k best rows per query and partition; ``rows`` are all rows of queries, within the caps above."""
    schema = _result_schema(queries, pool)
    ids, vecs = rows["qid"], rows["vec"]
    shared = pool.sparkSession.sparkContext.broadcast((ids.to_numpy(), vecs))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vecs = shared.value
        for part in _running_best(pd.DataFrame({"qid": np.arange(len(ids)), "vec": vecs}), batches, k):
            yield part.assign(qid=ids[part["qid"].to_numpy()])

    return pool.select("pid", "vec").mapInPandas(local, schema)


def _running_best(queries: pd.DataFrame, batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """(qid, pid, score) with the k best of every query, for queries numbered from 0.

    No more than about 2 HELD rows are kept: what is not better than k rows seen goes, and if that is
    not enough the rows are handed on. What comes later must still reach the k-th of them.
    """
    floor = np.full(len(queries), -np.inf)
    found, held = [], 0
    some = max(1, HELD // k)
    for batch in batches:
        for first in range(0, len(queries) if len(batch) else 0, some):
            part = score_block(queries.iloc[first:first + some], batch, k)
            part = part[part["score"].to_numpy() >= floor[part["qid"].to_numpy()]]
            found.append(part)
            held += len(part)
            if held > HELD:
                best_now = _trim(pd.concat(found), k)
                last = best_now[best_now.groupby("qid").cumcount() == k - 1]
                floor[last["qid"].to_numpy()] = last["score"].to_numpy()
                found, held = [best_now], len(best_now)
                if held > HELD // 2:
                    yield best_now
                    found, held = [], 0
    if held:
        yield _trim(pd.concat(found), k)


def _trim(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["qid", "score", "pid"], ascending=[True, False, True])
    return ordered[ordered.groupby("qid").cumcount() < k]


# ---------------------------------------------------------- cell probing


class Cells:
    """A coarse partition of the vector space by centres."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers

    @classmethod
    def fit(cls, pool: DataFrame, n_cells: int | None = None, seed: int = 42) -> Cells:
        """k-means centres, the square root of the number of rows if n_cells is None, fitted on at most about CELL_SAMPLE rows."""
        vecs = pool.select(array_to_vector(F.col("vec")).alias("features"))
        rows = vecs.count()
        if rows > CELL_SAMPLE:
            vecs = vecs.sample(CELL_SAMPLE / rows, seed)
        model = KMeans(k=n_cells or max(1, round(rows**0.5)), seed=seed, maxIter=10).fit(vecs)
        return cls(np.array(model.clusterCenters()))

    @classmethod
    def first(cls, pool: DataFrame, n_cells: int) -> Cells:
        """The vectors of the n_cells smallest ids as centres."""
        return cls(np.array([r["vec"] for r in pool.orderBy("pid").limit(n_cells).select("vec").collect()]))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        return spark.createDataFrame(rows, "cell int, centre array<double>")

    @classmethod
    def read(cls, table: DataFrame) -> Cells:
        return cls(np.array([r["centre"] for r in table.orderBy("cell").collect()]))

    def assigned(self, pool: DataFrame) -> DataFrame:
        """pool with the cell of each vector."""
        return pool.withColumn("cell", self.nearest("vec", 1)[0])

    def nearest(self, vec: Column | str, n: int) -> Column:
        """The n nearest cells of a vector, nearest first."""
        centers = self.centers
        half = (centers**2).sum(axis=1) / 2
        n = min(n, len(centers))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def near(v: pd.Series) -> pd.Series:
            far = half[None, :] - _matrix(v) @ centers.T
            return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return near(vec)

    def probes(self, queries: DataFrame, pool: DataFrame, k: int) -> int:
        """The nearest cells in which RECALL of the exact top-k are, measured on PROBE_SAMPLE queries taken by hash."""
        some = queries.select("qid", "vec").orderBy(F.xxhash64("qid"), "qid").limit(PROBE_SAMPLE)
        exact = vector_topk(some, pool.select("pid", "vec"), k).select("qid", "pid")
        order = some.select("qid", self.nearest("vec", len(self.centers)).alias("order"))
        at = exact.join(pool.select("pid", "cell"), "pid").join(order, "qid").select(F.array_position("order", F.col("cell")).alias("n"))
        counts = dict(at.groupBy("n").count().collect())
        wanted, held, n = RECALL * sum(counts.values()), 0, 0
        while held < wanted:
            n += 1
            held += counts.get(n, 0)
        return max(n, LEAST_PROBES)


def vector_topk_cells(
    queries: DataFrame, pool: DataFrame, k: int = 20, n_cells: int | None = None, nprobe: int | None = None, cells: Cells | None = None
) -> DataFrame:
    """Approximate top-k: each query is compared with the vectors of its nprobe nearest cells, by default Cells.probes.

    A pool that has a ``cell`` column, as Cells.assigned gives it, is not assigned again.
    """
    cells = cells or Cells.fit(pool, n_cells)
    pool = pool if "cell" in pool.columns else cells.assigned(pool)
    nprobe = nprobe or cells.probes(queries, pool, k)
    q = queries.select("qid", "vec", F.explode(cells.nearest("vec", nprobe)).alias("cell"))
    return block_topk(q, pool.select("pid", "vec", "cell"), k)


# -------------------------------------------------------------------- PCA


class CentredPca:
    """PCA on centred vectors (Spark's own PCA does not centre when transforming)."""

    def __init__(self, scaler: StandardScalerModel, pca: PCAModel):
        self.scaler, self.pca = scaler, pca

    @classmethod
    def fit(cls, df: DataFrame, dim: int = 128, vec: str = "vec") -> CentredPca:
        rows = df.select(array_to_vector(F.col(vec)).alias("raw"))
        scaler = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(rows)
        pca = PCA(k=dim, inputCol="centred", outputCol="reduced").fit(scaler.transform(rows))
        return cls(scaler, pca)

    def transform(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        raw = df.withColumn("raw", array_to_vector(F.col(vec)))
        done = self.pca.transform(self.scaler.transform(raw))
        return done.withColumn(vec, vector_to_array("reduced")).drop("raw", "centred", "reduced")

    def write(self, folder: str) -> None:
        self.scaler.write().overwrite().save(f"{folder}/scaler")
        self.pca.write().overwrite().save(f"{folder}/pca")

    @classmethod
    def read(cls, folder: str) -> CentredPca:
        return cls(StandardScalerModel.load(f"{folder}/scaler"), PCAModel.load(f"{folder}/pca"))


def semantic_topk(
    prefix_vecs: DataFrame, pool_vecs: DataFrame, k: int = 20, metric: str = "cosine",
    cells: Cells | None = None, nprobe: int | None = None,
) -> DataFrame:
    """(prefix, query, score, rk) for prefix_vecs(prefix, vec) and pool_vecs(query, vec).

    Exact, unless ``cells`` are given: then the nprobe nearest cells are searched (by default Cells.probes).
    """
    q = prefix_vecs.select(F.col("prefix").alias("qid"), "vec")
    p = pool_vecs.withColumnRenamed("query", "pid")
    if cells is None:
        found = vector_topk(q, p.select("pid", "vec"), k, metric)
    else:
        found = vector_topk_cells(q, p, k, nprobe=nprobe, cells=cells)
        if metric == "l2_raw":
            found = found.withColumn("score", F.round(2.0 - 2.0 * F.col("score"), DIGITS))
    return found.withColumnsRenamed({"qid": "prefix", "pid": "query"})


def product_search(query_vecs: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rk, title, image_url, score): nearest products(page_id, title, image_url, vec)."""
    unit = products.select(F.col("page_id").alias("pid"), l2_normalize("vec").alias("vec"))
    found = vector_topk(query_vecs.select("qid", l2_normalize("vec").alias("vec")), unit, k)
    shown = products.select(F.col("page_id").alias("pid"), "title", "image_url")
    return found.join(shown, "pid").select("qid", "rk", "title", "image_url", "score")
