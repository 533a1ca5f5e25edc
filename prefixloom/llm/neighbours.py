"""Nearest neighbours by inner product: a block matrix join on int8 codes with error bounds.

A vector x becomes codes c from -127 to 127 and a scale s, so that x = s c + e. The product of two
vectors then lies within |e_q| |x| + |s c_q| |e_x| of the product of their codes, which a matrix product
of two blocks gives for all pairs of a tile (in float32, where integers of this size are exact). A
pair survives if its upper bound reaches the k-th largest lower bound of its query. Survivors alone
are recomputed from the original vectors, component by component in double precision, and go through a
heap of k per query. Each task's k best are merged by heaps again. The result is exact.

Scale: candidates are dealt to shards by a hash of their id, and every query vector visits every shard.
A task keeps one shard (SHARD_ROWS vectors) and streams the queries through it in blocks, so memory does
not grow with either side, and no pair leaves a task but the k best of a query and shard. Equal vectors
are one row of a tile, with their k + 1 smallest ids, so a vector that a third of all rows have costs no more
than any other.

Rows whose id or vector is null, whose vector is zero, empty, or holds a null or non-finite component
take no part. Vectors of different length are not compared. Of several rows with one id the one with the
smallest vector takes part. A vector whose largest component is under 1e-100 or over 1e100 has no bounds: its pairs
are all computed exactly; a product that is not a number for overflow ranks last. Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty
table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

K = 20
SHARD_ROWS = 65_536
LEAST_SHARDS, LEAST_ROWS = 24, 1_024  # small inputs are spread too
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4_096
TINY = 1e-100  # beyond it, and its inverse, components have no codes
SLACK = 1e-5  # of the norms' product: rounding of the float32 scaling and of the bounds


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    as_doubles = vector.cast("array<double>")
    finite = F.forall(as_doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(as_doubles, lambda x: x != 0), F.lit(False))


class Block:
    """Codes, scales and norms of some vectors of one length, distinct rows only, and who has them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int | None):
        raw = np.ascontiguousarray(vectors)
        rows = raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
        order = np.lexsort((ids, np.unique(rows, return_inverse=True)[1]))
        rows, ids = rows[order], ids[order]
        new = np.concatenate([[True], rows[1:] != rows[:-1]])
        starts = np.flatnonzero(new)
        self.vectors = raw[order][starts].astype(np.float64)
        stops = np.concatenate([starts[1:], [len(ids)]])
        self.ids = [ids[a:b if keep is None else min(b, a + keep)].tolist() for a, b in zip(starts, stops)]
        # squares of very small or large components leave the doubles' range: such rows have no codes and no bounds
        most = np.abs(self.vectors).max(1)
        self.bounded = (most > TINY) & (most < 1 / TINY)
        scale = np.where(self.bounded, most / 127, np.inf)
        codes = np.rint(self.vectors / scale[:, None])
        self.scale, self.codes = np.where(self.bounded, scale, 0.0), codes.astype(np.int8)
        near = codes * self.scale[:, None]
        own = np.where(self.bounded[:, None], self.vectors, 0.0)
        self.norm, self.near_norm = np.linalg.norm(own, axis=1), np.linalg.norm(near, axis=1)
        self.error = np.linalg.norm(own - near, axis=1)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows side by side, added up component by component."""
    total = np.zeros(len(left))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(left.shape[1]):
            total += left[:, i] * right[:, i]
    return total


def search(queries: Block, candidates: Block, k: int) -> list[list[tuple[float, int]]]:
    """For each query vector the k best (score, -id), as a heap."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
    wide = np.float32 if queries.codes.shape[1] <= 1_000 else np.float64  # integers stay exact
    left = queries.codes.astype(wide)
    floor = np.full(len(heaps), -np.inf)
    for first in range(0, len(candidates.ids), CANDIDATE_BLOCK):
        part = slice(first, first + CANDIDATE_BLOCK)
        tile = (left @ candidates.codes[part].astype(wide).T).astype(np.float64)
        tile *= queries.scale[:, None] * candidates.scale[None, part]
        bound = queries.error[:, None] * candidates.norm[None, part] + queries.near_norm[:, None] * candidates.error[None, part]
        bound += SLACK * queries.norm[:, None] * candidates.norm[None, part]
        bound[~queries.bounded] = np.inf
        bound[:, ~candidates.bounded[part]] = np.inf
        if tile.shape[1] >= k:
            sure = np.partition(tile - bound, tile.shape[1] - k, axis=1)[:, tile.shape[1] - k]
            floor = np.maximum(floor, sure)
        q, c = np.nonzero(tile + bound >= floor[:, None])
        exact = product(queries.vectors[q], candidates.vectors[part][c])
        exact = np.where(np.isnan(exact), -np.inf, exact)
        for row, column, score in zip(q.tolist(), (c + first).tolist(), exact.tolist()):
            heap = heaps[row]
            for own in candidates.ids[column]:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -own))
                elif heap[0] < (score, -own):
                    heapq.heapreplace(heap, (score, -own))
                else:
                    break  # ids ascend
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def tiles(k: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (size, shard, is_query, id, vector) in this order: a shard's candidates, then its queries."""
        key, block = None, None
        ids, vectors, waiting, asked = [], [], [], []

        def answer() -> pa.RecordBatch:
            queries = Block(np.array(waiting), np.frombuffer(b"".join(asked), kind).reshape(len(asked), -1), None)
            found = search(queries, block, k + 1)  # one may be the query itself
            rows = [(q, *zip(*best)) for owners, heap in zip(queries.ids, found) for q in owners
                    if (best := heapq.nlargest(k, (x for x in heap if -x[1] != q)))]
            waiting.clear()
            asked.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([list(r[1]) for r in rows], pa.list_(pa.float64())),
                pa.array([[-i for i in r[2]] for r in rows], pa.list_(pa.int64()))], ["query_id", "scores", "ids"])

        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for size, shard, is_query, own, vector in zip(of["size"], of["shard"], of["is_query"], of["id"], of["vector"]):
                if (size, shard) != key:
                    if waiting:
                        yield answer()
                    key, block, ids, vectors = (size, shard), None, [], []
                if not is_query:
                    ids.append(own)
                    vectors.append(vector)
                    continue
                if not ids:
                    continue  # a shard without candidates of this length
                if block is None:
                    block = Block(np.array(ids), np.frombuffer(b"".join(vectors), kind).reshape(len(ids), -1), k + 1)
                waiting.append(own)
                asked.append(vector)
                if len(waiting) >= QUERY_BLOCK:
                    yield answer()
        if waiting:
            yield answer()

    return run


def merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (query_id, scores, ids) by query_id: one heap of k goes through a query's rows."""
        current, heap = None, []
        done: list[tuple[int, int, int, float]] = []

        def close() -> None:
            best = sorted(heap, reverse=True)
            done.extend((current, rank, -i, score) for rank, (score, i) in enumerate(best, 1))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", "vec_id", "score"])
            done.clear()
            return batch

        for batch in batches:
            for query, scores, ids in zip(*(batch.column(c).to_pylist() for c in ("query_id", "scores", "ids"))):
                if query != current:
                    if heap:
                        close()
                    current, heap = query, []
                for pair in zip(scores, (-i for i in ids)):
                    if len(heap) < k:
                        heapq.heappush(heap, pair)
                    elif heap[0] < pair:
                        heapq.heapreplace(heap, pair)
                    else:
                        break  # best first
            yield out()
        if heap:
            close()
            yield out()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row that is_query marks."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"  # travels in its own width
    kind = np.float32 if single else np.float64
    good = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    one = good.groupBy("id").agg(F.min(F.struct("v", "asks")).alias("r")).select("id", F.col("r.v").alias("v"), F.col("r.asks").alias("asks"))
    one = written(one)
    n = one.count()
    shards = max(-(-n // SHARD_ROWS), min(LEAST_SHARDS, -(-n // LEAST_ROWS)), 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            ends = column.offsets.to_numpy()
            raw = column.values.to_numpy()
            body = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.diff(ends).astype(np.int32)), batch.column("id"), batch.column("asks"), pa.array(body, pa.binary())],
                ["size", "id", "asks", "vector"])

    rows = one.mapInArrow(packed, "size int, id long, asks boolean, vector binary")
    own = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    sides = F.array(F.struct(own.alias("shard"), F.lit(False).alias("is_query")))
    visits = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("shard"), F.lit(True).alias("is_query")))
    dealt = rows.select("size", "id", "vector", F.explode(F.when(F.col("asks"), F.concat(sides, visits)).otherwise(sides)).alias("to"))
    dealt = dealt.select("size", "to.shard", "to.is_query", "id", "vector").repartition(shards, "shard")
    best = dealt.sortWithinPartitions("size", "shard", "is_query", "id").mapInArrow(
        tiles(k, kind), "query_id long, scores array<double>, ids array<long>")
    by_query = best.repartition("query_id").sortWithinPartitions("query_id")
    return by_query.mapInArrow(merged(k), "query_id long, rank int, vec_id long, score double")


def op6_neighbours(spark, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
