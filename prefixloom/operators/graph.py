"""Approximate vector top-k over navigable small-world graphs, one per hash shard.

Equal vectors are one node, with the smallest ids that have them beside it. Nodes are dealt to shards of about
SHARD_ROWS by a hash of their id. A task builds its shard's graph: every node gets a highest level that falls
geometrically with a hash of its id; on every level a node is linked with diverse ones among its WIDTH
nearest (a candidate that is nearer to a chosen neighbour than to the node is put back), links run both
ways, and what the entry node doesn't reach is linked to the nearest node that it does reach. A shard's nearest are found by
products of blocks, so building costs as much per node whatever the table's size.

The graph is kept as rows (shard, level, node, pos, vec, neighbours); vec is on level 0 only. A search reads these rows, one
task a shard: a greedy walk down the levels, then a beam of at least BEAM on level 0 that goes on until its
best are all expanded, for many queries at once. Each shard gives k rows per query, which a ranked window merges.
Shards are searched with every query, so the shards' number and not the pool's size sets the work of a query.

The measure is the inner product; vectors should have about one length, as unit vectors have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import BUCKET_ROWS, kept
from .lexical import Keep, lazy
from .ranking import best, top_k
from .vectors import BROADCAST_ROWS, BROADCAST_VALUES, _matrix, _round

# Links per node and level (twice as many on level 0), beam while building, beam while searching.
LINKS, WIDTH, BEAM = 32, 200, 64
SHARD_ROWS = 8_192
COPIES = 100  # ids kept per distinct vector; a search for more rows per query is refused
QUERY_BLOCK = 2_048
SEARCH_BLOCK = 128  # queries that walk together
GRAPH = "shard int, level int, node {pid}, pos int, vec array<float>, neighbours array<int>"


# ------------------------------------------------------------ one shard


def levels(n: int, links: int = LINKS) -> np.ndarray:
    """The highest level of nodes 0 .. n - 1: geometric, by a hash of the position."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(links)).astype(np.int64)


def diverse(vecs: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> list[np.ndarray]:
    """Of each row's candidates (best first) at most ``most``: those nearer to the row than to a chosen one, then the others."""
    rows, width = near.shape
    each = vecs[near]
    between = each @ each.transpose(0, 2, 1)
    nearest = np.full((rows, width), -np.inf, np.float32)  # to any chosen one
    count = np.zeros(rows, np.int64)
    chosen = np.zeros((rows, width), bool)
    for j in range(width):
        take = (nearest[:, j] < sims[:, j]) & (count < most)
        chosen[take, j] = True
        count += take
        nearest[take] = np.maximum(nearest[take], between[take, j])
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]  # chosen ones, then the nearest of the rest
    return list(np.take_along_axis(near, order, axis=1))


def linked(vecs: np.ndarray, most: int, width: int = WIDTH) -> list[np.ndarray]:
    """Neighbours of every node of one level."""
    n = len(vecs)
    width = min(width, n - 1)
    own: list[np.ndarray] = []
    for first in range(0, n, 64):
        sims = vecs[first:first + 64] @ vecs.T
        sims[np.arange(len(sims)), np.arange(first, first + len(sims))] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width else np.zeros((len(sims), 0), np.int64)
        value = np.take_along_axis(sims, near, axis=1)
        order = np.lexsort((near, -value), axis=1)
        own += diverse(vecs, np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1), most // 2)
    # links run both ways; a node keeps its own and the nearest of those that chose it
    source = np.repeat(np.arange(n), [len(x) for x in own])
    target = np.concatenate(own) if n else np.zeros(0, np.int64)
    sim = np.einsum("ij,ij->i", vecs[source], vecs[target])
    order = np.lexsort((source, -sim, target))
    edge = np.searchsorted(target[order], np.arange(n + 1))
    out = []
    for i in range(n):
        others = source[order[edge[i]:edge[i + 1]]]
        others = others[~np.isin(others, own[i])]
        out.append(np.concatenate([own[i], others[:most - len(own[i])]]).astype(np.int64))
    return out


def connected(vecs: np.ndarray, links: list[np.ndarray], entry: int) -> None:
    """Adds links so that the entry reaches every node."""
    seen = np.zeros(len(links), bool)

    def spread(start: int) -> None:
        todo = [start]
        seen[start] = True
        while todo:
            found = np.unique(np.concatenate([links[i] for i in todo]))
            todo = found[~seen[found]].tolist()
            seen[todo] = True

    spread(entry)
    while not seen.all():
        node = int(np.flatnonzero(~seen)[0])
        inside = np.flatnonzero(seen)
        near = int(inside[np.argmax(vecs[inside] @ vecs[node])])
        links[near] = np.append(links[near], node)
        links[node] = np.append(links[node], near)
        spread(node)


def graph_of(vecs: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Per level from 0: the positions on it and their neighbours' positions. The first position of the last level is the entry."""
    top = levels(len(vecs))
    out = []
    for level in range(int(top.max(initial=0)) + 1):
        at = np.flatnonzero(top >= level)
        links = linked(vecs[at], 2 * LINKS if level == 0 else LINKS)
        out.append((at, links))
    for i, (at, links) in enumerate(out):
        entry = out[i + 1][0][0] if i + 1 < len(out) else at[0]
        connected(vecs[at], links, int(np.searchsorted(at, entry)))
    return [(at, [at[x] for x in links]) for at, links in out]


class Graph:
    """A shard's graph as it is read back: vectors by position, and per level a table of neighbours (-1: none)."""

    def __init__(self, rows: pd.DataFrame):
        base = rows[rows["level"] == 0].sort_values("pos")
        self.nodes = base["node"].to_numpy()
        self.vecs = _matrix(base["vec"]).astype(np.float32)
        self.tables = []
        for level in range(int(rows["level"].max()) + 1):
            part = rows[rows["level"] == level]
            width = max(1, max(len(x) for x in part["neighbours"]))
            table = np.full((len(self.nodes), width), -1, np.int64)
            for pos, links in zip(part["pos"], part["neighbours"]):
                table[pos, :len(links)] = links
            self.tables.append(table)
        self.entry = int(part["pos"].min())

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best found, per query; position -1 where there are fewer."""
        parts = [self._walk(queries[i:i + SEARCH_BLOCK].astype(np.float32), k, max(beam, k)) for i in range(0, len(queries), SEARCH_BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _walk(self, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))
        here = np.full(len(q), self.entry)
        near = (q * self.vecs[here]).sum(1)
        for table in self.tables[:0:-1]:  # greedy from the top
            moving = rows
            while len(moving):
                links = table[here[moving]]
                sims = np.einsum("nd,nld->nl", q[moving], self.vecs[links])
                sims[links < 0] = -np.inf
                to = sims.argmax(1)
                better = sims[np.arange(len(moving)), to] > near[moving]
                here[moving[better]] = links[np.arange(len(moving)), to][better]
                near[moving[better]] = sims[np.arange(len(moving)), to][better]
                moving = moving[better]
        seen = np.zeros((len(q), len(self.nodes)), bool)
        seen[rows, here] = True
        spots = np.full((len(q), beam), -1)
        score = np.full((len(q), beam), -np.inf, np.float32)
        opened = np.ones((len(q), beam), bool)
        spots[:, 0], score[:, 0], opened[:, 0] = here, near, False
        table, live = self.tables[0], rows
        while len(live):
            waiting = np.where(opened[live], -np.inf, score[live])
            pick = waiting.argmax(1)
            more = waiting[np.arange(len(live)), pick] > -np.inf  # else all of the beam are expanded
            live, pick = live[more], pick[more]
            if not len(live):
                break
            opened[live, pick] = True
            links = table[spots[live, pick]]
            fresh = (links >= 0) & ~seen[live[:, None], links]
            seen[live[:, None], np.where(links >= 0, links, spots[live, pick][:, None])] = True
            sims = np.einsum("nd,nld->nl", q[live], self.vecs[links])
            sims[~fresh] = -np.inf
            all_score = np.concatenate([score[live], sims], axis=1)
            all_spots = np.concatenate([spots[live], links], axis=1)
            all_opened = np.concatenate([opened[live], ~fresh], axis=1)
            top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            score[live] = np.take_along_axis(all_score, top, axis=1)
            spots[live] = np.take_along_axis(all_spots, top, axis=1)
            opened[live] = np.take_along_axis(all_opened, top, axis=1)
        spots = np.where(score > -np.inf, spots, -1)
        order = np.lexsort((spots, -score), axis=1)[:, :k]
        return np.take_along_axis(spots, order, axis=1), np.take_along_axis(score, order, axis=1)


# ------------------------------------------------------------ whole tables


@dataclass
class GraphIndex:
    """graph(shard, level, node, pos, vec, neighbours) and members(node, pid)."""

    graph: DataFrame
    members: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str, prefix: str = "nsw") -> GraphIndex:
        return cls(**{f.name: kept(spark, f"{folder}/{prefix}_{f.name}") for f in fields(cls)})


def build_shards(pid: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, node, vec) sorted by shard and node to the rows of the graphs."""
        shard, nodes, vecs = None, [], []

        def built() -> pa.RecordBatch:
            matrix = np.array(vecs, np.float32)
            rows = []
            for level, (at, links) in enumerate(graph_of(matrix)):
                rows += [(shard, level, nodes[i], i, vecs[i] if level == 0 else None, x.tolist()) for i, x in zip(at.tolist(), links)]
            kinds = (pa.int32(), pa.int32(), pid, pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int32()))
            names = ["shard", "level", "node", "pos", "vec", "neighbours"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for one, node, vec in zip(*(batch.column(c).to_pylist() for c in ("shard", "node", "vec"))):
                if one != shard:
                    if nodes:
                        yield built()
                    shard, nodes, vecs = one, [], []
                nodes.append(node)
                vecs.append(vec)
        if nodes:
            yield built()

    return run


def graph_index(pool: DataFrame, shard_rows: int = SHARD_ROWS, keep: Keep = lazy) -> GraphIndex:
    """The index of pool(pid, vec). Rows with a null id or vector take no part."""
    rows = pool.select("pid", F.col("vec").cast("array<float>").alias("vec")).filter(F.col("pid").isNotNull() & F.col("vec").isNotNull())
    same = Window.partitionBy("vec")
    ranked = top_k(rows, ["vec"], [F.asc("pid")], COPIES, "copy").withColumn("node", F.min("pid").over(same))
    ranked = keep(ranked, "nsw_ranked")
    distinct = ranked.filter("copy = 1").select("node", "vec")
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    kind = pool.schema["pid"].dataType
    built = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "node").mapInArrow(
        build_shards(pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()),
        GRAPH.format(pid=kind.simpleString()))
    return GraphIndex(keep(built, "nsw_graph", by=["shard"], rows=shards * BUCKET_ROWS),
                      keep(ranked.select("node", "pid"), "nsw_members", by=["node"]))


def vector_topk_graph(queries: DataFrame, index: GraphIndex, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(qid, pid, score, rk): approximate top-k by inner product of queries(qid, vec); ``beam`` trades time for recall."""
    if k > COPIES:
        raise ValueError(f"the index keeps {COPIES} ids of equal vectors")
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    schema = T.StructType([asked.schema["qid"], T.StructField("node", index.graph.schema["node"].dataType), T.StructField("score", T.DoubleType())])

    def answers(ids: np.ndarray, vecs: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(rows)
        spots, _ = graph.search(vecs, k, beam)
        row, column = np.nonzero(spots >= 0)
        spot = spots[row, column]
        score = _round(np.einsum("ij,ij->i", vecs[row], graph.vecs[spot].astype(np.float64)))
        return pd.DataFrame({"qid": ids[row], "node": graph.nodes[spot], "score": score})

    size = asked.agg(F.count("*").alias("rows"), F.sum(F.size("vec")).alias("numbers")).first()
    if not size["rows"]:
        found = asked.sparkSession.createDataFrame([], schema)
    elif size["rows"] <= BROADCAST_ROWS and size["numbers"] <= BROADCAST_VALUES:
        sent = asked.toPandas()
        shared = asked.sparkSession.sparkContext.broadcast((sent["qid"].to_numpy(), _matrix(sent["vec"])))
        # the graph is stored by shard, so a group is read where it lies
        found = index.graph.groupBy("shard").applyInPandas(lambda rows: answers(*shared.value, rows), schema)
    else:
        blocks = -(-size["rows"] // QUERY_BLOCK)
        shards = index.graph.select("shard").distinct()
        q = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        numbers = F.array(*[F.lit(r["shard"]) for r in shards.collect()])
        q = q.select("qid", "vec", "block", F.explode(numbers).alias("shard"))
        g = index.graph.select("*", every)

        def local(qs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(rows):
                return pd.DataFrame({"qid": [], "node": [], "score": []})
            return answers(qs["qid"].to_numpy(), _matrix(qs["vec"]), rows)

        found = q.groupBy("shard", "block").cogroup(g.groupBy("shard", "block")).applyInPandas(local, schema)
    nearest = top_k(found, ["qid"], best("score", "node"), k, "nk").drop("nk")
    named = nearest.join(index.members, "node").select("qid", "pid", "score")
    return top_k(named, ["qid"], best("score", "pid"), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(total, found, recall): of the exact (qid, pid) those that were found."""
    hits = exact.select("qid", "pid").join(found.select("qid", "pid").withColumn("hit", F.lit(1)), ["qid", "pid"], "left")
    return hits.agg(F.count("*").alias("total"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
