"""A sorted dictionary of texts: leading text of any length is found by binary search.

The texts are dealt once to ranges of about PART_ROWS rows, sorted within, and written with the boundaries between the
ranges. A prefix is a range of texts, which meets few parts: short ones meet many parts, but there are few of them. Nothing is
stored per leading text, whatever its length.

A set of distinct prefixes within a checked size travels to the files of the parts it meets, which are read in place: each batch of
sorted texts looks up the prefixes that fall between its ends. A larger set is dealt to the parts by the boundaries, and
each part's texts and prefixes meet in tasks that hold one part and let the prefixes stream by; a part that is asked for too often is held by
several tasks. Only the matching rows leave a task, of a limited search at most ``limit`` per prefix and batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_strict
from ..session import cut_lineage
from ..sources.tables import BUCKET_ROWS, kept
from .lexical import Keep, distinct_prefixes, lazy
from .ranking import top_k

PART_ROWS = 200_000
SAMPLE_PER_PART = 20  # texts drawn by hash from which the boundaries come
BROADCAST_PREFIXES = 50_000
BROADCAST_BYTES = 16 << 20
ASKED_ROWS = 100_000  # prefixes that one task answers for a part
FEW_PARTS = 1_000
EMIT_ROWS = 50_000  # rows of a result that leave a task together


@dataclass
class Dictionary:
    """rows(part, text, query, ...) sorted within parts, bounds(part, text, query): the first row of every part but the first."""

    rows: DataFrame
    bounds: DataFrame

    @classmethod
    def build(cls, pool: DataFrame, text: Column | str = "query", keep: Keep = lazy, name: str = "dictionary") -> Dictionary:
        """Of pool(query, ...), by ``text`` (the query or a form of it). Rows with a null text or query take no part."""
        rows = pool.withColumn("text", F.col(text) if isinstance(text, str) else text)
        rows = rows.filter(F.col("text").isNotNull() & F.col("query").isNotNull())
        n = rows.count()
        parts = max(1, -(-n // PART_ROWS))
        # the boundaries are order statistics of a hash sample, the same on every run
        some = rows.select("text", "query").orderBy(F.xxhash64("text", "query"), "text", "query").limit(SAMPLE_PER_PART * parts if parts > 1 else 0)
        drawn = sorted({(r["text"], r["query"]) for r in some.collect()})
        cuts = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
        bounds = rows.sparkSession.createDataFrame([(i + 1, t, q) for i, (t, q) in enumerate(cuts)], "part int, text string, query string")
        dealt = rows.withColumn("part", part_of(cuts)("text", "query") if cuts else F.lit(0))
        columns = ["part", "text", *[c for c in pool.columns if c != "text"]]
        if keep is lazy:  # the parts are read by several jobs
            return cls(cut_lineage(dealt.select(columns).repartition("part").sortWithinPartitions("part", "text", "query")), bounds)
        held = keep(dealt.select(columns), name, by=["part"], rows=(len(cuts) + 1) * BUCKET_ROWS, sort=["part", "text", "query"])
        return cls(held, keep(bounds, f"{name}_bounds"))

    @classmethod
    def read(cls, spark: SparkSession, folder: str, name: str = "dictionary") -> Dictionary:
        return cls(kept(spark, f"{folder}/{name}"), kept(spark, f"{folder}/{name}_bounds"))

    def cuts(self) -> list[tuple[str, str]]:
        return [(r["text"], r["query"]) for r in self.bounds.orderBy("part").collect()]

    def begins(self, prefixes: DataFrame, prefix: str = "prefix", limit: int | None = None) -> DataFrame:
        """(<prefix>, rows' columns but part): all rows whose text begins with a prefix, '' begins all; with ``limit`` at least the first
        so many by query of each prefix, and not many more."""
        asked = prefixes.select(F.col(prefix).alias("asked")).filter(F.col("asked").isNotNull()).distinct()
        schema = T.StructType([T.StructField(prefix, T.StringType())] + [f for f in self.rows.schema if f.name != "part"])
        size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("asked")).alias("bytes")).first()
        if not size["n"]:
            return prefixes.sparkSession.createDataFrame([], schema)
        cuts = self.cuts()
        if size["n"] <= BROADCAST_PREFIXES and (size["bytes"] or 0) <= BROADCAST_BYTES:
            texts = sorted(r["asked"] for r in asked.collect())
            met = sorted({i for t in texts for i in met_by(t, cuts)})
            rows = self.rows if len(met) > min(FEW_PARTS, len(cuts)) else self.rows.filter(F.col("part").isin(met))
            shared = prefixes.sparkSession.sparkContext.broadcast(texts)
            return rows.mapInArrow(lambda batches: sorted_matches(batches, shared.value, schema, limit), schema)
        return self._dealt(asked, cuts, schema, limit)

    def _dealt(self, asked: DataFrame, cuts: list[tuple[str, str]], schema: T.StructType, limit: int | None) -> DataFrame:
        """Prefixes and rows meet by part; a part that many prefixes meet goes to several tasks."""

        @F.udf(T.ArrayType(T.IntegerType()))  # a few numbers per distinct prefix
        def visits(text: str) -> list[int]:
            return list(met_by(text, cuts))

        sent = cut_lineage(asked.select("asked", F.explode(visits("asked")).alias("part")))
        often = sent.groupBy("part").agg(F.ceil(F.count("*") / F.lit(ASKED_ROWS)).cast("int").alias("tasks"))
        often = F.broadcast(often)  # a row per part, of which there is one for PART_ROWS rows
        columns = [c for c in self.rows.columns if c != "part"]
        held = self.rows.join(often, "part").select(
            "part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("asked"), *columns)
        side = sent.join(often, "part").select(
            "part", F.pmod(F.xxhash64("asked"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("side"), "asked",
            *[F.lit(None).cast(self.rows.schema[c].dataType).alias(c) for c in columns])
        met = held.unionByName(side).repartition("part", "task").sortWithinPartitions("part", "task", "side", "text", "query", "asked")
        return met.mapInArrow(lambda batches: part_matches(batches, schema, limit), schema)


def met_by(prefix: str, cuts: list[tuple[str, str]]) -> range:
    """The parts that hold texts which begin with the prefix, if any do."""
    first = bisect_right(cuts, (prefix, ""))
    last = bisect_right(cuts, prefix, key=lambda c: c[0][:len(prefix)])
    return range(first, last + 1)


def part_of(cuts: list[tuple[str, str]]):
    @F.pandas_udf(T.IntegerType())
    def number(text, query):
        import pandas as pd

        return pd.Series([bisect_right(cuts, pair) for pair in zip(text, query)], dtype="int32")

    return number


def found_between(texts: list[str], asked: list[str], known: set[str]) -> Iterator[tuple[str, int, int]]:
    """(prefix, first, last + 1) of the prefixes that some of the sorted texts begin with."""
    if not texts:
        return
    low, high = texts[0], texts[-1]
    heads = [low[:n] for n in range(len(low)) if low[:n] in known]
    for prefix in heads + asked[bisect_left(asked, low):bisect_right(asked, high)]:
        first = bisect_left(texts, prefix)
        last = bisect_right(texts, prefix, lo=first, key=lambda t: t[:len(prefix)])
        if last > first:
            yield prefix, first, last


def emitted(rows: pa.RecordBatch | pa.Table, found: Iterator[tuple[str, int, int]], schema: T.StructType, limit: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of the ranges; with a limit the first by query of each."""
    names = [f.name for f in schema]
    place = None
    if limit is not None:
        queries = np.array(rows.column("query").to_pylist(), dtype=object)
        place = np.empty(len(queries), np.int64)
        place[np.argsort(queries, kind="stable")] = np.arange(len(queries))
    parts, prefixes, size = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        at = pa.array(np.concatenate(parts))
        body = rows.select(names[1:]).take(at)
        head = pa.array(np.repeat(np.array(prefixes, dtype=object), [len(p) for p in parts]).tolist(), pa.string())
        table = pa.Table.from_arrays([head, *[c if not isinstance(c, pa.ChunkedArray) else c.combine_chunks() for c in body.columns]], names)
        yield from table.to_batches(EMIT_ROWS)

    for prefix, first, last in found:
        while first < last:  # a short prefix may begin very many rows
            stop = last if limit is not None else min(last, first + EMIT_ROWS)
            at = np.arange(first, stop)
            if limit is not None and len(at) > limit:
                at = first + np.argpartition(place[first:stop], limit - 1)[:limit]
            parts.append(at)
            prefixes.append(prefix)
            size, first = size + len(at), stop
            if size >= EMIT_ROWS:
                yield from out()
                parts, prefixes, size = [], [], 0
    if parts:
        yield from out()


def sorted_matches(batches: Iterator[pa.RecordBatch], asked: list[str], schema: T.StructType, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Over batches of rows that are sorted by text within a part."""
    known = set(asked)
    for batch in batches:
        part = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                rows = batch.slice(a, b - a)
                texts = rows.column("text").to_pylist()
                if any(x > y for x, y in zip(texts, texts[1:])):  # a file that was split between tasks in another order
                    order = sorted(range(len(texts)), key=texts.__getitem__)
                    rows, texts = rows.take(pa.array(order)), [texts[i] for i in order]
                yield from emitted(rows, found_between(texts, asked, known), schema, limit)


def part_matches(batches: Iterator[pa.RecordBatch], schema: T.StructType, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Over rows (part, task, side, asked, text, query, ...): a part's texts in order, then the prefixes that meet it."""
    key, rows, held, texts = None, [], None, []
    for batch in batches:
        keys = list(zip(batch.column("part").to_pylist(), batch.column("task").to_pylist()))
        side = batch.column("side").to_numpy()
        start = 0
        while start < len(keys):
            stop = start
            while stop < len(keys) and keys[stop] == keys[start] and side[stop] == side[start]:
                stop += 1
            if keys[start] != key:
                key, rows, held, texts = keys[start], [], None, []
            if side[start] == 0:
                rows.append(batch.slice(start, stop - start))
            elif rows:
                if held is None:
                    held = pa.Table.from_batches(rows)
                    texts = held.column("text").to_pylist()
                asked = batch.column("asked").slice(start, stop - start).to_pylist()
                ranges = ((p, a, b) for p in asked for a in [bisect_left(texts, p)]
                          for b in [bisect_right(texts, p, lo=a, key=lambda t, n=len(p): t[:n])] if b > a)
                yield from emitted(held, ranges, schema, limit)
            start = stop


def edge_match(prefixes: DataFrame, pool: DataFrame | Dictionary, prefix: str = "prefix") -> DataFrame:
    """All pool rows whose query begins with the prefix, for prefixes of any length ('' matches none)."""
    held = pool if isinstance(pool, Dictionary) else Dictionary.build(pool)
    asked = prefixes.filter(F.length(prefix) > 0)
    found = held.begins(asked, prefix).drop("text")
    return found if prefixes.columns == [prefix] else asked.join(found, prefix)


def prefix_match(prefixes: DataFrame, pool: DataFrame | Dictionary, k: int = 20) -> DataFrame:
    """(prefix, query, rk): the first k queries in text order that begin with the prefix, for prefixes of any length ('' matches all).

    Both sides are compared in strict normal form; a Dictionary has that as its text.
    """
    held = pool if isinstance(pool, Dictionary) else Dictionary.build(pool.select("query"), normalize_strict("query"))
    p = distinct_prefixes(prefixes).withColumn("np", normalize_strict("prefix"))
    first = top_k(held.begins(p, "np", k).select("np", "query"), ["np"], [F.asc("query")], k)
    return p.join(first, "np").select("prefix", "query", "rk")
