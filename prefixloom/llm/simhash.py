"""SimHash near-duplicates: pigeonring filtering of 64-bit fingerprints, then connected components.

Fingerprint. A-Z become lower case, words are runs of bytes other than blank and \\x09-\\x0D, a
shingle is four words joined by blanks (a shorter text is one shingle). A bit is set if more than
half of the shingles' XXH64 values (seed 42) have it set. A text without words has fingerprint 0.

Links. Fingerprints link at up to 4 differing bits. The 64 bits are a ring of five segments. If two
fingerprints differ in at most 4 bits, some segment starts a chain whose first n segments differ in
at most 4 n / 5 bits together, for every n: none in the first, one in the first two, two in the
first three, three in the first four. The first two conditions are an equality: the first segment
is equal, and the second is equal after one of its bits is cleared. So every distinct fingerprint is
dealt out once per (segment, cleared bit), 64 rows, and only fingerprints with an equal key are
compared, first along the rest of the chain, then in full.

Scale. Copies collapse to one fingerprint before anything is dealt out. A key's fingerprints are
never paired up: a task walks through them, and what a visited fingerprint reaches leaves the set of
those still to be visited, so a group of thousands of near copies costs few comparisons for each and
gives fewer links than it has members. The fingerprints of a key with more than SPLIT of them are dealt out again by
the third segment of their chain (which may differ in two bits: once per pair of bits cleared) and, where that
is still more, by the fourth (three bits). Then the segments leave 2**18 fingerprints at the most, however large
the input. Keys with more than SPLIT are a written table that is joined, never a list on the driver. Components come from label propagation over the links, in rounds that are
written to the shared folder.

Null texts count as empty; they and all other texts without words share fingerprint 0 and are linked.
Rows with a null doc_id are linked like others, but their id cannot be a component's. Repeated rows
keep their number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, fresh, table, with_columns, written

WORDS = 4
SEED = 42
NEAR = 4
WIDTHS = (13, 13, 13, 13, 12)  # bits of the segments, from the lowest
SPLIT = 20_000
START = 60  # a key's highest bits: where on the ring its chain starts
SHORT = 24  # keys of up to so many fingerprints are compared without a walk


def fingerprint(data: bytes) -> int:
    """The 64-bit fingerprint of one text."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[WORDS - 1:] if len(words) >= WORDS else ends[-1:]
    first = np.concatenate([[0], ends[:len(last) - 1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start:start + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of every whole text as a long; an old column ``out`` is replaced."""

    def compute(column: pa.Array) -> list:
        body, ends = flat(column)
        body = body.tobytes()
        got = [fingerprint(body[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [pa.array(np.array(got, np.uint64).view(np.int64))]

    return with_columns(docs, text, {out: T.LongType()}, compute)


def segments() -> list[tuple[int, int]]:
    """(lowest bit, mask of the width) of the segments."""
    low = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    return [(a, (1 << w) - 1) for a, w in zip(low, WIDTHS)]


def chain_keys(fp: Column) -> Column:
    """An array of long keys: ring start, cleared bit, first segment, second without that bit."""
    ring, keys = segments(), []
    for i, (a, mask) in enumerate(ring):
        b, second = ring[(i + 1) % len(ring)]
        head = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(mask))
        tail = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(second))
        for bit in range(WIDTHS[(i + 1) % len(ring)]):
            cleared = tail.bitwiseAND(F.lit(second & ~(1 << bit)))
            tag = F.lit((i << START) + (bit << 32))
            keys.append(tag.bitwiseOR(F.shiftleft(head, 16)).bitwiseOR(cleared))
    return F.array(*keys)


def clearing(bits: int) -> list[int]:
    """Masks of 13 bits that clear so many: values that differ in no more agree under one of them."""
    return [0x1FFF & ~sum(1 << b for b in some) for some in combinations(range(13), bits)]


def reached(one: np.uint64, others: np.ndarray, start: int, near: int = NEAR) -> np.ndarray:
    """Which of the others link to one: along the chain from a ring start, then in full.

    A pair whose chain is broken here has another start with a whole one, under another key.
    """
    ring = segments()
    diff = others ^ one
    spent = np.zeros(len(others), np.int16)
    alive = np.ones(len(others), bool)
    for n in range(len(ring)):
        low, mask = ring[(start + n) % len(ring)]
        spent += np.bitwise_count((diff >> np.uint64(low)) & np.uint64(mask))
        alive &= spent * len(ring) <= near * (n + 1)
    return alive


def group_links(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one key's distinct fingerprints (a spanning forest)."""
    links, waiting = [], members
    while len(waiting) > 1:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            one = queue.pop()
            hit = reached(one, waiting, start)
            if hit.any():
                found = waiting[hit]
                links.extend((int(one), int(x)) for x in found)
                queue.extend(found)
                waiting = waiting[~hit]
    return links


def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, fp) sorted by key to links (a, b); the last key of a batch waits for the next."""
    rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def walk(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = stops - starts
        left, right = [], []
        # short keys, all of them at once: each row against the next, the one after it, ...
        short = np.repeat(size <= SHORT, size)
        key_of, fp_of = key[short], fp[short]
        for step in range(1, SHORT):
            rows = np.flatnonzero(key_of[step:] == key_of[:-step])
            if not len(rows):
                break
            for start in range(len(WIDTHS)):
                own = rows[key_of[rows] >> START == start]
                hit = own[reached(np.uint64(0), fp_of[own] ^ fp_of[own + step], start)]
                left.append(fp_of[hit])
                right.append(fp_of[hit + step])
        for i in np.flatnonzero(size > SHORT):
            found = group_links(fp[starts[i]:stops[i]], int(key[starts[i]] >> START))
            if found:
                left.append(np.array([x for x, _ in found], np.uint64))
                right.append(np.array([x for _, x in found], np.uint64))
        none = [np.zeros(0, np.uint64)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(none + side).view(np.int64)) for side in (left, right)], ["a", "b"])

    for batch in batches:
        key = np.concatenate([rest_key, batch.column("key").to_numpy()])
        fp = np.concatenate([rest_fp, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(key):
            continue
        done = int(np.searchsorted(key, key[-1]))
        if done:
            yield walk(key[:done], fp[:done])
        rest_key, rest_fp = key[done:], fp[done:]
    if len(rest_key):
        yield walk(rest_key, rest_fp)


def large_keys(rows: DataFrame, split: int) -> DataFrame | None:
    """The keys with more than ``split`` rows as a written table; None if there are none."""
    large = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("key"))
    return large if large.limit(1).count() else None


def dealt_again(rows: DataFrame, segment: int, bits: int) -> DataFrame:
    """(key, fp) dealt out by the segment'th segment of the key's chain, once per choice of bits cleared in it."""
    ring, start = segments(), F.shiftright("key", START)
    own = F.lit(0).cast("long")
    for i in range(len(ring)):
        low, mask = ring[(i + segment) % len(ring)]
        own = F.when(start == i, F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask))).otherwise(own)
    masks = F.array(*[F.lit(m) for m in clearing(bits)])
    parts = rows.select("fp", "key", own.alias("own"), F.posexplode(masks).alias("which", "mask"))
    mixed = F.xxhash64("key", "which", F.col("own").bitwiseAND(F.col("mask"))).bitwiseAND(F.lit((1 << START) - 1))
    return parts.select(F.shiftleft(start.cast("long"), START).bitwiseOR(mixed).alias("key"), "fp")


def links(prints: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b), a < b, that connect the distinct fingerprints ``fp`` wherever they are connected.

    A key with more than ``split`` fingerprints is dealt out again by the next segments of its chain.
    """
    dealt = prints.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp")
    # a key is no larger than its (ring start, first segment), of which there are at most 40,960: one narrow count tells
    # whether any key can be large, and only keys below a large one are counted themselves
    heads = F.array(*[F.lit(i << 13).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask)))
                      for i, (low, mask) in enumerate(segments())])
    rows, parts = dealt, []
    maybe = large_keys(prints.select(F.explode(heads).alias("key")), split)
    if maybe is not None:
        head = F.shiftright("key", START) * 8192 + F.shiftright("key", 16).bitwiseAND(F.lit(0x1FFF))
        below = dealt.withColumn("head", head).join(F.broadcast(maybe.withColumnRenamed("key", "head")), "head", "left_semi")
        large = large_keys(below.select("key", "fp"), split)
        for segment, bits in ((2, 2), (3, 3)):
            if large is None:
                break
            parts.append(rows.join(large, "key", "left_anti"))
            rows = dealt_again(rows.join(large, "key", "left_semi"), segment, bits)
            if segment == 2:
                rows = written(rows)  # read for the counts, the small keys and the large ones
                large = large_keys(rows, split)
    found = walked(rows)
    for part in parts:
        found = found.unionByName(walked(part))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def walked(dealt: DataFrame) -> DataFrame:
    """Links within the keys, each of which lies in one task."""
    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    sorted_rows = dealt.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return sorted_rows.mapInArrow(link_rows, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, label): the smallest label of a connected component, from nodes (fp, label) and links (a, b).

    Only linked nodes take part in the rounds. Each round, a node takes the smallest label among
    itself and its neighbours, then the smallest label that the holder of the old label took (so
    labels travel in jumps). Ends when nothing changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    ends = both.select(F.col("a").alias("fp")).distinct()
    # the label of a node is the fingerprint it points to; doc_ids are looked at in the end only
    state = written(ends.select("fp", F.col("fp").alias("root")))
    for _ in range(rounds):
        best = both.join(state.select(F.col("fp").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = state.join(best.withColumnRenamed("a", "fp"), "fp").select(
            "fp", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        moved = hooked.groupBy("old").agg(F.min("new").alias("jump"))
        after = hooked.join(moved, "old").select("fp", "old", F.least("new", "jump").alias("root"))
        seen = Observation()  # counted while the round is written
        state = written(after.observe(seen, F.count_if(F.col("root") != F.col("old")).alias("changed"))).select("fp", "root")
        if not seen.get["changed"]:
            break
    else:
        raise RuntimeError("labels still change after the last round")
    known = nodes.join(state, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "label")
    least = known.groupBy("root").agg(F.min("label").alias("least"))
    return known.join(least, "root").select("fp", "root", F.col("least").alias("label"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, fp, component (the smallest key reachable), root, text_hash.

    root names the component also where no row of it has a key.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("text_hash"))
    marked = written(fingerprints(rows, "_text", "fp").drop("_text"))
    nodes = written(marked.groupBy("fp").agg(F.min("_key").alias("label")))
    labels = written(components(nodes, links(nodes.select("fp"))))
    # a hot fingerprint's rows: both sides are plain, so AQE can split a large partition
    return marked.join(labels, "fp").select(F.col("_key").alias(key), "fp", F.col("label").alias("component"), "root", "text_hash")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the smallest key of each near-duplicate class; of repeated rows one stays."""
    classes = near_classes(docs, key, text)
    first = F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("_key"), F.col("text_hash").alias("_hash")))
    kept = classes.groupBy("root").agg(first.alias("first")).select("first._key", "first._hash")
    own, copy, kept_key = fresh("hash", "copy", "key")  # beside columns of any name
    rows = docs.withColumn(own, F.xxhash64(F.col(f"`{text}`")))
    kept = kept.select(F.col("_key").alias(kept_key), F.col("_hash").alias("text_hash"))
    match = rows[key].eqNullSafe(kept[kept_key]) & (rows[own] == kept["text_hash"])
    same = Window.partitionBy(key, own).orderBy(own)
    only = rows.join(kept, match, "left_semi").withColumn(copy, F.row_number().over(same)).filter(F.col(copy) == 1)
    return only.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_classes(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
