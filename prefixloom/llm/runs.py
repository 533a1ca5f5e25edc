"""Periodic run detection in sequences of words, by string synchronising sets.

A run is a stretch of words with smallest period q and length of at least max(LEAST, 3 q) that cannot be
made longer without losing the period.

Method. At every dyadic scale t = 4, 8, 16, ... a word position is named by a hash of the next t words
(names of scale 2 t come from two names of scale t). Positions whose t words have a period of at most t / 3
are left out. A position i is selected if the smallest name among i .. i + t stands at i or at i + t. This
depends on the 2 t words from i only, so equal contexts are selected alike, and a run of period q with
1.5 t <= q < 3 t has a selected position i with another at i + q of equal context, since a stretch without
selected positions would have a period of at most t / 3. Equal contexts lie over t / 3 apart, so a position is
paired with few others below 3 t. Each pair proposes its distance as a period; the words themselves
are then compared as far as the period holds in both directions, so a result never rests on a hash.
Periods below the first scale's, and the left-out positions of the first scales, come from highly periodic
regions that are found by direct comparison at distances 1 to 5; left-out positions of later scales come
from the runs found before. A period that a stretch has beside a smaller one is no run of its own.

All texts of a slice are one sequence with a unique mark after each, so no run crosses texts and numpy works on
many texts at once. A text lies in one task; memory is about 150 bytes per word of the slice's longest.
There is no shuffle, so groups of copies do no harm.

Null texts and texts without words have no runs: null for the greatest run, digests of the empty string. Repeated rows get
equal results. An old column with the name of a new one is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, table, with_columns

LEAST = 24
DIRECT = 5  # periods compared directly; the first scale covers 6 to 11
FIRST = 4
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SLICE = 2 << 20


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def streaks(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def regions(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of a period, by direct comparison."""
    first, last = streaks(words[:-period] == words[period:])
    return first, last + period


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for every i."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(out) - (width - size)], out[width - size:]) if width > size else out


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether a position lies in one of the ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:n]) > 0


def selected(names: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising positions of a scale; periodic marks the positions that are left out."""
    ids = np.where(periodic[:len(names)], NONE, names)
    least = sliding_least(ids, scale + 1)
    i = np.arange(len(least))
    return np.flatnonzero((least != NONE) & ((ids[i] == least) | (ids[i + scale] == least)))


def proposals(names: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of pairs of selected positions with equal contexts, 1.5 to 3 scales apart."""
    context = mixed(names[at] * np.uint64(0x9E3779B97F4A7C15) + names[at + scale])
    order = np.lexsort((at, context))
    context, at = context[order], at[order]
    spots, periods = [], []
    step, near = 1, np.arange(max(len(at) - 1, 0))
    while len(near):
        near = near[near + step < len(at)]
        far = at[near + step] - at[near]
        alive = (context[near] == context[near + step]) & (far < 3 * scale)
        near, far = near[alive], far[alive]
        fits = 2 * far >= 3 * scale - 1
        spots.append(at[near[fits]])
        periods.append(far[fits])
        step += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + spots), np.concatenate(none + periods)


def reach(words: np.ndarray, i: int, period: int) -> tuple[int, int]:
    """The stretch of a period around i, where words[i] == words[i + period]: words are compared in growing blocks."""
    n, block, stop = len(words), 32, i
    while stop + period < n:
        end = min(stop + block, n - period)
        off = np.flatnonzero(words[stop:end] != words[stop + period:end + period])
        if len(off):
            stop += int(off[0])
            break
        stop, block = end, 2 * block
    block, start = 32, i
    while start > 0:
        first = max(0, start - block)
        off = np.flatnonzero(words[first:start] != words[first + period:start + period])
        if len(off):
            start = first + int(off[-1]) + 1
            break
        start, block = first, 2 * block
    return start, stop + period


def runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of word numbers, by start and period.

    ``longest`` bounds the length of a run from above (the longest text of a sequence of many).
    """
    words = np.ascontiguousarray(words, np.int64)
    n = len(words)
    longest = n if longest is None else min(longest, n)
    found: dict[tuple[int, int], int] = {}
    if longest < LEAST:
        return []
    short = []  # highly periodic regions of small periods
    for period in range(1, DIRECT + 1):
        first, last = regions(words, period)
        short.append((first, last))
        for a, b in zip(first[last - first >= LEAST].tolist(), last[last - first >= LEAST].tolist()):
            found.setdefault((a, b), period)
    names = mixed(words.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    size = 1
    while size < FIRST:
        names = mixed(names[:-size] * np.uint64(0x9E3779B97F4A7C15) + names[size:])
        size *= 2
    scale = FIRST
    while max(LEAST, (9 * scale - 3) // 2) <= longest and len(names) > scale:
        if scale < LEAST:  # from the regions of small periods
            parts = [(a[b - a >= scale], b[b - a >= scale]) for a, b in short[:scale // 3]]
            starts = np.concatenate([a for a, _ in parts] + [np.zeros(0, np.int64)])
            stops = np.concatenate([b for _, b in parts] + [np.zeros(0, np.int64)]) - scale + 1
        else:  # from the runs found so far, all of at most a third of the scale among them
            old = [(a, b) for (a, b), p in found.items() if 3 * p <= scale and b - a >= scale]
            starts = np.array([a for a, _ in old], np.int64)
            stops = np.array([b for _, b in old], np.int64) - scale + 1
        at = selected(names, scale, covered(n, starts, stops))
        spots, periods = proposals(names, at, scale)
        order = np.lexsort((spots, periods))
        done, period_of = -1, -1
        for i, period in zip(spots[order].tolist(), periods[order].tolist()):
            if period == period_of and i < done:
                continue  # in a stretch that was looked at
            if words[i] != words[i + period]:
                continue
            a, b = reach(words, i, period)
            done, period_of = b - period, period
            if b - a >= max(LEAST, 3 * period):
                found.setdefault((a, b), period)
        names = mixed(names[:-scale] * np.uint64(0x9E3779B97F4A7C15) + names[scale:])
        scale *= 2
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(start, length, period) of the run with the greatest length / period; ties by start, then period."""

    def order(x, y):
        return (y[1] - y[0]) * x[2] - (x[1] - x[0]) * y[2] or x[0] - y[0] or x[2] - y[2]

    if not found:
        return None
    a, b, p = min(found, key=cmp_to_key(order))
    return a, b - a, p


def by_text(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, numbered within the text."""
    number: dict[bytes, int] = {}
    parts = []
    for words in texts:
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    joined = []
    for mark, part in enumerate(parts):
        joined += [part, np.array([-1 - mark], np.int64)]
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if texts:
        for a, b, p in runs(np.concatenate(joined), max(map(len, parts))):
            text = int(np.searchsorted(starts, a, "right")) - 1
            first = int(starts[text])
            out[text].append((a - first, b - first, p))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    gone = covered(len(words), np.array([a + p for a, _, p in found]), np.array([b for _, b, _ in found]))
    return [w for w, g in zip(words, gone.tolist()) if not g]


COLUMNS = {
    "n_runs": T.LongType(), "start": T.LongType(), "length": T.LongType(), "period": T.LongType(), "exponent_milli": T.LongType(),
    "runs_sha256": T.StringType(), "collapsed_sha256": T.StringType(),
}


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the number of runs, the greatest one, and digests of all runs and of the collapsed text."""

    def compute(column: pa.Array) -> list:
        body, ends = flat(column)
        body = body.tobytes()
        texts = [body[a:b].split() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        rows = []
        for words, found in zip(texts, by_text(texts)):
            best = greatest(found)
            start, length, period = best or (None, None, None)
            lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in found)
            rows.append((len(found), start, length, period, 1000 * length // period if best else None,
                         hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
        return [list(c) for c in zip(*rows)]

    return with_columns(docs, text, COLUMNS, compute, SLICE)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array ``runs`` of all runs, each as start, length and period one after another."""

    def compute(column: pa.Array) -> list:
        body, ends = flat(column)
        body = body.tobytes()
        texts = [body[a:b].split() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [[[x for a, b, p in found for x in (a, b - a, p)] for found in by_text(texts)]]

    return with_columns(docs, text, {"runs": T.ArrayType(T.LongType())}, compute, SLICE)


def planted(text: Column, key: Column) -> Column:
    """The text in which, for a tenth of the keys, the words from one on repeat a stretch of theirs."""
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    h = F.crc32(key.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    # n is taken as 1 for texts without words, which have nothing to repeat
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")).otherwise(text)


def op13_runs(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    return described(docs).drop("text")
