"""Quality rules: counts of a text's words, symbols and repeats, and a log-likelihood ratio of n-grams.

Base counts follow from bytes: words are runs of bytes other than blank and \\x09-\\x0D. A text fails
the base if it has fewer than 10 words or over a fifth of its words lie in repeated 5-word windows.

The method's verdict: word unigrams and bigrams are hashed into 2**16 buckets. Two multinomials are
counted, one over all documents (raw) and one over all trusted ones (label ``quality`` 1), smoothed,
and their log ratio is rounded to an integer per bucket. A text's score is the mean ratio of its
n-grams; below THRESHOLD it is rejected. Integers make sums exact, so the verdict on a text does not
depend on partitions, and every document is judged alike: nothing is sampled.

Scale: two narrow passes over the texts. The first adds up counts in each task and ships at most one
row per bucket and task; the second gets the table of ratios (512 KB whatever the input). The trusted
ids are broadcast up to FEW_IDS of them, else joined by a shuffle. Words, windows and lines are
compared by 64-bit hashes.

Null and empty texts have no words and fail. Without trusted documents all ratios are 0. Repeated rows
count as often as they occur. Old columns with the names of new ones are replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, flat, slices, table, with_columns

BITS = 16
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent
SMOOTHING = 1.0
THRESHOLD = -0.15
UNIT = 1 << 20  # ratios are integers of this fraction
FEW_IDS = 500_000  # ids of trusted documents that are broadcast: 8 MB at 16 bytes a row; beyond, both sides are shuffled
SYMBOLS = b"#*$%&|<>"
STEP = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, stop), none of them empty, in order and apart."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = stops - starts
    power = np.multiply.accumulate(np.full(int(size.max()), STEP, np.uint64))
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = power[at] * (body[np.repeat(starts, size) + at] + np.uint64(1))
    return mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))


class Words:
    """The words of the texts in one slice."""

    def __init__(self, column: pa.Array):
        self.body, self.ends = flat(column)
        body = self.body
        self.gap = (body == 32) | ((body >= 9) & (body <= 13))
        edge = np.ones(len(body) + 1, bool)  # whether what stands before a byte belongs to another word
        edge[1:] = np.concatenate([self.gap[:-1], [True]]) if len(body) else True
        edge[self.ends] = True
        self.starts = np.flatnonzero(edge[:-1] & ~self.gap)
        after = np.concatenate([self.gap[1:], [True]]) if len(body) else np.zeros(0, bool)
        after = after | edge_of(self.ends, len(body))
        self.stops = np.flatnonzero(~self.gap & after) + 1
        self.hashes = run_hashes(body, self.starts, self.stops)
        self.bounds = np.searchsorted(self.starts, self.ends)  # words before each text
        self.counts = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(len(column)), self.counts)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the unigrams and of the bigrams; a bigram stands at its first word, -1 where none does."""
        shift = np.uint64(64 - BITS)
        one = (self.hashes >> shift).astype(np.int64)
        two = np.full(len(one), -1, np.int64)
        if len(one) > 1:
            both = (mixed(self.hashes[:-1] * np.uint64(3) + self.hashes[1:]) >> shift).astype(np.int64)
            two[:-1] = np.where(self.owner[:-1] == self.owner[1:], both, -1)
        return one, two

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums by text of one number per byte."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def per_text_of_words(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def repeated_words(self) -> np.ndarray:
        """Words by text that lie in a window found twice or more in it."""
        n = len(self.hashes) - WINDOW + 1
        if n < 1:
            return np.zeros(len(self.counts), np.int64)
        window = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(STEP) + self.hashes[k:k + n]
        inside = np.flatnonzero(self.owner[:n] == self.owner[WINDOW - 1:])
        key = mixed(window[inside] + self.owner[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        twice = inside[among_equals(key)]
        cover = np.zeros(len(self.hashes) + 1, np.int64)
        cover[twice] += 1
        np.add.at(cover, twice + WINDOW, -1)
        return self.per_text_of_words(np.cumsum(cover)[:-1] > 0)

    def repeated_lines(self) -> np.ndarray:
        """Lines by text that have a word and equal an earlier line."""
        marks = np.flatnonzero(self.body == 10)
        starts = np.unique(np.concatenate([self.ends[:-1], marks + 1]))
        starts = starts[starts < len(self.body)]
        last = np.concatenate([starts[1:], [len(self.body)]]) if len(starts) else starts
        stops = last - (self.body[np.maximum(last, 1) - 1] == 10)  # without the line's end
        word = np.searchsorted(self.starts, starts)
        has_word = (word < np.searchsorted(self.starts, stops)) & (stops > starts)
        starts, stops = starts[has_word], stops[has_word]
        owner = np.searchsorted(self.ends, starts, "right") - 1
        key = mixed(run_hashes(self.body, starts, stops) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        again = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, bool)
        return np.bincount(owner[order][again], minlength=len(self.counts))


def edge_of(ends: np.ndarray, n: int) -> np.ndarray:
    """Marks the last byte of every text."""
    out = np.zeros(n, bool)
    last = ends[1:] - 1
    out[last[(last >= 0) & (ends[1:] > ends[:-1])]] = True
    return out


def among_equals(key: np.ndarray) -> np.ndarray:
    """Indices of the keys that occur twice or more."""
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    flag = np.zeros(len(key), bool)
    flag[1:] |= same
    flag[:-1] |= same
    return order[flag]


def ngram_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, raw, trusted) over all documents and all whose label ``quality`` is 1."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    trusted = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    if trusted.limit(FEW_IDS + 1).count() <= FEW_IDS:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    marked = rows.join(trusted, rows["_key"] == trusted["_id"], "left").select("_text", F.col("_id").isNotNull().alias("_trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                flags = part.column("_trusted").to_numpy(zero_copy_only=False)[words.owner]
                for grams in words.buckets():
                    raw += np.bincount(grams[grams >= 0], minlength=1 << BITS)
                    good += np.bincount(grams[(grams >= 0) & flags], minlength=1 << BITS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "trusted"])

    counted = marked.mapInArrow(run, "bucket long, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def ratios(counts: DataFrame) -> np.ndarray:
    """Rounded log ratios by bucket; at most 2**16 rows reach the driver."""
    got = counts.toPandas()
    raw, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[got["bucket"]], good[got["bucket"]] = got["raw"], got["trusted"]
    if not good.sum():
        return np.zeros(1 << BITS, np.int64)
    of = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return np.round((of(good) - of(raw)) * UNIT).astype(np.int64)


def judged(docs: DataFrame, table_of_ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base counts, base_failed, score and kept."""
    limit = math.floor(threshold * UNIT)

    def compute(column: pa.Array) -> list:
        words = Words(column)
        body = words.body
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        one, two = words.buckets()
        values = table_of_ratios[one] + np.where(two >= 0, table_of_ratios[two], 0)
        total = words.per_text_of_words(values)
        grams = words.counts + words.per_text_of_words(two >= 0)
        repeated = words.repeated_words()
        failed = (words.counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words.counts)
        good = ~failed & (total >= limit * grams)
        score = total / np.maximum(grams, 1) / UNIT
        new = [words.counts, words.per_text(~words.gap & ((body & 0xC0) != 0x80)), words.per_text(symbol[body]),
               words.repeated_lines(), repeated, failed, score, good]
        return [pa.array(x) for x in new]

    kinds = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), T.LongType())
    kinds |= {"base_failed": T.BooleanType(), "score": T.DoubleType(), "kept": T.BooleanType()}
    return with_columns(docs, text, kinds, compute)


def op9_rules(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learnt = ratios(ngram_counts(docs, table(spark, folder, "labels")))
    return judged(docs, learnt).drop("text")
