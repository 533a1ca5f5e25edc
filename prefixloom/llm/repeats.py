"""Exact substring dedup: bytes covered by a string of 400 bytes that also starts elsewhere.

This takes from bucket-pointer refinement that buckets of suffixes are refined by identifiers of later offsets, but it is
not that method: identifiers are 64-bit hash names in place of numbers of sorted buckets, and suffixes at anchors alone
are compared, since numbering the buckets of a whole corpus would shuffle all suffixes in each round. A bucket is a set of
suffixes that agree on their first bytes. The names of 8-byte grams come first; the name of twice the length
is made of the names at a position and at the later offset where the first half ends, so every doubling
uses the identifiers of the one before, up to 256 bytes.

Only some suffixes have to be compared. The anchor of a 400-byte window is its 64-byte gram with the
smallest name (the leftmost of equals). Equal windows have equal anchors at equal offsets, and there is one
anchor to about 180 bytes. The suffixes at anchors are the initial buckets, by their 64-byte names.
A bucket of one is done: none of its windows occurs twice. The others are refined in three steps, each by
names of what lies at other offsets, and each only within the buckets the step before left open:

1. by all the text that the anchor's windows cover: where that is equal, all its windows are repeated;
2. for each BLOCK of neighbouring windows, by the text common to them (the core) and then all their text;
3. where only the core is equal, for each window, by the core's bucket and the margins the window has.

Names are compared by Spark's shuffles. A bucket is never brought together: each step counts names with
partial sums in the map tasks, and one suffix of each class of equals goes on to the next, so copies in
any number cost a count. Memory in a task is bounded by a slice of texts; texts are not cut (of one longer
than a slice, names take about 100 bytes a byte).

Null texts are empty; texts of under 400 bytes have no window. Rows are told apart by a number given at
the start, so null or repeated ids are kept as they are: equal rows remove each other's text. Old columns
with the names of new ones are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, flat, fresh, slices, table, written

LENGTH = 400
GRAM = 64
NAME = 256  # longest name
BLOCK = 32
CORE = LENGTH - BLOCK + 1
MARGIN = BLOCK - 1
PLACE_BITS = 31  # no row holds a longer text
SLICE = 1 << 21  # bytes of texts that a task names together; names take 8 bytes a byte
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of a text from the names of two of its parts, in order."""
    h = left * A ^ (right + B) * C
    h ^= h >> np.uint64(32)
    h *= B
    return h ^ (h >> np.uint64(29))


def names(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the GRAM and of the NAME bytes from every position on; body is followed by NAME zeros."""
    n = len(body)
    padded = np.concatenate([body, np.zeros(NAME + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + NAME, 8), (1, 1))
    h = np.ascontiguousarray(words).view(np.uint64).ravel()
    size, gram = 8, None
    while size < NAME:
        h = joined(h[:-size], h[size:])
        size *= 2
        if size == GRAM:
            gram = h[:n]
    return gram, h[:n]


def anchors(gram: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, last window): positions in the slice, windows by their starts."""
    n, span = len(gram), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    place = np.uint64((1 << PLACE_BITS) - 1)
    key = (gram & ~place) | np.arange(n, dtype=np.uint64)  # of equals the leftmost is the smallest
    padded = np.concatenate([key, np.full(-n % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n - span + 1], before[span - 1:n])
    least &= place
    # windows that lie within one text
    sizes = np.maximum(np.diff(ends) - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + ends[owner]
    anchor = least[window].astype(np.int64)
    if not len(window):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([new[1:], [len(window)]]) - 1
    return owner[new], anchor[new], window[new], window[last]


def whole_names(name: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Names of all the text of the windows from first to last: at most three NAMEs long."""
    stop = last + LENGTH - NAME
    both = joined(name[first], name[np.minimum(first + NAME, stop)])
    return joined(both, name[stop]) + (last - first).astype(np.uint64)


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, text) to (row, anchor, near, far, gram, whole): near and far are the least and the largest
    number of bytes between a window's start and its anchor."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            body, ends = flat(part.column("text"))
            gram, name = names(body)
            owner, anchor, first, last = anchors(gram, ends)
            row = part.column("row").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([
                pa.array(row), pa.array((anchor - ends[owner]).astype(np.int32)), pa.array((anchor - last).astype(np.int32)),
                pa.array((anchor - first).astype(np.int32)), pa.array(gram[anchor].view(np.int64)),
                pa.array(whole_names(name, first, last).view(np.int64))], ["row", "anchor", "near", "far", "gram", "whole"])


def margins(body: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """MARGIN bytes from each start on; bytes outside [low, high) are zero."""
    at = start[:, None] + np.arange(MARGIN)
    inside = (at >= low[:, None]) & (at < high[:, None])
    rows = np.where(inside, body[np.clip(at, 0, len(body) - 1)], 0).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(MARGIN), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, text, open) to blocks of windows: (row, anchor, from, to, need, core, full, left, right).

    open: array of (anchor, near, far, gram, need). from and to bound the distances that the block has here.
    """
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            body, ends = flat(part.column("text"))
            _, name = names(body)
            lists = part.column("open")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            items = lists.flatten()
            anchor, near, far, gram = (items.field(c).to_numpy() for c in ("anchor", "near", "far", "gram"))
            need = items.field("need").to_numpy(zero_copy_only=False)
            low, high = near // BLOCK, far // BLOCK
            count = (high - low + 1).astype(np.int64)
            of = np.repeat(np.arange(len(anchor)), count)
            block = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
            own = owner[of]
            start = ends[own] + anchor[of] - BLOCK * block  # where the core starts
            core = joined(joined(name[start], name[start + CORE - NAME]), joined(gram[of].view(np.uint64), block.astype(np.uint64)))
            begin, stop = ends[own], ends[own + 1]
            # a short margin at an end of the text counts by its length too
            have = np.minimum(start - begin, MARGIN) * BLOCK + np.minimum(stop - start - CORE, MARGIN)
            left, right = margins(body, start - MARGIN, begin, stop), margins(body, start + CORE, begin, stop)
            yield pa.RecordBatch.from_arrays([
                pa.array(part.column("row").to_numpy()[own]), pa.array(anchor[of]),
                pa.array(np.maximum(near[of], block * BLOCK).astype(np.int32)),
                pa.array(np.minimum(far[of], block * BLOCK + MARGIN).astype(np.int32)), pa.array(need[of]),
                pa.array(core.view(np.int64)), pa.array(have.astype(np.int32)), left, right],
                ["row", "anchor", "from", "to", "need", "core", "have", "left", "right"])


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that broadcasts neither: Spark takes exploded windows, filtered classes and compressed files for
    smaller than they are, and a table just below its broadcast threshold would fill the driver."""
    return df.hint("merge")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(row, first, last): runs of starts of windows that also start elsewhere, from (row, text)."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    found = written(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(
        anchor_rows, "row long, anchor int, near int, far int, gram long, whole long"))

    # step 1
    same = ("gram", "near", "far", "whole")
    classes = written(found.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("row", "anchor")).alias("one")))
    grams = classes.groupBy("gram").agg(F.sum("n").alias("of_gram"), F.count("*").alias("kinds"))
    open_classes = classes.join(by_shuffle(grams.filter("of_gram > 1")), "gram")
    alike = written(open_classes.select(*same, "n", "kinds", "one"))
    whole = found.join(by_shuffle(alike.filter("n > 1").select(*same)), [*same]).select(
        "row", (F.col("anchor") - F.col("far")).alias("first"), (F.col("anchor") - F.col("near")).alias("last"))

    # step 2: one suffix of each class where a bucket has more than one class
    single = alike.filter("kinds > 1").select(
        F.col("one.row").alias("row"), F.struct("one.anchor", "near", "far", "gram", (F.col("n") == 1).alias("need")).alias("open"))
    lists = single.groupBy("row").agg(F.collect_list("open").alias("open"))  # at most a text's own anchors
    blocks = written(texts.join(by_shuffle(lists), "row").select("row", "text", "open").mapInArrow(
        block_rows, "row long, anchor int, from int, to int, need boolean, core long, have int, left binary, right binary"))
    full = ("core", "have", "left", "right")
    kinds = blocks.groupBy(F.col("core"), F.xxhash64("core", "have", "left", "right").alias("full")).agg(F.count("*").alias("n"))
    kinds = written(kinds)
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).filter("kinds > 1 or most > 1")
    marked = blocks.withColumn("full", F.xxhash64(*full)).join(
        by_shuffle(kinds.join(by_shuffle(cores.select("core", "kinds")), "core")), ["core", "full"])
    marked = written(marked)
    equal = marked.filter("need and n > 1").select(
        "row", (F.col("anchor") - F.col("to")).alias("first"), (F.col("anchor") - F.col("from")).alias("last"))

    # step 3: one block of each kind, window by window
    distance = F.explode(F.sequence("from", "to"))
    windows = marked.filter("kinds > 1").select("row", "anchor", "need", "n", "core", "full", "left", "right", distance.alias("far"))
    inner = F.col("far") % BLOCK  # bytes of the left margin that the window has
    name = F.xxhash64("core", inner, F.substring(F.col("left"), MARGIN + 1 - inner, inner), F.substring(F.col("right"), F.lit(1), MARGIN - inner))
    named = windows.select("row", "anchor", "need", "n", "full", "far", name.alias("name"))
    counted = named.groupBy("name", "full").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("*").alias("kinds"))
    some = named.filter("need and n = 1").join(by_shuffle(counted.filter("kinds > 1").select("name")), "name").select(
        "row", (F.col("anchor") - F.col("far")).alias("first"), (F.col("anchor") - F.col("far")).alias("last"))
    return whole.unionByName(equal).unionByName(some)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, text, runs) to (row, n_removed, n_spans, kept_sha256, kept)."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            body, ends = flat(part.column("text"))
            rows = []
            for i, runs in enumerate(part.column("runs")):
                text = body[ends[i]:ends[i + 1]]
                cover = np.zeros(len(text) + 1, np.int32)
                first, last = (runs.values.field(c).to_numpy() for c in ("first", "last"))
                np.add.at(cover, first, 1)
                np.add.at(cover, last + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = text[~gone].tobytes()
                rows.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                ["row", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, text: str = "text", kept: str | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256; with ``kept``, also the bytes that stay."""
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([kept] if kept else [])]
    own = [c for c in docs.columns if c not in added]
    row, body, sha, every = fresh("row", "body", "sha", "all")  # beside columns of any name
    columns = [F.col(f"`{c}`") for c in own] + [F.monotonically_increasing_id().alias(row)]
    if text in own and dict(docs.dtypes)[text] == "string":
        body = text  # the text is written once
    else:
        columns.append(F.col(f"`{text}`").cast("string").alias(body))
    numbered = written(docs.select(*columns))
    whole = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    texts = numbered.select(F.col(row).alias("row"), whole.alias("text"))
    runs = written(repeated_windows(texts)).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    changed = texts.join(by_shuffle(runs), "row").select("row", "text", "runs").mapInArrow(
        cut, "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    new = dict(zip(("n_removed", "n_spans", "kept_sha256", "kept"), fresh("n_removed", "n_spans", "sha256", "kept")))
    if not kept:
        new.pop("kept")
    changed = changed.select(F.col("row").alias(row), *[F.col(c).alias(n) for c, n in new.items()])
    parts = numbered.withColumn(sha, F.sha2(whole, 256)).withColumn("n_bytes", F.octet_length(whole).cast("long"))
    if kept:
        parts = parts.withColumn(every, F.encode(whole, "UTF-8"))
    out = parts.join(by_shuffle(changed), row, "left")
    final = [F.coalesce(new[c], F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    final.append(F.coalesce(new["kept_sha256"], sha).alias("kept_sha256"))
    if kept:
        final.append(F.coalesce(new["kept"], every).alias(kept))
    return out.select(*[F.col(f"`{c}`") for c in own], "n_bytes", *final)


def op3_repeats(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return without_repeats(docs).drop("text")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i AS start, md5(b[i:i + 399]) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS u(i)),
again AS (SELECT r, start FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
edges AS (SELECT r, start, start > coalesce(lag(start) OVER (PARTITION BY r ORDER BY start), -1000) + 400 AS fresh FROM again),
runs AS (SELECT r, min(start) AS a, max(start) + 400 AS z FROM (
  SELECT r, start, sum(fresh::INT) OVER (PARTITION BY r ORDER BY start) AS run FROM edges) GROUP BY r, run),
kept AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM runs
  UNION ALL SELECT r, max(z), max(octet_length(b)) + 1 FROM runs JOIN d USING (r) GROUP BY r
  UNION ALL SELECT r, 1, octet_length(b) + 1 FROM d WHERE r NOT IN (SELECT r FROM runs)),
parts AS (SELECT r, string_agg(CASE WHEN z > kept.a THEN hex(b[kept.a:z - 1]) ELSE '' END, '' ORDER BY kept.a) AS x FROM kept JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(z - a)::BIGINT AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(x)) AS kept_sha256
FROM d JOIN parts USING (r) LEFT JOIN sums USING (r)
"""
