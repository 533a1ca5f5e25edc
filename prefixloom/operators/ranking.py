"""Top-k, exact order statistics, samples and splits without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_hash

# orderBy().limit(n) keeps n rows per task and merges them in one task
SMALL_LIMIT = 10_000
# rank error of percentile_approx is 1/ACCURACY of the rows
ACCURACY = 10_000
GRID = [i / 2_000 for i in range(2_001)]
SORT_ROWS = 2_000_000


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rk") -> DataFrame:
    """The first k rows per key, numbered from 1.

    Spark places a WindowGroupLimit before and after the exchange, so each map
    task ships at most k rows per key, however hot the key is.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best(score: str = "score", tie: str = "query") -> list[Column]:
    return [F.desc(score), F.asc(tie)]


def ranked_values(
    df: DataFrame, columns: Sequence[str], targets: Sequence[float], weight: str | None = None
) -> dict[str, list[float]]:
    """Exact values at 0-based fractional positions targets*(n-1), per numeric column; nulls come first.

    Linear interpolation between neighbours. A handful of numbers per column comes back to the driver. A row stands for
    ``weight`` rows, a column of whole numbers; such rows are counted per distinct value at once.
    """
    found = [_ranked(df, columns, t, weight) for t in targets]
    return {c: [one[c] for one in found] for c in columns}


def _ranked(df: DataFrame, columns: Sequence[str], target: float, weight: str | None = None) -> dict[str, float]:
    """Each round percentile_approx brackets the position among the rows still inside a column's bracket,
    within its guaranteed rank error, and the rows below and inside are counted exactly. When few are left,
    they are counted per distinct value and sorted, one window per column."""
    n = df.count() if weight is None else df.agg(F.sum(weight)).first()[0]
    if not n:
        return {c: float("nan") for c in columns}
    at = target * (n - 1)
    first, second = int(at), min(int(at) + 1, n - 1)
    edge: dict[str, tuple[float | None, float | None]] = {c: (None, None) for c in columns}
    below, inside, enough = dict.fromkeys(columns, 0), dict.fromkeys(columns, n), 2 * ACCURACY

    def within(c: str) -> Column:
        lo, hi = edge[c]
        v = F.col(c).cast("double")
        ok = F.lit(True) if lo is None else F.coalesce(v >= F.lit(lo), F.lit(False))
        return ok if hi is None else ok & F.coalesce(v <= F.lit(hi), F.lit(True))

    while wide := [c for c in columns if weight is None and inside[c] > enough]:
        aggs = []
        for c in wide:
            slack = 3.0 / ACCURACY + 3.0 / inside[c]
            shares = [max((first - below[c]) / inside[c] - slack, 0.0), min((second - below[c]) / inside[c] + slack, 1.0)]
            aggs.append(F.percentile_approx(F.when(within(c), F.col(c).cast("double")), shares, ACCURACY).alias(c))
        got = df.agg(*aggs).first()
        before = dict(edge)
        for c in wide:
            slack = 3.0 / ACCURACY + 3.0 / inside[c]
            lo, hi = got[c] if got[c] is not None else (None, None)
            # the ends of a bracket are its smallest and largest value only up to the rank error
            edge[c] = (edge[c][0] if (first - below[c]) / inside[c] <= slack else lo,
                       edge[c][1] if (second - below[c]) / inside[c] >= 1 - slack else hi)
        counts = df.agg(*[x for c in wide for x in (
            F.count_if(within(c)).alias(f"in_{c}"),
            (F.lit(0) if edge[c][0] is None else F.count_if(F.col(c).isNull() | (F.col(c) < F.lit(edge[c][0])))).alias(f"below_{c}"))]).first()
        for c in wide:
            inside[c], below[c] = counts[f"in_{c}"], counts[f"below_{c}"] or 0
        enough = SORT_ROWS
        if before == edge:
            break  # one value fills the brackets; counting per value is small

    times = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(times.alias("times"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"), within(c).alias("used")) for c in columns])).alias("e")).select("times", "e.*")
    counts = rows.filter("used").groupBy("name", "v").agg(F.sum("times").alias("c"))
    w = Window.partitionBy("name").orderBy(F.asc_nulls_first("v"))
    upto = counts.withColumn("upto", F.sum("c").over(w))
    wanted = [(c, side, pos - below[c]) for c in columns for side, pos in (("lo", first), ("hi", second))]
    spots = df.sparkSession.createDataFrame(wanted, "name string, side string, pos long")
    joined = upto.join(F.broadcast(spots), "name").filter(
        (F.col("pos") < F.col("upto")) & (F.col("pos") >= F.col("upto") - F.col("c"))
    )
    hit = {(r["name"], r["side"]): r["v"] for r in joined.select("name", "side", "v").collect()}
    out = {}
    for c in columns:
        a, b = hit[c, "lo"], hit[c, "hi"]
        out[c] = a if at == first or a == b else a + (b - a) * (at - first)
    return out


def kth_smallest(df: DataFrame, column: str, position: Callable[[int], int]) -> tuple[float | None, int]:
    """(value at 0-based position(n), n) of a numeric column; value None if out of range.

    Each round reads the rows once and brackets the position on a quantile grid;
    when few enough rows are left in the bracket, those are sorted.
    """
    c = F.col(column)
    lo = hi = None
    total = target = 0
    while True:
        inside = F.lit(True) if lo is None else (c >= F.lit(lo)) & (c <= F.lit(hi))
        below_here = F.lit(0) if lo is None else F.count_if(c < F.lit(lo))
        grid, n, below = df.agg(
            F.percentile_approx(F.when(inside, c), GRID, ACCURACY), F.count_if(inside), below_here
        ).first()
        if lo is None:
            total, target = n, position(n)
            if not 0 <= target < total:
                return None, total
        step = 1.0 / (len(GRID) - 1)
        share = (target - below) / n
        slack = 3.0 / ACCURACY + 3.0 / n
        left = int(max((share - slack) / step, 0.0))
        right = min(int((share + slack) / step) + 1, len(GRID) - 1)
        width = n * (right - left + 1) * step
        # the ends of the grid are the smallest and largest value only up to the rank error
        if n <= SORT_ROWS:
            break
        new_lo = grid[left] if left > 0 else lo if lo is not None else df.agg(F.min(c)).first()[0]
        new_hi = grid[right] if right < len(GRID) - 1 else hi if hi is not None else df.agg(F.max(c)).first()[0]
        if (new_lo, new_hi) == (lo, hi):
            break  # one value fills the bracket; counting per value is small
        lo, hi = new_lo, new_hi
        if width <= SORT_ROWS:
            break
    value = c if lo is None else F.when(c >= F.lit(lo), c)
    kept = df if hi is None else df.filter(c <= F.lit(hi))
    counts = kept.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.asc_nulls_first("v"))))
    return upto.filter(F.col("upto") > target).agg(F.min("v")).first()[0], total


def smallest_n(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the smallest bigint key, for a key without ties.

    Small n is a plain limit. Large n filters on the exact n-th smallest key, so
    no task holds more than its share.
    """
    keyed = df.withColumn("_key", key)
    if n <= SMALL_LIMIT:
        return keyed.orderBy("_key").limit(n).drop("_key")
    cut, _ = kth_smallest(keyed, "_key", lambda total: n - 1)
    return df if cut is None else keyed.filter(F.col("_key") <= F.lit(cut)).drop("_key")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows chosen by hash of the key columns: the same rows under any partitioning."""
    return smallest_n(df, stable_hash(*keys, seed=seed), n)


def hash_split(df: DataFrame, keys: Sequence[str], share: int = 85, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'train' for about share percent of the keys, else 'validation'."""
    bucket = stable_hash(*keys, seed=seed) % 100
    return df.withColumn("part", F.when(bucket < share, "train").otherwise("validation"))


def first_by_text(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in text order (the order of UTF-8 bytes), without a task that holds them all.

    Seven bytes of the text at a time are a number; the exact n-th smallest of it is a cut, and only
    the rows at the cut go on to their next seven bytes.
    """
    if n <= SMALL_LIMIT:
        return df.orderBy(key).limit(n)
    longest = df.agg(F.max(F.octet_length(key))).first()[0] or 0
    parts, rest = [], df
    for start in range(1, longest + 1, 7):
        piece = F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), start, 7)), 14, "0")
        coded = rest.withColumn("_code", F.conv(piece, 16, 10).cast("bigint"))
        cut, total = kth_smallest(coded, "_code", lambda _, n=n: n - 1)
        if cut is None or n == total:
            return reduce(DataFrame.unionByName, [*parts, rest])
        below = coded.filter(F.col("_code") < F.lit(cut)).drop("_code")
        parts.append(below)
        n -= below.count()
        rest = coded.filter(F.col("_code") == F.lit(cut)).drop("_code")
        if n <= SMALL_LIMIT:
            break
    return reduce(DataFrame.unionByName, [*parts, rest.orderBy(key).limit(n)])


def popular(pool: DataFrame, score: str, n: int, key: str = "query") -> DataFrame:
    """The n highest scores, ties by text, for any n."""
    if n <= SMALL_LIMIT:
        return pool.orderBy(F.desc(score), F.asc(key)).limit(n)
    # exact cut on the score, then on the text among the rows tied at the cut
    neg = pool.withColumn("_s", -F.col(score))
    cut, _ = kth_smallest(neg, "_s", lambda total: n - 1)
    if cut is None:
        return pool
    above = neg.filter(F.col("_s") < F.lit(cut))
    tied = neg.filter(F.col("_s") == F.lit(cut))
    return above.unionByName(first_by_text(tied, key, n - above.count())).drop("_s")


def reduce_pool(pool: DataFrame, n_top: int = 560_000, n_random: int = 140_000, seed: int = 42) -> DataFrame:
    """The most popular queries plus a hash sample, without duplicates.

    ``pool`` has query and popularity. A pool of at most n_top rows stays whole.
    """
    top = popular(pool, "popularity", n_top)
    drawn = sample_rows(pool, n_random, ["query"], seed)
    return top.unionByName(drawn).dropDuplicates()
