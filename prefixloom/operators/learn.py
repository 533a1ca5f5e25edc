"""Training data and models for a learned ranker."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import md5_many
from ..functions.scores import FEATURES, pair_features, rounded
from ..schemas import require
from ..session import broadcast_up_to, cut_lineage
from .candidates import SOURCES, merge_sources, with_engagement
from .ranking import hash_split, kth_smallest, ranked_values, sample_rows

# Graded labels.
EXACT, HIGH, MEDIUM, NEGATIVE = 3, 2, 1, 0
NEGATIVES = 10
SAMPLE = 50_000
LEAST_BINS = 32
FEW_LISTS = 20_000  # candidate lists that travel to every task
FEW_PAIRS, MANY_PAIRS = 200_000, 500_000  # pairs that do, with their features and with a score


def graded_label() -> Column:
    """Label of a true query from its engagement."""
    return (
        F.when(F.col("orders") > 0, EXACT)
        .when(F.col("catalog_clicks") > 0, HIGH)
        .when(F.col("catalog_views") > 0, MEDIUM)
        .otherwise(EXACT)
    )


def training_candidates(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates plus every logged (prefix, query), which has zero scores if no source found it."""
    zeros = truth.select("prefix", "query").distinct().select(
        "prefix", "query", *[F.lit(None).cast("double").alias(s) for s in SOURCES]
    )
    return merge_sources(cands.select("prefix", "query", *SOURCES), zeros)


def drawn_negatives(n_neg: int) -> Callable[..., Column]:
    """Places in a list of the n_neg texts other than the row's own with the smallest ``hash_text`` after ``head``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(head: pa.Array, query: pa.Array, found: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(found)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        texts = found.flatten()
        other = pc.fill_null(pc.not_equal(texts, query.take(pa.array(row))), False).to_numpy(zero_copy_only=False)
        row, place, texts = row[other], place[other], texts.filter(pa.array(other))
        digests = md5_many(pc.binary_join_element_wise(head.take(pa.array(row)), texts, "|"))
        # lists side by side, as a matrix; what is no text comes last
        kept = np.bincount(row, minlength=len(found))
        at = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
        lines = np.full((len(found), int(kept.max(initial=0))), b"\xff" * 16, "S16")
        where = np.zeros(lines.shape, np.int32)
        lines[row, at], where[row, at] = digests, place
        order = np.argsort(lines, axis=1, kind="stable")[:, :n_neg]
        chosen = np.take_along_axis(where, order, axis=1)
        real = np.arange(order.shape[1]) < kept[:, None]
        starts = np.concatenate([[0], np.cumsum(np.minimum(kept, n_neg))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(chosen[real]))

    return places


def groups(
    train: DataFrame, cands: DataFrame, n_neg: int = NEGATIVES, seed: int = 42, carried: Sequence[str] = (), dealt: bool = False,
) -> DataFrame:
    """(group_id, prefix, query, is_truth, carried): each logged row with its negatives.

    train(row_id, prefix, query) has one group per row. A prefix has at most the
    retrieval depth of candidates, so they travel as one array, and up to FEW_LISTS arrays
    to every task; choosing n_neg of them by hash happens inside the row and needs no shuffle. The columns
    ``carried`` of train and cands come along, so the many rows need no join for them. With ``dealt`` the logged rows
    and the places of their negatives are shuffled by group before they become many, so Spark can group them where they are.
    """
    require(train, "row_id", "prefix", "query", *carried)
    one = F.struct("query", *carried)
    found = cands.filter(F.col("query").isNotNull()).groupBy("prefix").agg(F.collect_list(one).alias("found"))
    lists = broadcast_up_to(cut_lineage(found), FEW_LISTS)
    rows = train.join(lists, "prefix", "left")
    head = F.concat_ws("|", F.lit(str(seed)), F.col("row_id").cast("string"))
    places = drawn_negatives(n_neg)(head, "query", "found.query")
    drawn = rows.select("row_id", "prefix", "query", *carried, "found", places.alias("places"))
    if dealt:
        drawn = drawn.drop("found").repartition("row_id").join(lists, "prefix", "left")
    # the row's own query first; plain expressions after the explode, as functions in arrays are slow
    each = drawn.select("row_id", "prefix", "query", *carried, "found", F.explode(F.concat(F.array(F.lit(-1)), "places")).alias("i"))
    is_truth = F.col("i") < 0

    def own_or_drawn(c: str) -> Column:
        return F.when(is_truth, F.col(c)).otherwise(F.get("found", F.col("i"))[c]).alias(c)

    return each.select(
        F.col("row_id").alias("group_id"), "prefix", own_or_drawn("query"), is_truth.alias("is_truth"), *map(own_or_drawn, carried))


def described_pairs(train: DataFrame, found: DataFrame, features: DataFrame) -> DataFrame:
    """(prefix, query, truth_label, 34 features) of every distinct pair that a training set of these rows can hold."""
    pairs = with_engagement(training_candidates(found, train), features)
    return pair_features(
        pairs.withColumn("label", graded_label()), ["prefix", "query", F.col("label").alias("truth_label")]
    )


def labelled(chosen: DataFrame, described: DataFrame, columns: list[str]) -> DataFrame:
    """(group_id, prefix, query, is_truth, label, columns): rows of ``groups`` with columns of their pair."""
    label = F.when(F.col("is_truth"), F.col("truth_label")).otherwise(NEGATIVE)
    return chosen.join(described, ["prefix", "query"]).select(
        "group_id", "prefix", "query", "is_truth", label.alias("label"), *columns
    )


def training_set(
    train: DataFrame, cands: DataFrame, features: DataFrame, n_neg: int = NEGATIVES,
    seed: int = 42,
) -> DataFrame:
    """(group_id, prefix, query, is_truth, label, 34 features) of every row of train.

    ``cands`` are the candidates of the training prefixes without the fuzzy source
    and without pruning. Features depend on (prefix, query) only and are computed
    once per distinct pair; up to FEW_PAIRS pairs travel to every task.
    """
    found = cut_lineage(cands)
    described = broadcast_up_to(cut_lineage(described_pairs(train, found, features)), FEW_PAIRS)
    return labelled(groups(train, found, n_neg, seed), described, FEATURES)


@dataclass
class TrainingParts:
    """A training set whose rows are made when a part of them is asked for; written are only the logged rows
    train(row_id, prefix, query, part), their distinct ids(group_id, part), the candidates and the described pairs."""

    train: DataFrame
    ids: DataFrame
    found: DataFrame
    described: DataFrame

    @classmethod
    def of(cls, train: DataFrame, cands: DataFrame, features: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> TrainingParts:
        """Split as ``group_split`` does with the rows of ``training_set``, which hold no null prefix or query."""
        kept = keep(train.filter(F.col("prefix").isNotNull() & F.col("query").isNotNull()), "logged")
        ids = keep(kept.select(F.col("row_id").alias("group_id")).distinct(), "logged_ids")
        part = group_part(ids)
        found = cut_lineage(cands)
        described = cut_lineage(described_pairs(kept, found, features))
        return cls(kept.withColumn("part", part("row_id")), ids.withColumn("part", part("group_id")), found, described)

    def counted(self, part: str) -> DataFrame:
        """(prefix, query, is_truth, label, 34 features, n): the distinct rows of a part, of all its groups, and how many of each there are."""
        each = groups(self._of(part), self.found).groupBy("prefix", "query", "is_truth").agg(F.count("*").alias("n"))
        label = F.when(F.col("is_truth"), F.col("truth_label")).otherwise(NEGATIVE)
        return cut_lineage(each.join(self.described, ["prefix", "query"]).select("prefix", "query", "is_truth", label.alias("label"), *FEATURES, "n"))

    def rows(self, part: str, most_groups: int, seed: int = 42) -> DataFrame:
        """The rows of a part; of a hash sample of most_groups of its groups if there are more."""
        ids = sample_rows(self.ids.filter(F.col("part") == part).select("group_id"), most_groups, ["group_id"], seed)
        some = self._of(part).join(ids.withColumnRenamed("group_id", "row_id"), "row_id", "left_semi")
        return cut_lineage(labelled(groups(some, self.found), broadcast_up_to(self.described, FEW_PAIRS), FEATURES))

    def scored(self, part: str, model) -> DataFrame:
        """(group_id, prefix, query, is_truth, label, prediction) of all rows of a part: a pair's score is that of its features, so each is scored once."""
        pairs = cut_lineage(model.score(self.described).select("prefix", "query", "truth_label", "prediction"))
        return labelled(groups(self._of(part), self.found), broadcast_up_to(pairs, MANY_PAIRS), ["prediction"])

    def _of(self, part: str) -> DataFrame:
        return self.train.filter(F.col("part") == part)


def training_summary(rows: DataFrame) -> DataFrame:
    """(n_rows, n_groups, n_positive, n_negative)."""
    return rows.agg(
        F.count("*").alias("n_rows"),
        # every group has exactly one truth row
        F.count_if("is_truth").alias("n_groups"),
        F.count_if(F.col("label") > 0).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"),
    )


def group_split(rows: DataFrame, share: float = 0.9, key: str = "group_id") -> DataFrame:
    """Adds ``part``: 'train' for the first int(share * n) group ids, else 'validation'.

    The cut is the exact order statistic of the distinct ids, so no task sorts
    them all.
    """
    return rows.withColumn("part", group_part(rows.select(key).distinct(), share, key)(key))


def group_part(ids: DataFrame, share: float = 0.9, key: str = "group_id") -> Callable[[str], Column]:
    """The part of a column of group ids, by their distinct ``ids``."""
    cut, _ = kth_smallest(ids, key, lambda total: int(total * share) - 1)
    if cut is None:
        return lambda c: F.lit("validation")
    return lambda c: F.when(F.col(c) <= F.lit(cut), "train").otherwise("validation")


@dataclass
class FeatureScaler:
    """Upper clip, mean and deviation per column; a few numbers each."""

    stats: dict[str, tuple[float, float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None, quantile: float = 0.99, weight: str | None = None) -> FeatureScaler:
        """From all rows; each stands for ``weight`` rows, a column of whole numbers."""
        columns = columns or FEATURES
        tops = {c: v[0] for c, v in ranked_values(df, columns, [quantile], weight).items()}
        if weight is not None:
            return cls(cls._weighted(df, tops, F.col(weight)))
        aggs = []
        for c in columns:
            clipped = F.least(F.col(c), F.lit(tops[c]))
            aggs += [F.avg(clipped).alias(f"m_{c}"), F.stddev_samp(clipped).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        return cls({c: (tops[c], row[f"m_{c}"], row[f"s_{c}"] or 0.0) for c in columns})

    @staticmethod
    def _weighted(df: DataFrame, tops: dict[str, float], w: Column) -> dict[str, tuple[float, float, float]]:
        clipped = {c: F.least(F.col(c), F.lit(top)) for c, top in tops.items()}
        means = df.agg(F.sum(w).alias("n"), *[(F.sum(x * w) / F.sum(w)).alias(c) for c, x in clipped.items()]).first()
        n = means["n"] or 0
        if n < 2:
            return {c: (top, means[c], 0.0) for c, top in tops.items()}
        squares = df.agg(*[F.sum(w * (x - F.lit(means[c])) ** 2).alias(c) for c, x in clipped.items()]).first()
        return {c: (top, means[c], (squares[c] / (n - 1)) ** 0.5) for c, top in tops.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        """(min(x, clip) - mean) / std, 0 where std is 0."""
        out = {}
        for c, (top, mean, std) in self.stats.items():
            clipped = F.least(F.col(c), F.lit(top))
            out[c] = rounded((clipped - mean) / std) if std and std > 0 else F.lit(0.0)
        return df.withColumns(out)


def normalize_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Scales a frame by its own statistics."""
    return FeatureScaler.fit(df, columns).transform(df)


@dataclass
class Ranker:
    """Pointwise gradient-boosted trees on the graded labels."""

    model: GBTRegressionModel
    scaler: FeatureScaler

    @classmethod
    def fit(
        cls, rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42, most_groups: int | None = None, weight: str | None = None,
    ) -> Ranker:
        """Fits on all groups of ``rows``, or on a hash sample of most_groups of them if there are more.

        A row stands for ``weight`` rows, a column of whole numbers: rows with equal features and label need be there once only.
        """
        if most_groups is not None:
            ids = sample_rows(rows.select("group_id").distinct(), most_groups, ["group_id"], seed)
            rows = rows.join(ids, "group_id", "left_semi")
        rows = cut_lineage(rows)
        scaler = FeatureScaler.fit(rows, weight=weight)
        ready = cls._assemble(scaler.transform(rows))
        gbt = GBTRegressor(
            featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, maxBins=cls._bins(rows.count())
        )
        return cls((gbt if weight is None else gbt.setWeightCol(weight)).fit(ready), scaler)

    @staticmethod
    def _bins(n: int) -> int:
        """Spark finds thresholds from max(10,000, bins ** 2) rows: as many bins as let it read all of them."""
        return LEAST_BINS if n <= 10_000 else max(LEAST_BINS, math.isqrt(n - 1) + 1)

    @staticmethod
    def _assemble(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def score(self, rows: DataFrame, own_stats: bool = False) -> DataFrame:
        """Adds ``prediction``; own_stats scales by the rows' own statistics instead of the training ones."""
        scaler = FeatureScaler.fit(rows) if own_stats else self.scaler
        return self.model.transform(self._assemble(scaler.transform(rows))).drop("features")

    def importances(self, n: int = 15) -> DataFrame:
        spark = SparkSession.active()
        pairs = [(f, float(w)) for f, w in zip(FEATURES, self.model.featureImportances.toArray())]
        df = spark.createDataFrame(pairs, "feature string, importance double")
        return df.orderBy(F.desc("importance"), F.asc("feature")).limit(n)

    def write(self, folder: str) -> None:
        self.model.write().overwrite().save(f"{folder}/model")
        stats = [(c, *v) for c, v in self.scaler.stats.items()]
        spark = SparkSession.active()
        spark.createDataFrame(stats, "name string, top double, mean double, std double").write.mode("overwrite").parquet(f"{folder}/scaler")

    @classmethod
    def read(cls, folder: str) -> Ranker:
        rows = SparkSession.active().read.parquet(f"{folder}/scaler").collect()
        stats = {r["name"]: (r["top"], r["mean"], r["std"]) for r in rows}
        return cls(GBTRegressionModel.load(f"{folder}/model"), FeatureScaler({c: stats[c] for c in FEATURES if c in stats}))


def text_split(texts: DataFrame, share: int = 85, seed: int = 42) -> DataFrame:
    """Train/validation split of prompt rows by hash of the text."""
    return hash_split(texts, ["text"], share, seed)
