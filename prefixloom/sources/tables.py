"""Scans, materialised tables and cleaning of the input tables."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENGAGEMENT, require


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan of a path or glob; a given schema is enforced by the reader."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table was written at path (its _SUCCESS marker is there)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(conf).exists(marker)


def materialise(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """Read the table at path, building and writing it first when absent or forced.

    Later reads start from the files, so the lineage is cut and a lost executor
    costs one re-read rather than a rebuild.
    """
    if force or not exists(spark, path):
        from ..session import shuffles_removed  # which imports this module

        df = build()
        with shuffles_removed(spark):
            df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir.

    Only a local session may do without that setting; it gets one temporary folder,
    removed when the program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if folder:
        return f"{folder}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="prefixloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


_LOCAL: dict[str, str] = {}


BUCKET_ROWS = 500_000
MOST_BUCKETS = 16_384


def bucketed(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], by: list[str], rows: int | None, force: bool = False, sort: list[str] | None = None
) -> DataFrame:
    """The table at path, laid out in buckets by the columns ``by`` and sorted within (by ``sort`` if given); built and written first when absent or forced.

    A join or group by just these columns reads it without a shuffle of its rows. There is a bucket for about BUCKET_ROWS
    of the table's ``rows`` (counted where not given), and at least one per shuffle partition, since the other side of a join is dealt alike.
    The layout is kept beside the files, from which a later session names the table again.
    """
    if force or not exists(spark, f"{path}_layout"):
        df = build()
        least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 200)
        n = min(max(-(-(df.count() if rows is None else rows) // BUCKET_ROWS), least), MOST_BUCKETS)
        name = table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = df.repartition(n, *by)  # as buckets are: one file each
        dealt.write.mode("overwrite").bucketBy(n, *by).sortBy(*(sort or by)).option("path", path).saveAsTable(name)
        layout = spark.createDataFrame([(n, by, sort or by, df.schema.json())], "n int, by array<string>, sort array<string>, schema string")
        layout.coalesce(1).write.mode("overwrite").parquet(f"{path}_layout")
    return kept(spark, path)


def table_name(path: str) -> str:
    return "prefixloom_" + hashlib.md5(path.encode()).hexdigest()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """A table that a store wrote, in buckets if it was laid out so."""
    if not exists(spark, f"{path}_layout"):
        return spark.read.parquet(path)
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        row = spark.read.parquet(f"{path}_layout").first()
        schema = T.StructType.fromJson(json.loads(row["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by, sort = (", ".join(f"`{c}`" for c in row[kind]) for kind in ("by", "sort"))
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({sort}) INTO {row['n']} BUCKETS LOCATION '{place}'")
    return spark.table(name)


class store:
    """A ``keep`` for index builders: every table is written below folder unless it is there.

    A table with the columns ``by`` is laid out in buckets by them. ``guard`` remembers the rows an index was built from and refuses to answer for others; with
    ``force`` every table is written anew.
    """

    def __init__(self, spark: SparkSession, folder: str, force: bool = False):
        self.spark, self.folder, self.force = spark, folder, force

    def __call__(self, df: DataFrame, name: str, by: list[str] | None = None, rows: int | None = None, sort: list[str] | None = None) -> DataFrame:
        path = f"{self.folder}/{name}"
        if by:
            return bucketed(self.spark, path, lambda: df, by, rows, self.force, sort)
        return materialise(self.spark, path, lambda: df, self.force)

    def guard(self, name: str, df: DataFrame) -> None:
        number = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
        rows = df.agg(F.count("*").alias("n"), F.bit_xor(number).alias("xored"), F.sum(F.pmod(number, F.lit(1 << 32))).alias("added"))
        path = f"{self.folder}/{name}_fingerprint"
        known = exists(self.spark, path) and not self.force
        seen = rows.first()
        if known and tuple(self.spark.read.parquet(path).first()) != tuple(seen):
            raise ValueError(f"{self.folder} was built from another {name}; take another folder or force=True")
        if not known:
            self.spark.createDataFrame([tuple(seen)], rows.schema).write.mode("overwrite").parquet(path)


def clean_features(features: DataFrame) -> DataFrame:
    """Missing counts become 0, counts become bigint."""
    require(features, "query", *ENGAGEMENT)
    return features.select(
        "query", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ENGAGEMENT]
    )


def feature_map(features: DataFrame, key: str = "query", order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order`` if there is such a column, else maxima.

    DataFrames have no row order, so "last row wins" needs an order column.
    """
    counts = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ENGAGEMENT]
    if order is None:
        cleaned = features.select(key, *counts)
        return cleaned.groupBy(key).agg(*[F.max(c).alias(c) for c in ENGAGEMENT])
    rows = features.select(key, order, *counts)
    last = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in ENGAGEMENT]))
    return rows.groupBy(key).agg(last.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in ENGAGEMENT])


def distinct_queries(pool: DataFrame) -> DataFrame:
    """The pool is a set of texts: the text is the row id."""
    return require(pool, "query").select("query").distinct()


def clean_products(products: DataFrame) -> DataFrame:
    """Products with an image and a title over ten characters; image_url is the first large one."""
    url = F.try_element_at("images", F.lit(1))["large"]
    return (
        products.filter(F.col("images").isNotNull() & F.col("title").isNotNull())
        .withColumn("image_url", url)
        .filter(F.col("image_url").isNotNull() & (F.length("title") > 10))
        .drop("images")
    )


def summary(tables: dict[str, tuple[DataFrame, str]], n: int = 3) -> DataFrame:
    """Row count and the n first values (in order) of one column, per table."""
    out = None
    for name, (df, column) in tables.items():
        counts = df.agg(F.count("*").alias("n_rows"))
        first = df.select(F.col(column).alias("v")).distinct().orderBy("v").limit(n)
        sample = first.agg(F.array_join(F.sort_array(F.collect_list("v")), " / ").alias("s")).scalar()
        row = counts.select(F.lit(name).alias("table_name"), "n_rows", sample.alias("sample"))
        out = row if out is None else out.unionByName(row)
    return out
