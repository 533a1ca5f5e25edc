"""Helpers of the operators: text columns as flat numpy arrays, written tables, clean inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_folder

SLICE_BYTES = 4 << 20  # text that a Python task looks at together; a longer text is a slice of its own
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    end = uuid.uuid4().hex[:12]
    return [f"_{name}_{end}" for name in names]


def written(df: DataFrame) -> DataFrame:
    """df as Parquet files in the shared folder: the lineage is cut, a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]:ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text, each of one row at least."""
    if not batch.num_rows:
        return
    _, ends = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, min(stop, batch.num_rows) - start)
        start = stop


def with_columns(
    df: DataFrame, text: str, added: dict[str, T.DataType], compute: Callable[[pa.Array], list], most: int = SLICE_BYTES
) -> DataFrame:
    """df with new columns that Python computes from the whole texts of one column.

    compute gets a string column (of about ``most`` bytes) and returns one Arrow array (or list) per new column. A column of
    df that has the name of a new one is replaced.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kept = [c for c in df.columns if c not in added]
    body = f"_text_{uuid.uuid4().hex[:8]}"
    fed = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body))
    same = text in kept and dict(df.dtypes)[text] == "string"
    if same:  # the text travels once
        fed, body = df.select(*[F.col(f"`{c}`") for c in kept]), text
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, t) for c, t in added.items()])
    types = [pa_type(t) for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body, most):
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(compute(part.column(body)), types)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, kept + list(added))

    return fed.mapInArrow(run, schema)


def pa_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(pa_type(t.elementType))
    return {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "boolean": pa.bool_(), "binary": pa.binary()}[t.typeName()]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Callable, most: int, most_bytes: int,
    balance: bool, key: str = "doc_id", text: str = "text",
) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts for the fit of a classifier, the same on every run.

    Rows that ``held_out(key)`` marks, null labels, null texts and texts of more than most_bytes
    bytes take no part. The rows follow a hash of the key. With ``balance`` each class gives up to
    most / 2 rows, else the classes keep their shares. Only these rows reach the driver.
    """
    known = (
        labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_key").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_key")))
        .groupBy("_key").agg(F.max("_y").alias("_y"))
        .withColumn("_h", F.xxhash64(F.col("_key").cast("string"), F.lit("fit")))
    )
    if balance:
        part = [known.filter(F.col("_y") == y).orderBy("_h", "_key").limit(most // 2) for y in (0, 1)]
        drawn = part[0].unionByName(part[1])
    else:
        drawn = known.orderBy("_h", "_key").limit(most)
    drawn = F.broadcast(drawn)  # most rows of 24 bytes
    rows = (
        docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
        .filter(F.col("_text").isNotNull() & (F.octet_length("_text") <= most_bytes))
        .join(drawn, "_key")
        .groupBy("_key").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"), F.first("_h").alias("_h"))
        .collect()
    )
    rows.sort(key=lambda r: (r["_h"], str(r["_key"])))
    return [(r["_text"], r["_y"]) for r in rows]


def remainder(divisor: int, rest: int) -> Callable:
    """Marks the keys whose CRC-32 (of the key as text) has the given remainder."""
    return lambda key: F.coalesce(F.crc32(key.cast("string")) % divisor == rest, F.lit(False))
