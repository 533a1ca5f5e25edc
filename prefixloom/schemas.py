"""Column contracts of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the input tables.
ENGAGEMENT = ["orders", "volume", "catalog_clicks", "catalog_views"]

POOL = T.StructType([T.StructField("query", T.StringType())])
TRAIN = T.StructType(
    [T.StructField("prefix", T.StringType()), T.StructField("query", T.StringType())]
)
PREFIXES = T.StructType([T.StructField("prefix", T.StringType())])
FEATURES = T.StructType(
    [T.StructField("query", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ENGAGEMENT]
)
PRODUCTS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField(
            "images",
            T.ArrayType(T.StructType([T.StructField("large", T.StringType())])),
        ),
    ]
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail at plan time when an expected column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
