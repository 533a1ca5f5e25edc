"""The input tables, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_hash
from .tables import scan

# what the reader enforces; the other tables keep the schema of their files
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


class Tables:
    """Lazy DataFrames over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, f"{self.folder}/{name}.parquet", SCHEMAS.get(name))

    def parts(self) -> DataFrame:
        text = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
        return self.table("part").select("p_partkey", text.alias("query"))

    def pool(self) -> DataFrame:
        return self.parts().select("query").distinct()

    def features(self) -> DataFrame:
        sold = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
        kept = self.parts().filter(F.col("p_partkey") % 10 != 3)
        clicked = F.when(F.col("l_returnflag") != "N", 1).otherwise(0)
        return (
            sold.join(kept, sold.l_partkey == kept.p_partkey)
            .groupBy("query")
            .agg(
                F.countDistinct("l_orderkey").alias("orders"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
                F.sum(clicked).alias("catalog_clicks"),
                F.count("*").alias("catalog_views"),
            )
        )

    def train(self) -> DataFrame:
        """One logged pair per line item; row_id hashes the columns that identify it."""
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        day = F.date_format("l_shipdate", "yyyy-MM-dd")
        sold = self.table("lineitem").select(*keys, day.alias("day"))
        parts = self.parts()
        length = (2 + F.col("l_orderkey") % 9).cast("int")
        return sold.join(parts, sold.l_partkey == parts.p_partkey).select(
            stable_hash(*keys, "day").alias("row_id"),
            F.substring(F.col("query"), F.lit(1), length).alias("prefix"),
            "query",
        )

    def prefixes(self) -> DataFrame:
        q, kind = F.col("query"), F.col("p_partkey") % 60
        typo = F.concat(F.substring(q, 1, 1), F.substring(q, 3, 8))
        text = F.when(kind == 0, F.substring(q, 1, 2)).when(kind == 20, F.substring(q, 1, 8)).otherwise(typo)
        return (
            self.parts().filter(F.col("p_partkey") % 20 == 0).select(text.alias("prefix")).distinct()
        )

    def products(self) -> DataFrame:
        n = F.col("page_id")
        title = F.when(n % 11 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
        images = F.when(n % 7 != 0, F.array(F.struct(F.col("url").alias("large"))))
        return self.table("pages").select("page_id", title.alias("title"), images.alias("images"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    def query_vectors(self) -> DataFrame:
        return self.vectors().filter(F.col("vec_id") % 50 == 0).select(
            F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")
        )

    def pool_vectors(self) -> DataFrame:
        return self.vectors().filter(F.col("vec_id") % 50 != 0).select(
            F.col("vec_id").alias("pid"), F.col("embedding").alias("vec")
        )

    def generated(self) -> DataFrame:
        """Generated text per pool query, made invalid for queries of even length."""
        q = F.col("query")
        tail = F.when(F.length(q) % 2 == 0, F.lit(" zz")).otherwise(F.lit(""))
        text = F.concat(F.lit("Prefix: "), F.substring(q, 1, 3), F.lit("\nCompletions: "), q, tail)
        return self.pool().select(text.alias("text"))
