"""The corpus pipeline: from documents to token ids, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of documents; the last one returns ids. All operators are those of prefixloom.llm.

Null and empty texts pass the toxicity stage (without labels every document does), are one near-duplicate class, of which the smallest
doc_id stays (a null one only where there is no other), hold no secrets, count no tokens and have no ids. Of rows repeated in full one
stays. Rows with a null source are a source of their own. Whole texts count, however long. Further columns, whatever
their names, travel up to the last stage. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm import mixing, pieces, secrets, simhash, toxicity
from prefixloom.llm.common import table, written

REPEATS = 1.5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold stay."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets are masked and n_chars follows."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: small sources are repeated, none more than REPEATS times."""
    return mixing.mix(docs, repeats=REPEATS).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return pieces.encoded(docs, pieces.Vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", toxic), ("near_copies", near_copies), ("secrets", without_secrets), ("mixing", mixed), ("token_ids", token_ids),
]

# a trained classifier, XXH64 and tokenization are beyond SQL; tests/llm/test_pipeline.py has a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
