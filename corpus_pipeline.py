"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, best-two-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of `documents`; the last returns the packed pieces. Empty inputs, null texts
and repeated rows pass through as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import ngram_join, packing, quality, secrets
from vellumine.llm.common import checkpoint_dir, delete, folders, sweep, written
from vellumine.llm.queries import END_ID, vocabulary


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The model is fitted on labelled documents of this run's input."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id."""
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their text replaced by marks; n_chars counts the new text where it was known."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID)


STAGES = [("quality rules", drop_bad), ("n-gram Jaccard join", drop_near_duplicates), ("secret scans", redact_secrets), ("best-fit packing", pack)]

#: The quality model and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written as Parquet in the shared folder and read again. What a stage kept there, and what its predecessor
    wrote, is removed once its rows are written; the last one's stays, as its rows are read from it. Runs at the same time don't meet each other's folders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = checkpoint_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        with folders() as made:
            docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{folder}/stage-{i}")
            sweep(spark, made)
            if i:
                delete(spark, f"{folder}/stage-{i - 1}")
    return docs
