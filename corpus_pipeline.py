"""Documents to a training mix: toxicity, near duplicates, benchmark leaks, source weights, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four
return the columns of ``docs``; the last returns the shard and slot of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgrain.llm import decontaminate, mixing, ngramjoin, sharding, toxicity
from clickgrain.llm.samples import fold
from clickgrain.session import park

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; learns from the labels of the folds 1 to 4 of 5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by 80 % of their five-word shingles."""
    return ngramjoin.one_of_each(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the weights of the sources ask for."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row into one of eight shards of near equal bytes."""
    return sharding.shard_table(docs, shards=SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]
#: SQL cannot state the stages that rest on a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = park(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
