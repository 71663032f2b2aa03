"""A corpus pipeline of five operators of ``tablewright.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns rows with the columns of
``documents`` (the last one: where each piece of each document lies).  Stages
are written as Parquet and read again, so a lost executor costs one stage's
task at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from tablewright.llm.common import documents, ensure_checkpoint_dir
from tablewright.llm.queries import remainder, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity operator rejects go."""
    field = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    return toxicity.without_toxic(docs, field)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind's name."""
    return pii.redacted(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces, placed in sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram jaccard join", drop_near_copies), ("pii", mask_personal_data), ("best-fit packing", pack_documents)]

#: SQL can express neither a random field nor a tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and
    read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    raise AssertionError("unreachable")
