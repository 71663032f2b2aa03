"""What a session needs so that executors can run this package's functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where the driver does.  On a
    cluster whose machines don't share that folder, ship the package with
    ``--py-files``."""
    known = spark.sparkContext.environment
    parts = [p for p in known.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


#: MB of input a task, and a size that Spark gives where it knows none.
TASK_MB, UNKNOWN = 2, 2**62


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` partitioned by ``key``, in as many parts as its input files are
    large: what a task holds stays the same however much there is.  Input of
    unknown size goes to Spark's default number of partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=UNKNOWN) >= UNKNOWN:
        return df.repartition(key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // (TASK_MB << 20))), key)
