"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a small file gives fewer partitions than there are cores.

    A large input is left as it is, and so is anything behind a shuffle: asking such a plan for
    its partitions would run it.
    """
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
