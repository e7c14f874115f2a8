"""Enough partitions for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in at least as many partitions as there are cores.

    A table of a few small files comes in fewer, and its rows are then dealt out anew; a large one is left as it is. So
    are streams, and plans that shuffle anyway: to count their partitions would be to run them.
    """
    if rows.isStreaming or rows._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
