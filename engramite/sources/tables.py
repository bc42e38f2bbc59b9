"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(frame: DataFrame) -> DataFrame:
    """A scan of fewer parts than cores dealt over all cores; any larger one as it is. For work that is heavy for each row."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
