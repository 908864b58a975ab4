"""Tables that several steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the folder that the cluster names in spark.checkpoint.dir, which outlives lost executors; where
    none is named, kept in memory and on disk, and computed again if it is lost."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
