"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is set only where it is unset and Spark runs in one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="quire-"))
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Paths made within each `swept` that is open, the innermost last.
_made: list[list[str]] = []


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path for one intermediate table."""
    path = f"{shared_dir(spark)}/quire-{tag}-{uuid.uuid4().hex[:12]}"
    for paths in _made[-1:]:
        paths.append(path)
    return path


@contextmanager
def swept(spark: SparkSession, *kept: str):
    """Deletes the intermediate tables and folders made within, but for those in kept, when it ends."""
    _made.append([])
    try:
        yield
    finally:
        for path in set(_made.pop()) - set(kept):
            drop(spark, path)


def materialize(spark: SparkSession, df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df written as Parquet and read again: cuts lineage, survives lost executors, and gives Catalyst a true size."""
    path = path or fresh(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table or folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps, which otherwise wait for a collection on the driver."""
    import gc
    import time

    for _ in range(2):  # the first frees what Python held, the cleaner works beside it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    names = {c.lower() for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def tasks(spark: SparkSession, wanted: int) -> int:
    """A number of partitions: what the data want, but no fewer than the session's."""
    return max(int(wanted), int(spark.conf.get("spark.sql.shuffle.partitions")))


def filesystem(uri: str):
    """pyarrow's file system and path for a file:, hdfs: or other address, in any process."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    try:
        return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    except (ValueError, OSError):  # a scheme that only Hadoop knows
        return fs.HadoopFileSystem("default"), uri
