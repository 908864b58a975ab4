"""New files as they come: each is a whole document, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire import session
from quire.sources import jobs, sinks


def convert_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Converts the text files of folder that weren't seen before, and ends. A batch that is repeated writes the same files again."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def write(batch, _):
        root = "file:" + folder.removeprefix("file:") if "://" not in folder else folder
        rows = batch.select("path", "content", jobs.output_path(F.col("path"), root, out).alias("output_path"))
        done = session.converted(rows)
        sinks.write_texts(done.select(F.col("output_path").alias("path"), F.col("markdown").alias("text"))).count()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
