"""Work lists: input files, where their output goes, and streams of new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def output_path(path: Column, root: str, out: str) -> Column:
    """out / the path under root with .md; a path outside root keeps its file name alone."""
    root = root.rstrip("/") + "/"
    inside = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    return F.concat_ws("/", F.lit(out.rstrip("/")), F.regexp_replace(inside, r"\.[^./]*$", ".md"))


def listed(spark: SparkSession, inputs: list[str], out: str, recursive: bool = True, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, size_bytes, content, output_path of the files of each input, in one table; missing inputs are left out."""
    found = None
    jvm = spark.sparkContext._jvm
    for at in inputs:
        where = jvm.org.apache.hadoop.fs.Path(at)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(at)
        root = str(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString())
        rows = files.select("path", F.col("length").alias("size_bytes"), "content", output_path(F.col("path"), root, out).alias("output_path"))
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "path string, size_bytes long, content binary, output_path string")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
