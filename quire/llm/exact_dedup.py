"""Exact deduplication by stateful streaming over content digests, native throughout.

Each row is reduced to (run, uid, doc_id, digest, code points, locator); the locator is the row's file and place in it, where docs is
read from files. A streaming aggregation keyed by digest keeps, in RocksDB and without expiry, the row that stays and the group's
size. On every hit (a digest seen more than once) the full normalised bytes of all members are compared; a digest whose members
differ is split by the bytes themselves. The hits' texts are read again by their locators, behind Spark's Bloom filter join, so
that texts seen once are neither shuffled nor hashed again.

With `state`, a folder, the digests and the stream's state last: a further run adds its rows to those of earlier runs, whose texts are
read again by locator where they are met again. Without, a run is complete in itself and leaves nothing.

Defined results: a null text counts as empty; empty texts are equal to each other; of rows repeated with the same doc_id
and text one stays, null doc_ids being equal to each other; an empty table gives an empty result; further columns are ignored (`dedup`) or passed on (`kept_rows`).
"""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, fresh, materialize, unused

WHITESPACE = " \t\n\u000b\f\r"
#: The state store's provider; no preallocated files: each partition would hold megabytes of empty ones; and one bound for the memory
#: of all stores of an executor, which else grows with their number.
STORE = {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Bits of a Bloom filter of hits at most (64 MB); beyond 33 million hits more of the other rows are shuffled too, with the same result.
MOST_BITS = 1 << 29


def normalised(text: Column) -> Column:
    """The text without any character of `[\\x20\\x09-\\x0D]`; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


@contextmanager
def settings(spark: SparkSession, values: dict):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_state(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """digest -> best (len, -doc_id, -run, -uid), group_size, by a streaming aggregation that ends with its input.

    Updates of batch n go to their own folder, overwritten if the batch is repeated; the largest group_size of a digest is
    its last update, since groups only grow."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(f"{folder}/digests").groupBy("digest").agg(
        F.max(F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("neg_id"), (-F.col("run")).alias("neg_run"), (-F.col("uid")).alias("neg_uid"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    with settings(spark, STORE):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={n}"))
            .start()
        )
        query.awaitTermination()
    return (
        spark.read.schema("digest string, best struct<n_chars:int,neg_id:bigint,neg_run:int,neg_uid:bigint>, group_size bigint")
        .parquet(f"{folder}/updates/batch=*")
        .groupBy("digest")
        .agg(F.max(F.struct("group_size", "best")).alias("last"))
        .select("digest", "last.group_size", "last.best")
    )


def located(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text, locator of each row; whether docs is read from files, so that locators are known)."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    try:
        return docs.select(*own, F.concat("_metadata.file_path", F.lit("#"), F.col("_metadata.row_index").cast("string")).alias("locator")), True
    except AnalysisException:
        return docs.select(*own, F.lit(None).cast("string").alias("locator")), False


def hit_texts(spark: SparkSession, rows: DataFrame, hits: DataFrame, key: list[str], tag: str) -> DataFrame:
    """rows joined to hits on key. A Bloom filter of the hits, of 16 bits a hit up to MOST_BITS, keeps other rows out of the exchange."""
    n = max(1, hits.count())
    bits = min(MOST_BITS, 16 * n)
    bloom = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1PB", "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": str(n),
        "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": str(n), "spark.sql.optimizer.runtime.bloomFilter.numBits": str(bits), "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(bits),
    }
    with settings(spark, bloom):
        return materialize(spark, rows.join(hits, key), tag)


def members(docs: DataFrame, digest=digest_of, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per row of docs: uid, doc_id, digest, text_sha256, keep_id, group_size, kept. uid counts rows within this run. With state,
    groups hold the rows of all its runs, and kept rows are those that stay now."""
    spark = docs.sparkSession
    folder = (state or fresh(spark, "exact")).rstrip("/")
    rows, known = located(docs)
    if state and not known:
        raise ValueError("a lasting state needs documents that are read from files")
    run = _runs(spark, folder)
    schema = "uid long, doc_id long, digest string, text_sha256 string, n_chars int, locator string, run int"
    rows.withColumn("uid", F.monotonically_increasing_id()).select(
        "uid", "doc_id", digest(F.col("text")).alias("digest"), digest_of(F.col("text")).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), "locator"
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/digests/run={run}")
    every = spark.read.schema(schema).parquet(f"{folder}/digests")
    digests = every.filter(F.col("run") == run)
    if not digests.head(1):
        return digests.select("uid", "doc_id", "digest", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    found = stream_state(spark, folder, schema, files_per_batch)
    # as a table of its own the state has no key to keep together, so a digest of very many rows can be split
    best = materialize(spark, found.select("digest", "group_size", "best"), "state")
    stays = (F.col("uid") == -F.col("best.neg_uid")) & (F.col("run") == -F.col("best.neg_run"))
    met = materialize(
        spark,
        digests.join(best, "digest").select("uid", "doc_id", "digest", "text_sha256", "n_chars", "locator", (-F.col("best.neg_id")).alias("keep_id"), "group_size", stays.alias("kept")),
        "members",
    )
    hits = met.filter("group_size > 1")
    texts = rows.select("doc_id", "locator", F.col("text"))
    if known:
        own = hit_texts(spark, texts.select("locator", "text"), hits.select("locator", "uid", "digest"), ["locator"], "hits")
        own = own.select("uid", "digest", normalised(F.col("text")).alias("norm"))
    else:
        own = hit_texts(spark, texts.select("doc_id", "text", digest(F.col("text")).alias("digest")), hits.select("digest").distinct(), ["digest"], "hits")
        own = own.select("doc_id", "digest", "text", normalised(F.col("text")).alias("norm"))
    older = _older(spark, every.filter(F.col("run") < run), hits) if run else None
    both = own.select("digest", "norm")
    both = both if older is None else both.unionByName(older.select("digest", "norm"))
    unequal = materialize(spark, both.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest"), "unequal")
    if not state:
        drop(spark, folder)
    plain = met.drop("locator")
    return (plain if not unequal.head(1) else _by_bytes(plain, own, older, unequal, known, run)).drop("n_chars")


def _runs(spark: SparkSession, folder: str) -> int:
    """How many runs a state holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/digests")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(x.isDirectory() and x.getPath().getName().startswith("run=") for x in fs.listStatus(path)) if fs.exists(path) else 0


def _older(spark: SparkSession, earlier: DataFrame, hits: DataFrame) -> DataFrame:
    """run, uid, doc_id, digest, n_chars, norm of earlier runs' rows whose digest is hit, read by their locators."""
    rows = materialize(spark, earlier.join(hits.select("digest").distinct(), "digest", "left_semi"), "earlier")
    files = [unquote(r.file) for r in rows.select(F.regexp_extract("locator", "^(.*)#", 1).alias("file")).distinct().collect()]  # names of files, as any reader lists
    if not files:
        return rows.select("run", "uid", "doc_id", "digest", "n_chars", F.lit("").alias("norm"))
    texts = located(spark.read.parquet(*files))[0].select("locator", "text")
    met = hit_texts(spark, texts, rows.select("locator", "run", "uid", "doc_id", "digest", "n_chars"), ["locator"], "older")
    return met.select("run", "uid", "doc_id", "digest", "n_chars", normalised(F.col("text")).alias("norm"))


def _by_bytes(found: DataFrame, own: DataFrame, older: DataFrame | None, unequal: DataFrame, known: bool, run: int) -> DataFrame:
    """Digests whose members differ, grouped by the normalised text itself; all other rows as they are."""
    clash = found.join(unequal, "digest", "left_semi")
    if known:
        texts = own.join(unequal, "digest", "left_semi").select("uid", "norm")
        rows = clash.join(texts, "uid")
    else:
        texts = own.join(unequal, "digest", "left_semi").select("doc_id", "digest", digest_of(F.col("text")).alias("text_sha256"), "norm").distinct()
        rows = clash.alias("c").join(texts.alias("t"), F.expr("c.doc_id <=> t.doc_id AND c.digest = t.digest AND c.text_sha256 = t.text_sha256")).select("c.*", "t.norm")
    rows = rows.withColumn("run", F.lit(run))
    every = rows.select("run", "uid", "doc_id", "digest", "n_chars", "norm")
    if older is not None:
        every = every.unionByName(older.join(unequal, "digest", "left_semi").select(*every.columns))
    best = every.groupBy("digest", "norm").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("run")).alias("neg_run"), (-F.col("uid")).alias("neg_uid"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    split = rows.drop("group_size", "keep_id", "kept").join(best, ["digest", "norm"]).select(
        "uid", "doc_id", "digest", "text_sha256", "n_chars", (-F.col("best.neg_id")).alias("keep_id"), "group_size",
        ((F.col("uid") == -F.col("best.neg_uid")) & (F.col("run") == -F.col("best.neg_run"))).alias("kept"),
    )
    return found.join(unequal, "digest", "left_anti").unionByName(split)


def dedup(docs: DataFrame, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    return members(docs, state=state).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each class of equal texts, with all their columns."""
    names, id_, sha = docs.columns, unused(docs, "keep_id"), unused(docs, "keep_sha")
    stay = members(docs).filter("kept").groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(sha, digest_of(F.col("text")))
    once = rows.join(stay, rows[id_].eqNullSafe(stay[id_]) & (rows[sha] == stay[sha]), "left_semi")
    return once.dropDuplicates([id_, sha]).select(*names)
