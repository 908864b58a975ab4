"""Mixing sources to target weights by nested hash thresholds, native throughout.

Sizes are summed by source and hash bucket; a running sum over the buckets of a source finds the bucket in which its budget
ends; only that bucket is refined, by further bits of the same hash, LEVELS times. A row is taken once more if its hash lies
under its source's threshold, so a larger budget only ever adds rows, and nothing is sorted or sampled.

A source's target is met by whole rows: every row is taken floor(target / source size) times, and those under the
threshold once more. The last bucket is taken if this brings the source nearer to its target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows of size 0 take 0; of rows
repeated with one doc_id and text all get the same hash and so the same decision; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    """The number of WORD matches: each is a word character at the start or after white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size -> rank, weight, target: share[0]/share[1] of all sizes, dealt by weight, at most `most` times a
    source's size, the excess dealt again until none is above.

    That fixed point fills every source to min(cap, level * weight): with sources in order of cap / weight, the first k are
    full for the least k whose level does not exceed the next source's cap / weight. All sums are of integers, so the one
    division at the end is exact to the last bit. One row per source goes through the two windows without a key."""
    p, q = share
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.lit(None).cast("long")
    for i, x in enumerate(weights):
        w = F.when((F.col("rank") - 1) % len(weights) == i, F.lit(x).cast("long")).otherwise(w)
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", w)
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    everything = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = (
        ranked.withColumn("all", F.sum("source_size").over(everything))
        .withColumn("left", F.col("all") * p - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (most * q))  # q times what the rest shares
        .withColumn("rest", F.sum("weight").over(after))
    )
    open_ = F.col("left") * F.col("weight") <= F.col("source_size") * (most * q) * F.col("rest")  # not full at this level
    found = step.withColumn("open", open_).withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "rank", "left", "rest"))).over(everything))
    level = F.col("level.left") * F.col("weight")
    return found.select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("open"), level.cast("double") / (F.col("level.rest") * q).cast("double")).otherwise((F.col("source_size") * most).cast("double")).alias("target"),
    )


def plan(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, times, taken for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
        (F.xxhash64(F.col("doc_id").cast("long")) if key is None else key).alias("h"), F.octet_length(text).alias("text_bytes"),
    )
    rows = materialize(spark, rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    # prefix: the hash bits of the bucket still open; under: tokens of the buckets before it
    goal = materialize(spark, goal.withColumn("prefix", F.lit(0).cast("long")).withColumn("under", F.lit(0).cast("long")), "goal")
    for level in range(1, LEVELS + 1):
        goal = _refine(spark, rows, goal, level)
    shift = 64 - BITS * LEVELS
    at = F.shiftrightunsigned("h", shift)
    more = (at < F.col("prefix")) | ((at == F.col("prefix")) & F.col("last"))
    times = F.col("base") + F.when(more & (F.col("budget") > 0), 1).otherwise(0)
    g = goal.withColumnRenamed("source", "goal_source")
    both = rows.join(g, rows.source.eqNullSafe(g.goal_source))
    return both.select("doc_id", "source", "text_bytes", "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def _refine(spark, rows: DataFrame, goal: DataFrame, level: int) -> DataFrame:
    """One more level of bits of each source's open bucket."""
    shift = 64 - BITS * level
    g = goal.withColumnRenamed("source", "goal_source")
    inside = F.shiftrightunsigned(rows.h, 64 - BITS * (level - 1)) == g.prefix if level > 1 else F.lit(True)
    hist = (
        rows.join(g, rows.source.eqNullSafe(g.goal_source) & inside)
        .groupBy("source", F.shiftrightunsigned("h", shift).alias("bucket"))
        .agg(F.sum("size").alias("n"), F.first("under").alias("under"), F.first("budget").alias("budget"))
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = hist.withColumn("start", F.col("under") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    # the bucket in which the budget ends; at the last level taken as a whole if that is nearer
    edge = sums.filter((F.col("start") <= F.col("budget")) & (F.col("start") + F.col("n") > F.col("budget")))
    edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "start", "n")).alias("e"))
    e = edge.withColumnRenamed("source", "edge_source")
    last = F.abs(F.col("e.start") + F.col("e.n") - F.col("budget")) < F.abs(F.col("e.start") - F.col("budget"))
    end = F.lit(1 << (BITS * level)).cast("long")  # no edge: every bucket is under
    out = goal.drop("last").join(e, goal.source.eqNullSafe(e.edge_source), "left").select(
        "source", "source_size", "rank", "weight", "target", "base", "budget",
        F.coalesce("e.bucket", end).alias("prefix"), F.coalesce("e.start", "under").alias("under"), F.coalesce(last, F.lit(False)).alias("last"),
    )
    return materialize(spark, out, f"goal{level}")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; rows of size 0 are passed on once."""
    names = docs.columns
    made = plan(docs)
    times = made.groupBy(F.col("doc_id").alias("mix__id"), F.col("source").alias("mix__source"), F.col("text_bytes").alias("mix__bytes")).agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("times"))).alias("mix__times"))
    t = times.filter("mix__times > 0")
    rows = docs.join(
        t, (docs.doc_id.cast("long").eqNullSafe(t.mix__id)) & docs.source.eqNullSafe(t.mix__source) & (F.octet_length(F.coalesce(docs.text, F.lit(""))) == t.mix__bytes)
    )
    return rows.withColumn("mix__copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix__times"))).select(*[docs[c] for c in names])
