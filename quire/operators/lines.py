"""From text streams to lines, and line joins in reading order. Rows are keyed (doc_id, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions import text as T
from . import passes, rules


def physical_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, raw: one row per line of the stream."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "raw"))


def stream_lines(lines: DataFrame, key: tuple = ("doc_id",)) -> DataFrame:
    """key, line_no, text: blank lines go; a line that ends in a hyphen takes on the next if that starts in lower case and no
    blank line stands between. A key's lines are one list, over which a pass runs."""
    return streamed(passes.held(lines, key, ["line_no", "raw"]), key)


def streamed(lists: DataFrame, key: tuple = ("doc_id",)) -> DataFrame:
    """The same of lists `rows` of (line_no, raw) in order."""
    number = lists.schema["rows"].dataType.elementType["line_no"]
    return passes.passed(lists, key, passes.stream, StructType([number, StructField("text", StringType())]))


def join_runs(rows: DataFrame, joins: str, text: str, key: tuple = ("doc_id",)) -> DataFrame:
    """Lines whose `joins` is set are appended to the line before, whose hyphen goes; line_no is that of a run's first line."""
    order = Window.partitionBy(*key).orderBy("line_no")
    runs = rows.withColumn("run", F.sum((~F.col(joins)).cast("int")).over(order))
    parts = runs.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("line_no", text))).alias("p"))
    joined = F.aggregate("p", F.lit(""), lambda acc, x: F.concat(F.regexp_replace(acc, "-$", ""), x[text]))
    return parts.select(*key, F.col("p")[0]["line_no"].alias("line_no"), joined.alias("text"))


def rejoin_hyphens(lines: DataFrame, key: tuple = ("doc_id",)) -> DataFrame:
    """The whole chain of lines that end in a hyphen and go on in lower case."""
    order = Window.partitionBy(*key).orderBy("line_no")
    rows = lines.withColumn("joins", F.coalesce(F.lag("text").over(order).endswith("-") & F.col("text").rlike("^[a-z]"), F.lit(False)))
    return join_runs(rows, "joins", "text", key)


def stitch_pairs(lines: DataFrame, key: tuple = ("doc_id",)) -> DataFrame:
    """One pass of joins in which a line that was taken on can't take on the next: a chain joins pair by pair."""
    order = Window.partitionBy(*key).orderBy("line_no")
    rows = lines.withColumn("can", F.coalesce(F.lag("text").over(order).endswith("-") & F.col("text").rlike("^[a-z]"), F.lit(False)))
    rows = rows.withColumn("chain", F.sum((~F.col("can")).cast("int")).over(order))
    at = F.row_number().over(Window.partitionBy(*key, "chain").orderBy("line_no"))
    return join_runs(rows.withColumn("joins", F.col("can") & (at % 2 == 0)), "joins", "text", key)


def without_chrome(lines: DataFrame, page_numbers: bool = True) -> DataFrame:
    """Lines without running heads and the like; page_numbers: whether page numbers count among them."""
    cut = lines.withColumn("text", rules.without_chrome(F.col("text")))
    return cut.filter(~rules.is_chrome(F.col("text"), page_numbers))


def renumbered(lines: DataFrame) -> DataFrame:
    """Synthetic places: 12 points a line, 10 high."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return lines.withColumn("y0", (n * 12).cast("double")).withColumn("y1", (n * 12 + 10).cast("double"))


def merge_paragraphs(blocks: DataFrame, key: tuple = ("doc_id",), at: str = "line_no") -> DataFrame:
    """Paragraphs that follow one whose text doesn't end a sentence are appended to it, whose hyphen goes; other kinds stand between."""
    order = Window.partitionBy(*key).orderBy(at)
    before = (F.lag("kind").over(order) == "Paragraph") & ~T.ends_sentence(F.lag("text").over(order))
    rows = blocks.withColumn("follows", F.coalesce((F.col("kind") == "Paragraph") & before, F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("follows")).cast("int")).over(order))
    rest = [c for c in blocks.columns if c not in (*key, at, "kind", "text")]
    parts = rows.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct(at, "kind", "text", *rest))).alias("p"))
    joined = F.aggregate("p", F.lit(""), lambda acc, x: T.appended(acc, x["text"]))
    return parts.select(*key, *[F.col("p")[0][c].alias(c) for c in (at, "kind", *rest)], joined.alias("text"))


def quality(lines: DataFrame, key: tuple = ("doc_id",), counted: bool = False) -> DataFrame:
    """key, words, suspect, quality: 0 under 8 words, else 1 less four times the share of suspect words, 0.25 at least. Words are counted
    within their line, so that only lines' sums are dealt. counted: with their number as `lines`."""
    words = T.words(F.col("text"))
    bad = F.size(F.filter(words, T.is_suspect))
    counts = lines.groupBy(*key).agg(F.coalesce(F.sum(F.size(words)), F.lit(0)).alias("words"), F.coalesce(F.sum(bad), F.lit(0)).alias("suspect"), *([F.count(F.lit(1)).alias("lines")] if counted else []))
    share = F.least(F.lit(0.75), F.lit(4.0) * F.col("suspect") / F.col("words"))
    return counts.withColumn("quality", F.when(F.col("words") < 8, F.lit(0.0)).otherwise(F.lit(1.0) - share))


def stream_score(lines: DataFrame) -> DataFrame:
    """doc_id, score: marks for anchors that come early, less for permissions, and the number of lines up to 200."""
    one = Window.partitionBy("doc_id")
    low = T.ascii_lower(F.col("text"))
    rows = lines.withColumn("at", (F.row_number().over(one.orderBy("line_no")) - 1) / F.count(F.lit(1)).over(one))
    mark = (
        F.when(low.startswith("abstract"), F.when(F.col("at") < 0.25, 50).otherwise(-20)).otherwise(0)
        + F.when(low.startswith("1. introduction") | (low == "1. storyspace"), F.when(F.col("at") < 0.4, 30).otherwise(-10)).otherwise(0)
        - F.when(low.contains("permission to make digital"), 25).otherwise(0)
        + F.when(low.startswith("what explains"), 20).otherwise(0)
        + F.when(low.startswith("perseus and other"), 20).otherwise(0)
    )
    return rows.groupBy("doc_id").agg((F.sum(mark) + F.least(F.count(F.lit(1)), F.lit(200))).alias("score"))
