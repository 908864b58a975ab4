"""Choice between candidate streams of a page, and OCR requests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from . import rules

OCR_MARGIN = 0.04


def select_stream(candidates: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, page, stream of candidates (doc_id, page, family, stream, lines, quality): conference and scanned pages take raw, others
    flow, and geometry where that is empty; magazine pages with overrides (pages: doc_id, page, overridden) and rail pages from the third
    on take geometry first. Generic pages take flow if its quality is no less than geometry's, empty or not. Candidates may hold
    `overridden` themselves."""
    of = lambda name, x: F.max(F.when(F.col("stream") == name, F.col(x)))
    held = "overridden" in candidates.columns and pages is None
    rows = candidates.groupBy("doc_id", "page").agg(
        F.min("family").alias("family"), *([F.max("overridden").alias("overridden")] if held else []), *[F.coalesce(of(s, x), F.lit(0)).alias(f"{s}_{x}") for s in ("flow", "geometry", "raw") for x in ("lines", "quality")]
    )
    if not held:
        rows = rows.join(pages.select("doc_id", "page", "overridden"), ["doc_id", "page"], "left") if pages is not None else rows.withColumn("overridden", F.lit(False))
    family, some = F.col("family"), lambda name: F.col(f"{name}_lines") > 0
    first = F.coalesce(F.col("overridden"), F.lit(False)) | ((family == "frontiers") & (F.col("page") >= 2))
    stream = (
        F.when(family.isin("acm", "scan"), F.when(some("raw"), "raw").otherwise("geometry"))
        .when(family.isin("magazine", "frontiers"), F.when(first & some("geometry"), "geometry").when(some("flow"), "flow").otherwise("geometry"))
        .otherwise(F.when(F.col("flow_quality") >= F.col("geometry_quality"), "flow").otherwise("geometry"))
    )
    return rows.select("doc_id", "page", stream.alias("stream"))


def ocr_requests(pages: DataFrame, boxes: DataFrame, least_bytes: int = 40, when_scan: bool = True) -> DataFrame:
    """doc_id, page, bytes, kind of pages (doc_id, page, family) to be recognised: direct if the text layer holds fewer bytes than that,
    none included; candidate for other scanned pages. First pages of conference and magazine papers are not asked for."""
    bytes_ = boxes.groupBy("doc_id", "page").agg(F.sum(T.size(F.col("text"))).alias("bytes"))
    rows = pages.filter(~rules.is_wrapper(F.col("family"), F.col("page"))).join(bytes_, ["doc_id", "page"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    kind = F.when(F.col("bytes") < least_bytes, "direct").when((F.col("family") == "scan") & F.lit(when_scan), "candidate")
    return rows.select("doc_id", "page", "bytes", kind.alias("kind")).filter("kind IS NOT NULL")


def arbitrate(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc_id, page, source, quality: OCR's result if it was asked for directly, or beats the native quality by OCR_MARGIN; empty
    results don't count."""
    both = native.join(ocr.filter("ocr_lines > 0"), ["doc_id", "page"], "left")
    wins = F.coalesce((F.col("direct") & F.col("ocr_quality").isNotNull()) | (F.col("ocr_quality") > F.col("quality") + OCR_MARGIN), F.lit(False))
    return both.select("doc_id", "page", F.when(wins, "ocr").otherwise("native").alias("source"), F.when(wins, F.col("ocr_quality")).otherwise(F.col("quality")).alias("quality"))


def references_active(pages: DataFrame) -> DataFrame:
    """doc_id, page, active: whether this page or one before it has a references heading, of rows (doc_id, page, text)."""
    has = pages.groupBy("doc_id", "page").agg(F.max(rules.is_references_heading(F.col("text"))).alias("has"))
    return has.select("doc_id", "page", F.max("has").over(Window.partitionBy("doc_id").orderBy("page")).alias("active"))


INLINE, SHORT_FIGURE = r"^figure\s+\d+[a-z]?[\.,]?$", r"(?i)^\s*figure\s+\d+[a-z]?[\.,]?\s*$"


def quarantine(stream: DataFrame, visuals: DataFrame) -> DataFrame:
    """stream lines (doc_id, page, line_no, text) without what stands in visual lines outside the body (doc_id, page, line, region, text).

    A line is held against its page's visual lines in order. Of those with 8 bytes or more: a line that equals one goes; one within the
    line is taken out of it, unless it is a figure that the line refers to, and the line goes if nothing is left; a line of 8 bytes or
    more within one goes, unless it is a short reference to that figure. A line that begins with the first four words of one goes, floats
    apart. The rail layout's two protected kinds of line aren't known here."""
    v = T.ascii_lower(T.collapse(F.col("text")))
    words = T.words(v)
    prefix = F.when(F.size(words) >= 4, F.array_join(F.slice(words, 1, 4), " "))
    # barred: what a line must not begin with, where it isn't a float's
    x = F.struct("line", v.alias("v"), (F.col("region") == "Float").alias("float"), F.when(F.col("region") != "Float", prefix).alias("barred"), (T.size(v) >= 8).alias("long"))
    rows = visuals.select("doc_id", "page", x.alias("x")).filter("x.v <> ''")
    pages = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("x")).alias("visuals"))
    both = stream.withColumn("text", T.collapse(F.col("text"))).join(pages, ["doc_id", "page"], "left")

    def step(acc: Column, x: Column) -> Column:
        text, low, v, long, float_ = acc["text"], acc["low"], x["v"], x["long"], x["float"]
        at = F.position(v, low)
        referred = float_ & v.rlike(INLINE) & F.substring(low, F.lit(1), at - 1).endswith("as shown in ")
        cut = T.collapse(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(v), F.length(text))))
        within = long & low.contains(v) & (low != v)
        swallowed = long & ~low.contains(v) & (T.size(low) >= 8) & v.contains(low) & (~float_ | ~text.rlike(SHORT_FIGURE))
        begins = F.coalesce(F.startswith(low, x["barred"]), F.lit(False))
        # most lines and visual lines have nothing to do with each other, which few comparisons tell
        meets = begins | (long & (low.contains(v) | v.contains(low)))
        gone = F.when(within, ~referred & (cut == "")).otherwise((long & (low == v)) | swallowed | begins)
        left = F.when(within & ~referred, cut).otherwise(text)
        return F.when(acc["gone"] | ~meets, acc).otherwise(F.struct(left.alias("text"), T.ascii_lower(left).alias("low"), gone.alias("gone")))

    both = both.withColumn("low", T.ascii_lower(F.col("text")))
    start = F.struct(F.col("text").alias("text"), F.col("low").alias("low"), (F.col("text") == "").alias("gone"))
    met = both.withColumn("r", F.aggregate(F.coalesce("visuals", F.array().cast(pages.schema["visuals"].dataType)), start, step))
    return met.filter("NOT r.gone").withColumn("text", F.col("r.text")).drop("r", "visuals", "low")
