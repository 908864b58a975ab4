"""What passes from page to page: lines and paragraphs that go on overleaf, diagrams, and forms after the references.

Rows are keyed (doc_id, page, ...) and pages are numbered without holes; a page without rows stands between its neighbours."""

from __future__ import annotations

import sys
from collections import defaultdict
from math import floor

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.functions import text as T
from . import rules
from .layout import PAGE, WIDTH, cx, cy

# Executors may not find this package, so its functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of one document's diagram, and phrases of forms behind the references.
DIAGRAM_WORDS = ["biotechnography", "bi ot echnogr"]
FORM_WORDS = [
    "subscription claims", "we provide this form", "print full name", "please print clearly", "to be filled out by", "please do not remove",
    "photocopy may be used", "member or customer", "today's date", "subscription claims information",
]


def carried(rows: DataFrame, at: str, ends: Column, starts: Column) -> DataFrame:
    """rows with `taken`, the text that the last row of a page gets from the next page; rows given away are gone.

    A page gives its first row if the page before ends openly (`ends`), the row may go on (`starts`), and the page before has not
    given away its only row. The last condition looks back one page only, so along pages of one row giving alternates."""
    pages = rows.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("rows"), F.min(at).alias("top"), F.max(at).alias("bottom"),
        F.min_by(F.struct(F.col("text").alias("text"), starts.alias("ok")), at).alias("head"), F.max_by(ends, at).alias("open"),
    )
    order = Window.partitionBy("doc_id").orderBy("page")
    before = (F.lag("page").over(order) == F.col("page") - 1) & F.lag("open").over(order) & F.col("head.ok")
    pages = pages.withColumn("can", F.coalesce(before, F.lit(False))).withColumn("hangs", F.col("can") & (F.lag("rows").over(order) == 1))
    pages = pages.withColumn("chain", F.sum((~F.col("hangs")).cast("int")).over(order))
    link = Window.partitionBy("doc_id", "chain").orderBy("page")
    pages = pages.withColumn("gives", F.first("can").over(link) == (F.row_number().over(link) % 2 == 1))
    pages = pages.withColumn("next", F.lead(F.when(F.col("gives"), F.col("head.text"))).over(order)).select(*PAGE, "top", "bottom", "gives", "next")
    met = rows.join(pages, PAGE).filter(~(F.col("gives") & (F.col(at) == F.col("top"))))
    return met.withColumn("taken", F.when(F.col(at) == F.col("bottom"), F.col("next"))).drop("top", "bottom", "gives", "next")


def stitch_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line_no, text): a page's last line that ends in a hyphen takes on the next page's first line."""
    met = carried(lines, "line_no", F.col("text").endswith("-"), F.lit(True))
    return met.withColumn("text", F.when(F.col("taken").isNull(), F.col("text")).otherwise(F.concat(F.regexp_replace("text", "-$", ""), "taken"))).drop("taken")


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block_no, kind, text): a page's last paragraph that doesn't end a sentence takes on the next page's first; its
    hyphen goes."""
    plain = F.col("kind") == "Paragraph"
    met = carried(blocks, "block_no", plain & ~T.ends_sentence(F.col("text")), plain)
    return met.withColumn("text", F.when(F.col("taken").isNull(), F.col("text")).otherwise(T.appended(F.col("text"), F.col("taken")))).drop("taken")


def without_diagrams(blocks: DataFrame, where: Column | None = None) -> DataFrame:
    """Blocks (doc_id, block_no, kind, text) without those from a paragraph with one of DIAGRAM_WORDS to the next caption; that
    paragraph keeps what stands before the word. where: of which documents."""
    low = T.ascii_lower(F.col("text"))
    place = F.lit(0)
    for word in reversed(DIAGRAM_WORDS):
        place = F.when(low.contains(word), F.instr(low, word)).otherwise(place)
    rows = blocks.withColumn("place", F.when((F.col("kind") == "Paragraph") & (F.lit(True) if where is None else where), place).otherwise(0))
    earlier = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(F.col("place") > 0, True).when(F.col("kind") == "Caption", False)
    rows = rows.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(earlier), F.lit(False)))
    rows = rows.withColumn("text", F.when(F.col("place") > 0, T.trim(F.substring("text", F.lit(1), F.col("place") - 1))).otherwise(F.col("text")))
    return rows.filter(F.when(F.col("place") > 0, F.col("text") != "").otherwise(~F.col("inside") | (F.col("kind") == "Caption"))).drop("place", "inside")


def early_text(lines: DataFrame, pages: int = 2) -> DataFrame:
    """doc_id, early: the lines (doc_id, page, line_no, text) of the first pages."""
    held = lines.filter(F.col("page") < pages).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))).alias("l"))
    return held.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("early"))


def orientation(boxes: DataFrame) -> DataFrame:
    """doc_id, page, top_is_high: whether the abstract, or else the title, has a greater y than the permission; true if unknown."""
    low = T.ascii_lower(F.col("text"))
    first = lambda hit: F.min_by(F.when(hit, cy()), F.when(hit, F.col("box_id")))
    found = boxes.groupBy(*PAGE).agg(
        first(low == "abstract").alias("a"), first(low.contains("copyright") | low.contains("permission")).alias("c"), first(low.isin("storyspace", "storyspace 1")).alias("t")
    )
    return found.select(*PAGE, F.coalesce(F.col("a") > F.col("c"), F.col("t") > F.col("c"), F.lit(True)).alias("top_is_high"))


#: What a box is, as bits: it counts for rows, lies left or right, has a text, is wide, holds a form's phrase, starts an appendix.
COUNTS, LEFT, RIGHT, SOME, WIDE, FORM, APPENDIX = (1 << i for i in range(7))


def rows_of(tops: list[float], sides: list[int]) -> list[list]:
    """Rows [y, sides] of boxes in order: a box joins the first row within 3 points, whose y becomes the mean of both. Rows are found by
    stretches of 4 points, of which a box looks into three."""
    bands, near = [], defaultdict(set)
    for y, side in zip(tops, sides):
        cell = floor(y / 4)
        at = min((i for c in (cell - 1, cell, cell + 1) if c in near for i in near[c] if abs(bands[i][0] - y) <= 3.0), default=None)
        if at is None:
            near[cell].add(len(bands))
            bands.append([y, side])
            continue
        old, new = bands[at][0], (bands[at][0] + y) * 0.5
        bands[at] = [new, bands[at][1] | side]
        if floor(old / 4) != floor(new / 4):
            near[floor(old / 4)].discard(at)
            near[floor(new / 4)].add(at)
    return bands


def form_top(tops: np.ndarray, marks: np.ndarray, height: float, start: float) -> float | None:
    """Where a page's form begins: its first row under the last row of two columns, if what stands below looks like a form."""
    counted = ((marks & COUNTS) > 0) & (tops >= start)
    bands = rows_of(tops[counted].tolist(), marks[counted].tolist())
    both = [y for y, side in bands if side & LEFT and side & RIGHT]
    if not both:
        return None
    limit = max(both) + max(14.0, max(8.0, height if height > 0 else 12.0) * 1.6)
    drop = min((y for y, _ in bands if y > limit), default=None)
    if drop is None:
        return None
    seen = int(np.bitwise_or.reduce(marks[(tops + 1 >= drop) & ((marks & SOME) > 0)], initial=0))
    return drop if seen & FORM or (seen & WIDE and not seen & APPENDIX) else None


def _field(name: str):
    return lambda x: x[name]


def row_bands(b: Column) -> Column:
    """Rows (y, left, right) of boxes (y0, left, right) in order, as `rows_of` finds them."""

    @F.pandas_udf("array<struct<y:double,left:boolean,right:boolean>>")
    def bands(tops: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        sides = [[LEFT * bool(x) | RIGHT * bool(y) for x, y in zip(a, b)] for a, b in zip(left, right)]
        return pd.Series([[{"y": y, "left": bool(x & LEFT), "right": bool(x & RIGHT)} for y, x in rows_of(list(t), s)] for t, s in zip(tops, sides)])

    return bands(*[F.transform(b, _field(c)) for c in ("y0", "left", "right")])


@F.pandas_udf(DoubleType())
def _form_tops(tops: pd.Series, marks: pd.Series, height: pd.Series, start: pd.Series) -> pd.Series:
    held = [None if t is None else form_top(np.asarray(t, float), np.asarray(m, np.int64), h, s) for t, m, h, s in zip(tops, marks, height, start)]
    return pd.Series(held, dtype="float64")


def post_references(boxes: DataFrame) -> DataFrame:
    """boxes (with region and median_height) in which all from the first single row under the last row of two columns is Metadata, on
    pages from the references on, if it looks like a publisher's form: a phrase of one below, or a wide box without an appendix.

    Pages and their predecessors are windows and groups over keys that begin with doc_id, so boxes dealt by doc_id stay where they are.
    Rows grow box by box, which plain Python does for the places and marks of those pages that may hold a form."""
    columns = boxes.columns
    low = T.ascii_lower(F.col("text"))
    heading = rules.is_references_heading(F.col("text"))
    rows = boxes.withColumn("active", F.max(heading).over(Window.partitionBy("doc_id").orderBy("page")))
    short = T.size(F.col("text")) < 80
    phrase = T.contains_any(low, FORM_WORDS) | (short & low.contains("american psychological association")) | (short & low.startswith("american psychological"))
    bit = lambda n, hit: F.when(hit, n).otherwise(0)
    marks = (
        bit(COUNTS, (F.col("region") == "Body") & (F.col("x1") - F.col("x0") >= WIDTH * 0.04) & (T.trim(F.col("text")) != ""))
        + bit(LEFT, cx() < WIDTH / 2 - 8) + bit(RIGHT, cx() > WIDTH / 2 + 8) + bit(SOME, low != "")
        + bit(WIDE, F.col("x1") - F.col("x0") > WIDTH * 0.55) + bit(FORM, phrase) + bit(APPENDIX, low.startswith("appendix") | low.startswith("acknowledg"))
    )
    row = F.struct("box_id", "y0", F.col("marks"), F.struct(*columns).alias("row"))
    pages = rows.withColumn("marks", marks).groupBy(*PAGE).agg(
        F.first("active").alias("active"), F.coalesce(F.first("median_height"), F.lit(0.0)).alias("height"), F.bit_or("marks").alias("any"),
        F.min_by(F.when(heading, F.col("y0")), F.when(heading, F.col("box_id"))).alias("top"), F.sort_array(F.collect_list(row)).alias("b"),
    )
    may = F.col("active") & (F.col("any").bitwiseAND(FORM | WIDE) > 0)
    listed = lambda name: F.when(may, F.transform("b", lambda x: x[name]))
    pages = pages.withColumn("drop_y", _form_tops(listed("y0"), listed("marks"), F.col("height"), F.coalesce(F.col("top") + 4, F.lit(0.0))))
    out = pages.select("drop_y", F.explode("b").alias("x")).select("drop_y", "x.row.*")
    return out.withColumn("region", F.when(F.col("y0") + 1 >= F.col("drop_y"), "Metadata").otherwise(F.col("region"))).drop("drop_y")
