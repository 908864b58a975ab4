"""Page geometry: medians, columns, captions, regions, reading order. Boxes are keyed (doc_id, page, box_id) with x0, y0, x1, y1,
text, font_size, rotation; pages are WIDTH by HEIGHT points unless columns say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from . import rules

WIDTH, HEIGHT, BINS = 600.0, 800.0, 240
PAGE = ["doc_id", "page"]
BAND, MARGIN, SIDEBAR, FOOTNOTE_ZONE = 0.06, 0.045, 0.30, 0.82
# Words of page regions.
MARGIN_WORDS = ["copyright", "american psychological association", "personal use", "disseminated broadly"]
HEADER_WORDS = ["frontiers in", "communications of the acm", "addis and krasnow", "attitudes toward treatment manuals", "doi"]
FOOTER_WORDS = ["frontiersin.org", "communications of the acm", "copyright", "permission to make digital"]
RAIL_HEADS, RAIL_HEAD_WORDS = ["chin and kirkpatrick", "frontiersin.org"], ["10.3389/fpos.2023.1077945"]
CONFERENCE_WORDS = ["permission to make digital", "ht'02", "copyright 2002 acm"]
METADATA_WORDS = ["open access", "reviewed by", "edited by", "specialty section", "correspondence", "creative commons"]


def cx() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def cy() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def is_left() -> Column:
    return cx() < WIDTH * 0.5


def upper_median(values: Column) -> Column:
    """The element at half the length, of the sorted values that aren't null; 0 of none."""
    held = F.sort_array(F.collect_list(values))
    return F.coalesce(F.get(held, F.floor(F.size(held) / 2).cast("int")), F.lit(0.0))


def medians(boxes: DataFrame) -> DataFrame:
    """doc_id, page, median_font, median_height."""
    size, height = F.col("font_size"), F.col("y1") - F.col("y0")
    return boxes.groupBy(*PAGE).agg(upper_median(F.when(size > 0, size)).alias("median_font"), upper_median(F.when(height > 0, height)).alias("median_height"))


def _spans(boxes: DataFrame) -> DataFrame:
    """doc_id, page, span: first and last bin (lo, hi) under each body box narrower than 0.6 of the page."""
    last = F.lit(BINS - 1)
    bin_of = lambda x: F.least(last, F.greatest(F.lit(0), x)).cast("int")
    narrow = boxes.filter((F.col("region") == "Body") & (F.col("x1") - F.col("x0") <= WIDTH * 0.60))
    return narrow.select(*PAGE, F.struct(bin_of(F.floor(F.col("x0") / WIDTH * BINS)).alias("lo"), bin_of(F.ceil(F.col("x1") / WIDTH * BINS)).alias("hi")).alias("span"))


def _covered(boxes: DataFrame) -> DataFrame:
    """doc_id, page, held: the spans of pages of 30 or more."""
    return _spans(boxes).groupBy(*PAGE).agg(F.collect_list("span").alias("held")).filter(F.size("held") >= 30)


def histogram(boxes: DataFrame) -> DataFrame:
    """doc_id, page, bin, n: how many narrow body boxes cover each of BINS bins, of boxes with region; pages of 30 such boxes or more.

    A box counts at its two ends only; between two ends of a page the number is the same, so bins are written from runs."""
    end = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    ends = _spans(boxes).select(*PAGE, F.explode(F.array(end(F.col("span.lo"), 1), end(F.col("span.hi") + 1, -1))).alias("x"))
    steps = ends.groupBy(*PAGE, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"), F.count_if(F.col("x.d") > 0).alias("begun"))
    held = steps.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("at", "d"))).alias("steps"), F.sum("begun").alias("boxes")).filter("boxes >= 30")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))
    run = lambda acc, at: F.concat(acc["out"], F.array_repeat(acc["n"], at - acc["at"]))
    step = lambda acc, x: F.struct(x["at"].alias("at"), (acc["n"] + x["d"]).alias("n"), run(acc, x["at"]).alias("out"))
    return held.select(*PAGE, F.posexplode(F.aggregate("steps", start, step, lambda acc: run(acc, F.lit(BINS)))).alias("bin", "n"))


def widest_gap(held: Column) -> Column:
    """(length, start) of the longest run of bins in the page's middle that one box at most covers; first of equals; 0 if none.

    The ends of boxes are put in order and read once: between two of them the number of boxes over the page is the same."""
    lo, hi = int(BINS * 0.28), int(BINS * 0.72)
    clip = lambda x: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    ends = F.flatten(F.transform(held, lambda x: F.array(F.struct(clip(x["lo"]).alias("at"), F.lit(1).alias("d")), F.struct(clip(x["hi"] + 1).alias("at"), F.lit(-1).alias("d")))))
    order = F.sort_array(F.concat(ends, F.array(F.struct(F.lit(hi).alias("at"), F.lit(0).alias("d")))))
    none = F.struct(F.lit(lo).alias("at"), F.lit(0).alias("n"), F.lit(lo).alias("start"), F.lit(0).alias("k"), F.lit(0).alias("a"))

    def step(acc: Column, x: Column) -> Column:
        # the run that ends here: bins from acc.start on if they are free, else none
        start = F.when(acc["n"] > 1, x["at"]).otherwise(acc["start"])
        longer = x["at"] - start > acc["k"]
        return F.struct(
            x["at"].alias("at"), (acc["n"] + x["d"]).alias("n"), start.alias("start"),
            F.when(longer, x["at"] - start).otherwise(acc["k"]).alias("k"), F.when(longer, start).otherwise(acc["a"]).alias("a"),
        )

    return F.aggregate(order, none, step, lambda acc: F.struct(acc["k"].alias("k"), acc["a"].alias("a")))


def column_cut(boxes: DataFrame, least_gap: float = 12.0) -> DataFrame:
    """doc_id, page, gap, cut: middle of the widest gap between columns, of boxes with region."""
    found = _covered(boxes).select(*PAGE, widest_gap(F.col("held")).alias("r"))
    gap, cut = F.col("r.k") * WIDTH / BINS, (F.col("r.a") * 2 + F.col("r.k")) * 0.5 / BINS * WIDTH
    return found.select(*PAGE, gap.alias("gap"), cut.alias("cut")).filter((F.col("r.k") > 0) & (F.col("gap") >= least_gap))


def gap_column(boxes: DataFrame, least_gap: float = 12.0) -> DataFrame:
    """doc_id, page, cut: middle of the gap between sorted starts nearest the page's middle, whose right end lies in the middle, if over 15
    boxes' centres lie on either side; pages of 20 boxes."""
    page = Window.partitionBy(*PAGE)
    gaps = boxes.withColumn("before", F.lag("x0").over(page.orderBy("x0", "box_id"))).withColumn("all", F.count(F.lit(1)).over(page))
    wide = (F.col("all") >= 20) & (F.col("x0") - F.col("before") >= least_gap) & (F.col("x0") > 0.28 * WIDTH) & (F.col("x0") < 0.72 * WIDTH)
    mid = (F.col("before") + F.col("x0")) / 2
    near = F.min(F.when(wide, F.struct(F.abs(mid - WIDTH / 2).alias("d"), mid.alias("m")))).over(page)
    sides = gaps.select(*PAGE, cx().alias("c"), near["m"].alias("cut")).filter("cut IS NOT NULL")
    counts = sides.groupBy(*PAGE, "cut").agg(F.count_if(F.col("c") < F.col("cut")).alias("l"), F.count_if(F.col("c") >= F.col("cut")).alias("r"))
    return counts.filter("l > 15 AND r > 15").select(*PAGE, "cut")


def box_quality(boxes: DataFrame) -> DataFrame:
    """doc_id, page, quality of body boxes: 0 under 40 bytes or 8 words, else 1 less four times the suspect share, 0.25 at least. A word over
    24 bytes counts once, one with a bad byte twice."""
    words = F.filter(T.words(F.col("text")), lambda w: w != "")
    bad = F.aggregate(words, F.lit(0), lambda acc, w: acc + (T.size(w) > 24).cast("int") + T.has_suspect_byte(w).cast("int") * 2)
    body = boxes.groupBy(*PAGE).agg(*[F.sum(F.when(F.col("region") == "Body", x).otherwise(0)).alias(n) for n, x in (("bytes", T.size(F.col("text"))), ("words", F.size(words)), ("bad", bad))])
    share = F.least(F.lit(0.75), F.col("bad").cast("double") / F.col("words") * 4.0)
    return body.select(*PAGE, F.when((F.col("bytes") < 40) | (F.col("words") < 8), 0.0).otherwise(1.0 - share).alias("quality"))


def is_note_number(middle: Column) -> Column:
    """Small short numbers at a column's start, low on the page."""
    x, y0 = F.col("x0") / WIDTH, F.col("y0")
    small = (middle <= 0) | (F.col("y1") - y0 <= middle * 0.82)
    return T.is_digits(F.col("text")) & (T.size(F.col("text")) <= 2) & (y0 >= HEIGHT * 0.68) & small & ((x < 0.15) | (F.abs(x - 0.53) < 0.055))


def footnote_start(boxes: DataFrame) -> DataFrame:
    """doc_id, page, start_left, start_right: the top of a half page's footnotes by their numbers; HEIGHT + 1 if none."""
    rows = middle_of("height", "median_height", boxes.withColumn("height", F.col("y1") - F.col("y0")))
    rows = rows.withColumn("hit", is_note_number(F.col("median_height")))
    top = lambda side: F.coalesce(F.min(F.when(F.col("hit") & side, F.col("y0"))), F.lit(HEIGHT + 1))
    return rows.groupBy(*PAGE).agg(top(is_left()).alias("start_left"), top(~is_left()).alias("start_right"))


SEED, NUMBER = r"(?i)^(figure|fig\.|table)(?:\s+\d+[a-z]?[\.:]?)?$", r"^\d+[A-Za-z]?[\.:]?$"


def with_seeds(boxes: DataFrame) -> DataFrame:
    """boxes with left and seed: the words figure, fig. and table with a number close to the right on their row and nothing to the left.
    A row is a range of y over the half page, so its boxes meet in one window."""
    row = "OVER (PARTITION BY doc_id, page, `left` ORDER BY y0 RANGE BETWEEN 2.5D PRECEDING AND 2.5D FOLLOWING)"
    rows = boxes.withColumn("left", is_left()).withColumn("named", F.col("text").rlike(SEED)).withColumn("number_at", F.when(F.col("text").rlike(NUMBER), F.col("x0")))
    rows = rows.withColumn("numbers", F.expr(f"collect_list(number_at) {row}")).withColumn("first", F.expr(f"min(x1) {row}"))
    after = F.exists("numbers", lambda x: (x > F.col("x1")) & (x - F.col("x1") < 45))
    seed = F.col("named") & (after | F.col("text").rlike(r"\d")) & ~(F.col("first") < F.col("x0"))
    return rows.withColumn("seed", F.coalesce(seed, F.lit(False))).drop("named", "number_at", "numbers", "first")


def caption_seeds(boxes: DataFrame) -> DataFrame:
    """doc_id, page, box_id of caption seeds."""
    return with_seeds(boxes).filter("seed").select(*PAGE, "box_id")


def override_hits(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, page, box_id, role: the first region (page, region_ord, role, x0..y1) whose rectangle holds the box's centre."""
    r = regions.select("page", "region_ord", "role", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    hits = boxes.join(r, "page").filter(cx().between(F.col("r_x0"), F.col("r_x1")) & cy().between(F.col("r_y0"), F.col("r_y1")))
    return hits.groupBy(*PAGE, "box_id").agg(F.min_by("role", "region_ord").alias("role"))


def page_points(regions: DataFrame) -> DataFrame:
    """Region rectangles in points from the top left: shares are scaled, bottom origins turned over, corners put in order."""
    w, h = F.when(F.col("fractional"), WIDTH).otherwise(1.0), F.when(F.col("fractional"), HEIGHT).otherwise(1.0)
    x = [F.col(c) * w for c in ("x0", "x1")]
    y = [F.when(F.col("top_origin"), F.col(c) * h).otherwise(HEIGHT - F.col(c) * h) for c in ("y0", "y1")]
    return regions.select("page", "region_ord", "role", F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))


def middle_of(x: str, tag: str, rows: DataFrame) -> DataFrame:
    """rows with the upper median of column x over its page, of values above 0; 0 if none. Values are counted, not sorted, so a page's rows
    needn't come in the order of x, and no row holds a list."""
    at = f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {x} > 0 THEN {x} END DESC) OVER (PARTITION BY {', '.join(PAGE)})"
    return rows.withColumn(tag, F.coalesce(F.expr(at), F.lit(0.0)))


def role_of(page: Column, overrides: dict) -> Column:
    """The role of the first override region of the page that holds the box's centre; null if none."""
    role = F.lit(None).cast("string")
    for number, entry in overrides.items():
        for r in reversed(entry["regions"]):
            w, h = (WIDTH, HEIGHT) if r["fractional"] else (1.0, 1.0)
            x = sorted((r["box"][0] * w, r["box"][2] * w))
            y = sorted((v * h if r["top_origin"] else HEIGHT - v * h) for v in (r["box"][1], r["box"][3]))
            role = F.when((page == number) & cx().between(*x) & cy().between(*y), rules.region_kind(F.lit(r["role"]))).otherwise(role)
    return role


def classify(boxes: DataFrame, overrides: dict | None = None) -> DataFrame:
    """boxes with region and median_height: the first rule that holds. Layout families come from a column `family`, generic if there is
    none; overrides by page as `settings.overrides` gives them. Medians, footnote starts and caption seeds are windows over the page and
    its halves, so boxes are dealt once, by document and page."""
    if "family" not in boxes.columns:
        boxes = boxes.withColumn("family", F.lit("generic"))
    overrides = overrides or {}
    page = Window.partitionBy(*PAGE)
    low, y0, y1 = F.col("low"), F.col("y0"), F.col("y1")
    # the seeds' order, by page, half and height, serves all windows behind it
    rows = with_seeds(boxes).withColumn("height", F.col("y1") - F.col("y0")).withColumn("low", T.ascii_lower(F.col("text")))
    rows = middle_of("height", "median_height", middle_of("font_size", "median_font", rows))
    rows = rows.withColumn("note", is_note_number(F.col("median_height")))
    for side, half in (("left", is_left()), ("right", ~is_left())):
        rows = rows.withColumn(f"start_{side}", F.coalesce(F.min(F.when(F.col("note") & half, y0)).over(page), F.lit(HEIGHT + 1)))
    start = F.when(is_left(), F.col("start_left")).otherwise(F.col("start_right"))
    edge = (F.col("x0") < WIDTH * MARGIN) | (F.col("x1") > WIDTH * (1 - MARGIN))
    number = T.is_digits(F.col("text"))
    family = F.col("family")
    rail, acm, first = family == "frontiers", family == "acm", F.col("page") == 0
    keeps = F.col("page").isin([p for p, x in overrides.items() if x["keep_captions"]])
    role = role_of(F.col("page"), overrides)
    font, middle = F.col("font_size"), F.col("median_font")
    region = (
        F.when(rules.is_wrapper(family, F.col("page")), "Wrapper")
        .when(F.col("text") == "", "Metadata")
        .when(role.isNotNull(), role)
        .when(rail & (low.isin(RAIL_HEADS) | T.contains_any(low, RAIL_HEAD_WORDS)), "Header")
        .when((F.col("rotation") != 0) | (edge & T.contains_any(low, MARGIN_WORDS)), "MarginOverlay")
        .when(rail & ~first & (y0 < HEIGHT * BAND), "Header")
        .when((y0 < HEIGHT * BAND) & (number | T.contains_any(low, HEADER_WORDS)), "Header")
        .when((y1 > HEIGHT * (1 - BAND)) & (number | T.contains_any(low, FOOTER_WORDS)), "Footer")
        .when(F.col("seed") & ~acm & ~keeps, "Float")
        .when((start <= HEIGHT) & (y0 >= start - 1.0), "Footnote")
        .when(rail & first & (F.col("x1") <= WIDTH * SIDEBAR), "Sidebar")
        .when(rail & first & (F.col("x0") > WIDTH * SIDEBAR) & (y0 > HEIGHT * 0.72), "Footnote")
        .when(T.contains_any(low, METADATA_WORDS), "Metadata")
        .when(acm & T.contains_any(low, CONFERENCE_WORDS), "Metadata")
        .when((family == "scan") & first & (y0 > HEIGHT * 0.72) & (F.col("x1") < WIDTH * 0.50) & ((middle == 0) | (font < middle * 0.90)), "AuthorNote")
        .when((y0 > HEIGHT * FOOTNOTE_ZONE) & (middle > 0) & (font > 0) & (font < middle * 0.82), "Footnote")
        .otherwise("Body")
    )
    # a filter by region, or several uses of it, would compute the rules again for each: a generated column is computed once
    return rows.withColumn("region", F.explode(F.array(region))).drop("seed", "left", "note", "height", "low", "start_left", "start_right", "median_font")


def float_islands(boxes: DataFrame) -> DataFrame:
    """boxes (with region, median_height) in which rows below a caption seed, up to the first wide gap in its half page, are Float.

    Rows within 2 points of the last are one. A half page's bands are read once, at its first box, from its seeds and rows; wrapper
    pages have no seeds."""
    half = Window.partitionBy(*PAGE, "left")
    rows = boxes.withColumn("left", is_left()).withColumn("seeded", F.max(F.col("region") == "Float").over(half))
    rows = rows.withColumn("at", F.row_number().over(half.orderBy("y0", "box_id")))
    own = Window.partitionBy(*PAGE, "left").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("starts", F.collect_set(F.when(F.col("region") == "Float", F.col("y0"))).over(half))
    rows = rows.withColumn("tops", F.collect_set(F.when(F.col("seeded"), F.col("y0"))).over(half))
    height = F.col("median_height")
    wide = F.greatest(F.lit(18.0), height * 1.8)

    def band(start: Column) -> Column:
        tops = F.array_sort(F.filter("tops", lambda y: y + 1.0 >= start))
        begun = F.struct((start + F.greatest(F.lit(18.0), height * 2.0)).alias("finish"), start.alias("last"), F.lit(None).cast("double").alias("kept"), F.lit(False).alias("over"))

        def step(acc: Column, y: Column) -> Column:
            same = F.coalesce(F.abs(acc["kept"] - y) <= 2.0, F.lit(False))
            read = ~same & ~acc["over"] & (y >= start)
            ends = read & (y - acc["last"] > wide)
            goes = read & ~ends
            return F.struct(
                F.when(goes, y + height * 1.2).otherwise(acc["finish"]).alias("finish"), F.when(goes, y).otherwise(acc["last"]).alias("last"),
                F.when(same, acc["kept"]).otherwise(y).alias("kept"), (acc["over"] | ends).alias("over"),
            )

        return F.struct((start - 2.0).alias("a"), F.aggregate(tops, begun, step, lambda acc: acc["finish"]).alias("z"))

    rows = rows.withColumn("bands", F.first(F.when((F.col("at") == 1) & F.col("seeded"), F.transform("starts", band)), ignorenulls=True).over(own))
    inside = F.exists("bands", lambda x: F.col("y0").between(x["a"], x["z"]))
    return rows.withColumn("region", F.when(F.coalesce(inside, F.lit(False)), "Float").otherwise(F.col("region"))).drop("left", "seeded", "at", "starts", "tops", "bands")


def visual_lines(boxes: DataFrame) -> DataFrame:
    """doc_id, page, line, region, text: boxes outside the body by rows of one region within 2.5 points of the box before."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "box_id")
    rows = boxes.filter("region <> 'Body'")
    new = (F.abs(F.col("y0") - F.lag("y0").over(order)) > 2.5) | (F.col("region") != F.lag("region").over(order))
    runs = rows.withColumn("new", F.coalesce(new, F.lit(True))).withColumn("line", F.sum(F.col("new").cast("int")).over(order))
    held = runs.groupBy(*PAGE, "line").agg(F.min("region").alias("region"), F.sort_array(F.collect_list(F.struct("y0", "x0", "box_id", "text"))).alias("b"))
    return held.select(*PAGE, "line", "region", attached(F.transform("b", lambda x: x["text"])).alias("text"))


def attached(words: Column) -> Column:
    """Words put together: no blank before punctuation that leans left, nor around a hyphen."""
    lean = lambda w: w.rlike(r"""^[.,;:)\]}?!%']""") | w.startswith("-")
    return F.aggregate(words, F.lit(""), lambda acc, w: F.when((acc == "") | lean(w) | acc.endswith("-"), F.concat(acc, w)).otherwise(F.concat(acc, F.lit(" "), w)))


def linearize(boxes: DataFrame, tolerance: float = 2.5, least_gap: float = 12.0, overrides: dict | None = None) -> DataFrame:
    """doc_id, page, line_no, text of body boxes (with region and family) in reading order: boxes over 0.6 of the page, then the left
    column, then the right, where the page has a cut. Magazine, conference and scanned pages are cut at their widest gap, rail pages
    from the third on in the middle, others not; an override's cut comes first.

    Boxes within 1.5 points of the first of their row go by x; a line goes on while a box lies within `tolerance` of the line's first
    box. Both are read once along the page's boxes, so that drifting rows end where they should."""
    if "family" not in boxes.columns:
        boxes = boxes.withColumn("family", F.lit("generic"))
    body = boxes.filter("region = 'Body'")
    last = F.lit(BINS - 1)
    bin_of = lambda x: F.least(last, F.greatest(F.lit(0), x)).cast("int")
    wide = F.col("x1") - F.col("x0") > WIDTH * 0.60
    span = F.when(~wide, F.struct(bin_of(F.floor(F.col("x0") / WIDTH * BINS)).alias("lo"), bin_of(F.ceil(F.col("x1") / WIDTH * BINS)).alias("hi")))
    pages = body.groupBy(*PAGE).agg(
        F.min("family").alias("family"), F.collect_list(span).alias("held"),
        F.collect_list(F.struct("y0", "x0", "box_id", cx().alias("cx"), wide.alias("wide"), "text")).alias("b"),
    )
    by_gap = F.when(F.col("family").isin("magazine", "acm", "scan") & (F.size("held") >= 30), widest_gap(F.col("held")))
    pages = pages.withColumn("r", by_gap)
    cut = F.when((F.col("r.k") > 0) & (F.col("r.k") * WIDTH / BINS >= least_gap), (F.col("r.a") * 2 + F.col("r.k")) * 0.5 / BINS * WIDTH)
    cut = F.when((F.col("family") == "frontiers") & (F.col("page") >= 2), WIDTH * 0.5).otherwise(cut)
    for number, entry in (overrides or {}).items():
        if entry["column_cut"] is not None:
            cut = F.when(F.col("page") == number, F.lit(float(entry["column_cut"]) * (WIDTH if entry["cut_fractional"] else 1.0))).otherwise(cut)
    rows = pages.withColumn("cut", cut).select(*PAGE, "cut", F.explode("b").alias("x")).select(*PAGE, "cut", "x.*")
    rows = rows.withColumn("column", F.when(F.col("cut").isNull(), 0).when(F.col("wide"), -1).when(F.col("cx") >= F.col("cut"), 1).otherwise(0))
    parts = _reading(rows, 1.5, tolerance)
    text = T.collapse(attached(F.transform("b", lambda x: x["text"])))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "at")) - 1
    return parts.select(*PAGE, number.alias("line_no"), text.alias("text"))


def _reading(rows: DataFrame, level: float, tolerance: float) -> DataFrame:
    """doc_id, page, column, at, b: the boxes of each line, of rows with a column. All keys hold the page's, so nothing is dealt again."""
    held = rows.groupBy(*PAGE, "column").agg(F.sort_array(F.collect_set("y0")).alias("tops"), F.collect_list(F.struct("y0", "x0", "box_id", "text")).alias("b"))
    held = held.withColumn("rows", _rows("tops", level))
    row = F.get("rows", (F.array_position("tops", F.col("x.y0")) - 1).cast("int"))
    placed = held.select(*PAGE, "column", "tops", "rows", F.explode("b").alias("x")).select(*PAGE, "column", "x.*", row.alias("row"))
    order = F.sort_array(F.collect_list(F.struct("row", "x0", "box_id", "y0", "text")))
    lines = placed.groupBy(*PAGE, "column").agg(order.alias("b")).withColumn("line", _lines(tolerance))
    parts = lines.select(*PAGE, "column", F.explode(F.arrays_zip("line", "b")).alias("z")).groupBy(*PAGE, "column", F.col("z.line").alias("at"))
    return parts.agg(F.sort_array(F.collect_list(F.struct("z.b.row", "z.b.x0", "z.b.box_id", "z.b.text"))).alias("b"))


def _rows(tops: str, tolerance: float) -> Column:
    """The row of each of sorted numbers: one over `tolerance` from the one that started the last starts the next."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, y: Column) -> Column:
        new = F.coalesce(y - acc["first"] > tolerance, F.lit(True))
        n = acc["n"] + new.cast("int")
        return F.struct(F.when(new, y).otherwise(acc["first"]).alias("first"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate(tops, start, step, lambda acc: acc["out"])


def _lines(tolerance: float) -> Column:
    """The line of each box in b: a box further from the line's first than `tolerance` starts the next."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.coalesce(F.abs(x["y0"] - acc["first"]) > tolerance, F.lit(True))
        n = acc["n"] + new.cast("int")
        return F.struct(F.when(new, x["y0"]).otherwise(acc["first"]).alias("first"), n.alias("n"), F.concat(acc["out"], F.array(n)).alias("out"))

    return F.aggregate("b", start, step, lambda acc: acc["out"])


def merged_lines(boxes: DataFrame, columns: DataFrame, tolerance: float = 2.5, top_is_high: bool = False) -> DataFrame:
    """doc_id, page, line_no, text: boxes by column and row, without regions or punctuation rules. columns: doc_id, page, cut."""
    rows = boxes.join(columns.select(*PAGE, "cut"), PAGE, "left").withColumn("column", F.coalesce((cx() >= F.col("cut")).cast("int"), F.lit(0)))
    parts = _reading(rows.withColumn("y0", -F.col("y0")) if top_is_high else rows, 1.0, tolerance)
    joined = F.aggregate(F.transform("b", lambda x: x["text"]), F.lit(""), lambda acc, w: F.when((acc == "") | acc.endswith("-"), F.concat(acc, w)).otherwise(F.concat(acc, F.lit(" "), w)))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "at")) - 1
    return parts.select(*PAGE, number.alias("line_no"), T.collapse(joined).alias("text"))
