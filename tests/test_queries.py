"""Each query against DuckDB, and hand-made documents."""

import math

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import blocks, layout, lines, overleaf, streams
from quire.plans import catalog

SF = "/root/testdata/sf0.001"


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_as_duckdb(spark, name):
    import duckdb

    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = c.sql(catalog.oracle_sql()[name]).df()
    assert len(want)
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def as_lines(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, raw string")


def test_stream_lines(spark):
    got = lines.stream_lines(as_lines(spark, ["foo exam-", "ple bar", "", "Baz", "end-", "", "less"])).orderBy("line_no").collect()
    assert [r.text for r in got] == ["foo example bar", "Baz", "end-", "less"]


def test_blocks(spark):
    texts = ["Journal X 2020", "Abstract", "We study", "things.", "open access", "More text here.", "1 Introduction", "Alpha beta"]
    rows = as_lines(spark, texts).withColumnRenamed("raw", "text")
    got = blocks.generic_blocks(rows).orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in got] == [("Heading", "Abstract"), ("Paragraph", "We study things."), ("Paragraph", "More text here."), ("Heading", "1 Introduction"), ("Paragraph", "Alpha beta")]


BOX = "doc_id long, page int, box_id int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, rotation int, region string, family string"


def boxes_of(spark, rows, region="Body", family="magazine", page=1):
    """Boxes from (text, x0, y0, x1), 10 points high."""
    return spark.createDataFrame([(1, page, i, t, x0, y0, x1, y0 + 10.0, 10.0, 0, region, family) for i, (t, x0, y0, x1) in enumerate(rows)], BOX)


def test_gutter(spark):
    # left words span 50 to 272, right words start at 310: bins 110 to 123 are free
    spans = [(50.0, 160.0), (150.0, 272.0), (310.0, 430.0), (420.0, 550.0)]
    df = boxes_of(spark, [("w", a, 100.0 + 12 * (k // 4), b) for k in range(64) for a, b in [spans[k % 4]]])
    assert [(r.gap, r.cut) for r in layout.column_cut(df).collect()] == [(35.0, 292.5)]
    bins = {r.bin: r.n for r in layout.histogram(df).collect()}
    assert len(bins) == 240 and [b for b, n in bins.items() if 67 <= b < 172 and n <= 1] == list(range(110, 124))
    assert layout.column_cut(df.withColumn("region", F.lit("Float"))).count() == 0


def test_lines_end_at_their_first_box(spark):
    # each box lies within 2.5 points of the one before, not of the line's first; a box a little higher goes by x
    df = boxes_of(spark, [("a", 50.0, 100.0, 60.0), ("b", 70.0, 102.0, 80.0), ("c", 90.0, 104.0, 99.0), ("d", 110.0, 105.5, 120.0), ("x", 40.0, 101.0, 45.0), (",", 130.0, 105.0, 132.0)], family="generic")
    assert [r.text for r in layout.linearize(df).orderBy("line_no").collect()] == ["x a b", "c d,"]


def test_generic_pages_have_no_columns(spark):
    rows = [(f"{'l' if a < 300 else 'r'}{k}", a, 100.0 + 12 * k, b) for k in range(20) for a, b in ((50.0, 160.0), (170.0, 272.0), (310.0, 430.0), (440.0, 550.0))]
    first = lambda family, page=1: layout.linearize(boxes_of(spark, rows, family=family, page=page)).orderBy("line_no").first().text
    assert first("generic") == "l0 l0 r0 r0" and first("scan") == "l0 l0" and first("frontiers") == "l0 l0 r0 r0" and first("frontiers", 2) == "l0 l0"


def test_gap_columns(spark):
    # the gap's right end lies in the middle though its middle doesn't; sides go by the boxes' centres
    df = boxes_of(spark, [("w", 100.0, 10.0 * k, 140.0) for k in range(16)] + [("w", 180.0, 10.0 * k, 220.0) for k in range(16)])
    assert [r.cut for r in layout.gap_column(df).collect()] == [140.0]


def test_families_and_overrides(spark):
    from quire.sources import settings

    df = boxes_of(spark, [("Figure", 60.0, 300.0, 95.0), ("2", 100.0, 300.0, 106.0), ("ht'02", 300.0, 400.0, 340.0), ("frontiersin.org", 300.0, 500.0, 340.0)])
    kinds = lambda family, page, over=None: [r.region for r in layout.classify(df.withColumn("family", F.lit(family)).withColumn("page", F.lit(page)), over).orderBy("box_id").collect()]
    over = settings.overrides(["page=1; keep_captions=true", "page=1; region=sidebar; units=frac; origin=topleft; box=0.5,0.45,0.6,0.55"])[0]
    assert kinds("generic", 1) == ["Float", "Body", "Body", "Body"] and kinds("acm", 0) == ["Wrapper"] * 4
    assert kinds("acm", 1) == ["Body", "Body", "Metadata", "Body"] and kinds("frontiers", 1)[3] == "Header"
    assert kinds("generic", 1, over) == ["Body", "Body", "Sidebar", "Body"]


def test_islands(spark):
    # rows 12 points apart are of the island, the one 40 below is not; rows within 2 points are one
    rows = [("Figure", 60.0, 300.0, 95.0), ("2", 100.0, 300.0, 106.0), ("a", 60.0, 312.0, 70.0), ("b", 80.0, 313.5, 90.0), ("c", 60.0, 353.0, 70.0), ("d", 400.0, 305.0, 420.0)]
    got = layout.float_islands(layout.classify(boxes_of(spark, rows, family="generic"))).orderBy("box_id").collect()
    assert [r.region for r in got] == ["Float", "Float", "Float", "Float", "Body", "Body"]


def test_paragraphs_lose_the_hyphen(spark):
    rows = spark.createDataFrame([(1, 0, "Paragraph", "the exam-"), (1, 1, "Paragraph", "ple goes."), (1, 2, "Paragraph", "Next"), (1, 3, "Heading", "H")], "doc_id long, line_no int, kind string, text string")
    assert [r.text for r in lines.merge_paragraphs(rows).orderBy("line_no").collect()] == ["the example goes.", "Next", "H"]
    rows = spark.createDataFrame([(1, 0, 0, "Paragraph", "the exam-"), (1, 1, 1, "Paragraph", "ple goes"), (1, 2, 2, "Paragraph", "on.")], "doc_id long, page long, block_no long, kind string, text string")
    assert [(r.page, r.text) for r in overleaf.merge_paragraphs(rows).orderBy("page").collect()] == [(0, "the example goes"), (2, "on.")]


def as_blocks(spark, rows):
    return spark.createDataFrame([(1, p, i, k, 1, t) for i, (p, k, t) in enumerate(rows)], "doc_id long, page long, block_no long, kind string, level int, text string")


def test_abstract_is_a_pages_first_paragraph(spark):
    long = " ".join(["word"] * 40)
    short_first = [(0, "Heading", "Abstract"), (0, "Paragraph", "short"), (0, "Paragraph", long)]
    assert blocks.abstract_of(as_blocks(spark, short_first)).count() == 0
    again = [*short_first, (1, "Heading", "ABSTRACT"), (1, "Footnote", "1 x"), (1, "Paragraph", long + " two")]
    assert [r.abstract for r in blocks.abstract_of(as_blocks(spark, again)).collect()] == [long + " two"]
    assert blocks.abstract_of(as_blocks(spark, [(0, "Heading", "Abstract"), (0, "Heading", "Other"), (0, "Paragraph", long)])).count() == 0


def test_keywords_pass_over_keywords(spark):
    rows = [(0, "Heading", "Keywords"), (0, "Heading", "Key words"), (0, "Footnote", "1 n"), (0, "Paragraph", "a, b ,, c"), (0, "Paragraph", "d")]
    assert [r.keywords for r in blocks.keywords_of(as_blocks(spark, rows)).collect()] == [["a", "b", "c"]]


def test_quarantine(spark):
    stream = ["3", "Running head of page", "as shown in figure 3, it", "see Running Head of Page here", "head of page", "one two three four five", "plain"]
    visual = [("Header", "3"), ("Header", "running head of page"), ("Float", "figure 3"), ("Footnote", "One two three four six")]
    s = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(stream)], "doc_id long, page int, line_no long, text string")
    v = spark.createDataFrame([(1, 0, i, r, t) for i, (r, t) in enumerate(visual)], "doc_id long, page int, line long, region string, text string")
    # a page number stays as it has under eight bytes, the figure as the line refers to it
    got = {r.line_no: r.text for r in streams.quarantine(s, v).collect()}
    assert got == {0: "3", 2: "as shown in figure 3, it", 3: "see here", 6: "plain"}


def test_streams_and_requests(spark):
    rows = [(1, 0, "generic", "flow", 0, 0.0), (1, 0, "generic", "geometry", 2, 0.0), (2, 3, "frontiers", "flow", 1, 1.0), (2, 3, "frontiers", "geometry", 1, 0.5), (3, 0, "scan", "flow", 3, 1.0), (3, 0, "scan", "geometry", 3, 1.0)]
    got = streams.select_stream(spark.createDataFrame(rows, "doc_id long, page int, family string, stream string, lines int, quality double")).collect()
    assert sorted((r.doc_id, r.stream) for r in got) == [(1, "flow"), (2, "geometry"), (3, "geometry")]
    pages = spark.createDataFrame([(1, 0, "generic"), (1, 1, "generic"), (2, 0, "scan"), (3, 0, "acm")], "doc_id long, page int, family string")
    boxes = spark.createDataFrame([(1, 0, "x" * 40), (2, 0, "y" * 50)], "doc_id long, page int, text string")
    got = streams.ocr_requests(pages, boxes).collect()
    assert sorted((r.doc_id, r.page, r.bytes, r.kind) for r in got) == [(1, 1, 0, "direct"), (2, 0, 50, "candidate")]


def test_front_matter(spark):
    one = spark.range(1)
    none = F.array().cast("array<string>")
    head = lambda *a: one.select(blocks.front_matter(*a).alias("h")).first().h
    assert head({"title": F.lit("A: b")}, none, none, F.lit("")) == '---\ntitle: "A: b"\nauthors:\n  []\nsource-format: PDF\n---\n\n'
    doi = F.lit("10.1/x")
    full = head({"title": F.lit("T"), "object-url": blocks.object_url(doi), "doi": doi, "published-formats": F.lit("print")}, F.array(F.lit("A")), F.array(F.lit("k")), F.lit("one\ntwo\n"))
    assert full == '---\ntitle: T\nauthors:\n  - A\nobject-url: "https://doi.org/10.1/x"\nsource-format: PDF\npublished-formats: print\ndoi: 10.1/x\nkeywords:\n  - k\nabstract: |\n  one\n  two\n---\n\n'


def test_caption_seed(spark):
    boxes = [(1, 0, 0, "Figure", 60.0, 300.0, 95.0, 310.0), (1, 0, 1, "2", 100.0, 300.0, 106.0, 310.0), (2, 0, 0, "Figure", 60.0, 300.0, 95.0, 310.0), (2, 0, 1, "2", 100.0, 300.0, 106.0, 310.0), (2, 0, 2, "see", 40.0, 300.0, 55.0, 310.0)]
    df = spark.createDataFrame(boxes, "doc_id long, page int, box_id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.doc_id for r in layout.caption_seeds(df).collect()] == [1]


def test_lines_overleaf(spark):
    # pages of one line give by turns; a missing page breaks the chain
    rows = [(1, 0, 0, "a-"), (1, 1, 1, "b-"), (1, 2, 2, "c-"), (1, 3, 3, "d"), (1, 3, 4, "e-"), (1, 5, 5, "f"), (2, 0, 0, "x"), (2, 1, 1, "y")]
    got = overleaf.stitch_lines(spark.createDataFrame(rows, "doc_id long, page long, line_no long, text string")).orderBy("doc_id", "line_no").collect()
    assert [(r.page, r.text) for r in got] == [(0, "ab-"), (2, "cd"), (3, "e-"), (5, "f"), (0, "x"), (1, "y")]


def test_row_bands_drift(spark):
    # the second box moves the row to 101.5, so the third is within three points of it
    rows = [(100.0, True, False), (103.0, False, True), (104.0, True, False), (120.0, True, False)]
    df = spark.createDataFrame([(rows,)], "b array<struct<y0:double,left:boolean,right:boolean>>")
    got = df.select(overleaf.row_bands(F.col("b")).alias("r")).first().r
    assert [tuple(x) for x in got] == [(102.75, True, True), (120.0, True, False)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_travel_by_document(spark):
    # no row a word is dealt; a row of 20,000 letters is one word
    assert "Generate" not in plan_of(catalog.queries()["word_tokens"](spark, SF))
    got = spark.createDataFrame([("é" * 20_000 + " b",)], "t string").select(F.size(text.words(F.col("t"))).alias("n")).first()
    assert got.n == 2


def test_pages_are_sorted_once(spark):
    # medians, note starts and seeds are windows over one order, and rules of regions are no part of a filter by region
    for name, sorts in (("region_classify", 1), ("footnote_start", 1), ("visual_lines", 2)):
        found = catalog.queries()[name](spark, SF)
        assert found._jdf.queryExecution().executedPlan().toString().count(" Sort [") == sorts and plan_of(found).count("THEN Wrapper") <= 1, name


def test_bins_and_rows_are_no_product(spark):
    # no row a box and bin, no search through a column's rows for each box
    plan = plan_of(catalog.queries()["column_histogram"](spark, SF))
    assert "sequence(" not in plan[: plan.index("Window")]
    for name in ("linearize", "merged_lines"):
        assert " filter(" not in plan_of(catalog.queries()[name](spark, SF)) and "(filter(" not in plan_of(catalog.queries()[name](spark, SF))
    # bins at the page's ends, a box of one bin, and 29 boxes
    rows = [(1, 0, "Body", x, x + w) for x, w in [(0.0, 0.0), (-5.0, 3.0), (598.0, 9.0), (300.0, 360.0)] + [(10.0 * i, 25.0) for i in range(27)]] + [(2, 0, "Body", 0.0, 9.0)] * 29
    found = {r.bin: r.n for r in layout.histogram(spark.createDataFrame(rows, "doc_id long, page int, region string, x0 double, x1 double")).collect() if r.doc_id == 1}
    cut = lambda v: min(239, max(0, v))
    assert found == {b: sum(cut(math.floor(x0 / 600 * 240)) <= b <= cut(math.ceil(x1 / 600 * 240)) for _, page, _, x0, x1 in rows[:31]) for b in range(240)}


def test_upper_medians(spark):
    for sizes in ([], [None, 0.0, -1.0], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0], [2.0, None, 0.0, 7.0, 4.0, 4.0], [float(i * 7 % 11) for i in range(40)]):
        found = layout.middle_of("x", "m", spark.createDataFrame([(1, 0, v) for v in sizes or [None]], "doc_id long, page int, x double")).select("m").distinct().collect()
        some = sorted(v for v in sizes if v and v > 0)
        assert [r.m for r in found] == [some[len(some) // 2] if some else 0.0], sizes


def test_stream_select_reads_each_stream_once(spark):
    assert plan_of(catalog.queries()["stream_select"](spark, SF)).count("parquet") == 2


def test_rows_of_boxes_by_stretches():
    import random

    def plain(tops, sides):
        bands = []
        for y, side in zip(tops, sides):
            at = next((i for i, b in enumerate(bands) if abs(b[0] - y) <= 3.0), None)
            if at is None:
                bands.append([y, side])
            else:
                bands[at] = [(bands[at][0] + y) * 0.5, bands[at][1] | side]
        return bands

    rng = random.Random(1)
    for _ in range(50):
        tops, sides = [rng.randrange(0, 400) / 4 for _ in range(200)], [rng.randrange(8) for _ in range(200)]
        assert overleaf.rows_of(tops, sides) == plain(tops, sides)


def odd_texts():
    """Documents of fragments that the rules of lines and blocks look for, drawn by chance."""
    import random

    parts = [
        "Abstract", "Keywords", "Key words", "Keywords:", "one, two ,, three", "1. Introduction", "1 introduction", "References", "Works cited", "Figure 6", "Figure 06: x", "fig. 3b.", "Table 2 of it", "12 a note", "[3] noted",
        "Conclusion and more", "conclusion", "Managing the texts", "space and time 4 rest", "the exam-", "ple goes on.", "-", "", "  two  runs ", "\ttab\x0b and\fform", "permission to make digital copies", "Copyright 2002 ACM", "profes- sional and profes sional",
        "in region, last 36 months", "American Psychological Association subscription", "Subscription claims", "Adams, Baker, Crane, Chavez, Dole and Evans", "Ab, Cd, Ef, Gh, Ij and Kl", "The End", "the end of it all", "THE END OF IT", "Rudgery and deep thought", "rudgery and deep thought next",
        "there has been considerable debate", "what explains the", "Perseus and other", "said so.\"')", "word " * 45, "x" * 130, "1.2.3 Of Things", "ÉTÉ Größe “quoted” — dash…", "\u00a0nb\u00a0", "İstanbul K\u2028", "fact3, a2b end9", "a", "é", "published 3 may 2020 by", "''x``", "Appendix A",
    ]
    rng = random.Random(3)
    return [None, "", *["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 90))) for _ in range(120)]]


@pytest.mark.parametrize("name", ["stream_lines", "keywords_split", "markdown_body", "document_markdown", "generic_blocks", "abstract_extract", "doc_stats", "family_blocks", "title_fallback"])
def test_passes_on_odd_lines(spark, tmp_path, name):
    import duckdb

    rows = [(i, t, "en", "web") for i, t in enumerate(odd_texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(catalog.oracle_sql()[name]).df()
    assert len(want) and normal(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == normal(want)


@pytest.mark.parametrize("name", ["keywords_split", "markdown_body", "generic_blocks", "abstract_extract", "doc_stats", "family_blocks", "title_fallback"])
def test_documents_are_passed_once(spark, name):
    # a document is dealt whole and once; no line, piece or block is, and none is ordered
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and " Sort [" not in plan


def test_conversion_has_no_windows(spark):
    # lines, blocks and what follows are one pass over a document
    plan = catalog.queries()["document_markdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("ArrowEvalPython") == 2
