"""A document from end to end: from its boxes to lines, and from lines to Markdown and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quire.functions import text as T
from quire.sources.settings import Heuristics, overrides
from quire.sources.settled import settled

from . import blocks as B
from . import layout as G
from . import lines as L
from . import overleaf as O
from . import passes, rules
from . import streams as S

LINE, COUNTS = ("doc_id", "page", "family", "title"), ("headings", "tables", "figures", "footnotes")


def page_lines(boxes: DataFrame, pages: DataFrame, settings: Heuristics = Heuristics(), unread: DataFrame | None = None) -> DataFrame:
    """doc_id, page, family, line_no, text of each page's best stream, of boxes (as in `layout`, with family and `line`, the line of the
    file's content that a box stands in) and pages (doc_id, page, family). Geometry reads the body's boxes, flow all boxes by columns and rows,
    raw the content in its order. Wrapper pages have no lines, nor those of unread (doc_id, page), which hold too little text."""
    by_page = overrides(settings.page_overrides)[0]
    regions = settled(O.post_references(G.classify(boxes, by_page)))
    key = (*G.PAGE, "stream")
    named = lambda rows, name: rows.select(*G.PAGE, F.lit(name).alias("stream"), "line_no", F.col("text").alias("raw"))
    geometry = G.linearize(regions, settings.line_merge_y_tol_pts, settings.column_gap_min_pts, by_page)
    flow = G.merged_lines(regions, G.gap_column(regions, settings.column_gap_min_pts), settings.line_merge_y_tol_pts)
    held = regions.groupBy(*G.PAGE, F.col("line").cast("int").alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("box_id", "text"))).alias("b"))
    raw = held.select(*G.PAGE, "line_no", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"))
    texts = L.without_chrome(L.stream_lines(named(flow, "flow").unionByName(named(raw, "raw")), key), settings.strip_page_numbers)
    texts = S.quarantine(texts, G.visual_lines(regions))
    own = L.without_chrome(geometry, settings.strip_page_numbers).select(*G.PAGE, F.lit("geometry").alias("stream"), "line_no", "text")
    streams = settled(own.unionByName(texts.select(*key, "line_no", "text")))
    found = L.quality(streams, key).join(streams.groupBy(*key).agg(F.count(F.lit(1)).alias("lines")), list(key)).join(pages.select(*G.PAGE, "family"), G.PAGE)
    marks = pages.select(*G.PAGE, F.col("page").isin(list(by_page)).alias("overridden")) if by_page else None
    chosen = S.select_stream(found, marks)
    chosen = chosen if unread is None else chosen.join(unread.select(*G.PAGE), G.PAGE, "left_anti")
    chosen = chosen.join(pages.select(*G.PAGE, "family"), G.PAGE)
    return streams.join(chosen, list(key)).filter(~rules.is_wrapper(F.col("family"), F.col("page"))).select(*G.PAGE, "family", "line_no", "text")


def with_recognised(lines: DataFrame, ocr: DataFrame, requests: DataFrame) -> DataFrame:
    """lines (as of `page_lines`) in which pages whose recognised lines win (`streams.arbitrate`) have those. ocr: doc_id, page, line_no,
    text; requests: of `streams.ocr_requests`, with family."""
    asked = requests.select(*G.PAGE, "family", (F.col("kind") == "direct").alias("direct"))
    native = asked.join(L.quality(lines, G.PAGE).select(*G.PAGE, "quality"), G.PAGE, "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    read = ocr.filter("text <> ''")
    scores = L.quality(read, G.PAGE).select(*G.PAGE, F.col("quality").alias("ocr_quality")).join(read.groupBy(*G.PAGE).agg(F.count(F.lit(1)).alias("ocr_lines")), G.PAGE)
    won = settled(S.arbitrate(native, scores).filter("source = 'ocr'").select(*G.PAGE).join(asked.select(*G.PAGE, "family"), G.PAGE))
    taken = read.join(won, G.PAGE).select(*G.PAGE, "family", "line_no", "text")
    return lines.join(won.select(*G.PAGE), G.PAGE, "left_anti").select(*G.PAGE, "family", "line_no", "text").unionByName(taken)


def body_lines(lines: DataFrame, settings: Heuristics = Heuristics()) -> DataFrame:
    """Lines (doc_id, page, family, title, line_no, text) as the blocks take them: without wrapper pages and running heads, joined at
    hyphens within a page pair by pair, overleaf, and within a page along whole chains. Keys begin with doc_id, so one exchange does."""
    rows = lines.filter(~rules.is_wrapper(F.col("family"), F.col("page"))).select(*LINE, "line_no", "text")
    rows = L.without_chrome(rows, settings.strip_page_numbers)
    if not settings.rejoin_hyphenation:
        return rows
    rows = L.stitch_pairs(rows, LINE)
    return L.rejoin_hyphens(O.stitch_lines(rows), LINE)


def body_blocks(pieces: DataFrame, families: DataFrame) -> DataFrame:
    """Blocks of pieces, paragraphs joined within pages and overleaf, without a conference paper's diagrams. families: doc_id, family."""
    found = L.merge_paragraphs(B.blocks_of(pieces), ("doc_id", "page"), "block_no")
    return O.without_diagrams(O.merge_paragraphs(found).join(families, "doc_id"), F.col("family") == "acm").drop("family")


def markdown(documents: DataFrame, lines: DataFrame, extracted: str | None = None, settings: Heuristics = Heuristics(), pages: DataFrame | None = None) -> DataFrame:
    """doc_id, title, doi, markdown, pages, headings, tables, figures, footnotes of documents (doc_id, family, title, authors: text); lines as
    in body_lines. extracted: the date of extraction, today if not given. pages: doc_id, n, told by the lines if not given."""
    own = documents.select("doc_id", F.col("family").alias("own_family"), F.col("title").alias("own_title"), T.authors(F.coalesce("authors", F.lit(""))).alias("authors"))
    lists = passes.held(lines, ("doc_id",), [*LINE[1:], "line_no", "text"])
    lists = own.join(lists, "doc_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)))
    run = passes.whole(
        settings.strip_page_numbers, settings.rejoin_hyphenation, settings.keywords_as_h2, settings.nest_numeric_headings, settings.dedupe_title_from_body, settings.abstract_as_h1, settings.footnotes_to_endnotes
    )
    text, number = StringType(), LongType()
    made = StructType([StructField(n, t) for n, t in [("title", text), ("doi", text), ("keywords", ArrayType(text)), ("abstract", text), ("body", text), ("n", number), *[(c, number) for c in COUNTS]]])
    out = passes.passed(lists, ("doc_id", "authors"), run, made, ("own_family", "own_title"))
    date = F.lit(extracted) if extracted else T.today()
    head = B.front_matter({"title": F.col("title"), "object-url": B.object_url(F.col("doi")), "doi": F.col("doi"), "date-extracted": date}, F.col("authors"), F.col("keywords"), F.col("abstract"))
    if pages is not None:
        out = out.drop("n").join(pages, "doc_id", "left")
    return out.select("doc_id", "title", "doi", F.concat(head, "body").alias("markdown"), F.coalesce("n", F.lit(0)).cast("long").alias("pages"), *COUNTS)
