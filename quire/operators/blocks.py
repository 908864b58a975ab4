"""Typed blocks from lines, and what documents say of themselves: title, abstract, keywords, counts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from quire.functions import text as T
from . import passes
from .passes import ANCHORS, CLEARING, INTRODUCTION, KEYWORDS, PERMISSION, PERMISSION_END, SCAN_BODY, SCAN_SUBTITLE, SCAN_TITLE, SHORT_FIGURE  # noqa: F401  the SQL names them here

#: Fields of a document's head behind title and authors, in order.
FIELDS = ["date-published", "date-received", "date-accepted", "publisher", "object-url", "source-format", "published-formats", "doi", "type", "pages", "date-accessed", "date-extracted"]


LINE, PIECE = ["page", "line_no", "family", "title", "text"], ["page", "line_no", "part", "n", "kind", "level", "text", "cleared"]


def _line_lists(lines: DataFrame) -> DataFrame:
    for name, value in (("page", F.lit(0).cast("long")), ("family", F.lit("generic")), ("title", F.lit(""))):
        lines = lines if name in lines.columns else lines.withColumn(name, value)
    return passes.held(lines, ("doc_id",), LINE)


def _made(lists: DataFrame, names: list[str]) -> StructType:
    """The rows of a pass over lists: page and line_no as they are there."""
    types = {"part": IntegerType(), "n": IntegerType(), "kind": StringType(), "level": IntegerType(), "text": StringType(), "cleared": BooleanType(), "block_no": IntegerType()}
    given = {f.name: f.dataType for f in lists.schema["rows"].dataType.elementType}
    return StructType([StructField(n, given[n] if n in ("page", "line_no") else types[n]) for n in names])


def pieces_of(lines: DataFrame, keywords_as_h2: bool = True, nest_numbers: bool = True) -> DataFrame:
    """doc_id, page, line_no, part, n, kind, level, text, cleared of what each line gives to the blocks; Figure is a caption that is counted
    only. lines: doc_id, page, line_no, text, and, if known, family and title.

    State that runs down the lines (body begun, references seen, dropping, waiting) is kept by a pass over each document's lines, which
    meet in one exchange by doc_id. In rail pages a keywords line behind the references, in a part that goes, is taken for one all the
    same."""
    lists = _line_lists(lines)
    return passes.passed(lists, ("doc_id",), partial(passes.pieces, keywords_as_h2=keywords_as_h2, nest_numbers=nest_numbers), _made(lists, PIECE))


BLOCK = ["page", "block_no", "line_no", "kind", "level", "text"]


def blocks_of(pieces: DataFrame) -> DataFrame:
    """doc_id, page, block_no, line_no, kind, level, text of each block; block_no runs through the document. Paragraphs are islands: a line
    goes on unless the one before ends a sentence and lines between were left out."""
    lists = passes.held(pieces, ("doc_id",), PIECE)
    return passes.passed(lists, ("doc_id",), passes.blocks_of, _made(lists, BLOCK))


def line_blocks(lines: DataFrame) -> DataFrame:
    """The blocks of lines' pieces, in one pass."""
    lists = _line_lists(lines)
    return passes.passed(lists, ("doc_id",), passes.line_blocks, _made(lists, BLOCK))


def generic_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of lines (doc_id, line_no, text): the generic layout, one page a document, without a title."""
    return line_blocks(lines).drop("page")


def scan_title(lines: DataFrame) -> DataFrame:
    """doc_id, title of scanned documents: the line of a known title and its second line, before the body begins."""
    low = T.ascii_lower(T.fix_split_word(T.normalize_typography(F.col("text"))))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.filter("family = 'scan'").withColumn("low", low).withColumn("begun", F.max(low.startswith(SCAN_BODY)).over(order)).filter("NOT begun")
    at = F.struct("page", "line_no")
    found = rows.groupBy("doc_id").agg(F.max_by("text", F.when(F.col("low").startswith(SCAN_TITLE), at)).alias("a"), F.min_by("text", F.when(F.col("low") == SCAN_SUBTITLE, at)).alias("b"))
    return found.filter("a IS NOT NULL").select("doc_id", F.concat_ws(": ", "a", "b").alias("title"))


def _one(name: str, kind: DataType) -> StructType:
    return StructType([StructField(name, kind)])


#: What a pass over each document's pieces can make, by name: the pass, and the columns of its rows.
MADE = {
    "blocks": (passes.blocks, StructType([StructField("page", LongType()), StructField("block_no", IntegerType()), StructField("line_no", LongType()), StructField("kind", StringType()), StructField("level", IntegerType()), StructField("text", StringType())])),
    "title": (passes.of_blocks(passes.title), _one("title", StringType())),
    "abstract": (passes.of_blocks(passes.abstract), _one("abstract", StringType())),
    "keywords": (passes.of_blocks(passes.keywords), _one("keywords", ArrayType(StringType()))),
    "markdown": (passes.of_blocks(passes.markdown_body), _one("markdown", StringType())),
    "counts": (passes.counts, StructType([StructField(c, LongType()) for c in ("pages", "headings", "tables", "figures", "footnotes")])),
}


def of_streams(streams: DataFrame, what: str, per_page: int | None = None) -> DataFrame:
    """doc_id and MADE[what] of raw streams (doc_id, family, title, rows: line_no and raw in order), with pages of so many lines if told:
    lines, pieces and what follows from them in one pass over a document, so that no line is dealt."""
    run, schema = MADE[what]
    return passes.passed(streams, ("doc_id",), passes.of_streams(run, per_page), schema, ("family", "title"))


def title_of(blocks: DataFrame) -> DataFrame:
    """doc_id, title: the first heading of eight bytes or more that isn't a section's name."""
    named = T.ascii_lower(F.col("text")).isin("abstract", "keywords", "references")
    rows = blocks.filter((F.col("kind") == "Heading") & (T.size(F.col("text")) >= 8) & ~named)
    return rows.groupBy("doc_id").agg(F.min_by("text", "block_no").alias("title"))


def _with_page(blocks: DataFrame) -> DataFrame:
    return blocks if "page" in blocks.columns else blocks.withColumn("page", F.lit(0).cast("long"))


def abstract_of(blocks: DataFrame, least_words: int = 40) -> DataFrame:
    """doc_id, abstract: of each page the first paragraph after a heading Abstract, with no other heading between; of those with enough
    words the first page's. A page's first paragraph alone is looked at."""
    blocks = _with_page(blocks)
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("block_no")
    head, named = F.col("kind") == "Heading", T.ascii_lower(F.col("text")) == "abstract"
    rows = blocks.withColumn("after", F.max(head & named).over(order)).filter("after")
    # what ends the search on a page: a paragraph, or a heading of another name
    rows = rows.filter((F.col("kind") == "Paragraph") | (head & ~named))
    found = rows.groupBy("doc_id", "page").agg(F.min_by(F.struct("kind", "text"), "block_no").alias("b")).filter("b.kind = 'Paragraph'")
    some = found.filter(F.size(T.words(F.col("b.text"))) >= least_words)
    return some.groupBy("doc_id").agg(F.min_by("b.text", "page").alias("abstract"))


def keywords_of(blocks: DataFrame) -> DataFrame:
    """doc_id, keywords: of each page the first paragraph or heading of another name after a heading Keywords, at commas, parts under 80
    bytes; of pages that have any the first."""
    blocks = _with_page(blocks)
    order = Window.partitionBy("doc_id", "page").orderBy("block_no")
    named = (F.col("kind") == "Heading") & T.ascii_lower(F.col("text")).isin("keywords", "key words")
    rows = blocks.withColumn("named", named).withColumn("after", F.max("named").over(order)).filter(F.col("after") & ~F.col("named") & F.col("kind").isin("Paragraph", "Heading"))
    found = rows.groupBy("doc_id", "page").agg(F.min_by("text", "block_no").alias("t"))
    parts = F.filter(F.transform(F.split("t", ","), T.trim), lambda p: (p != "") & (T.size(p) < 80))
    return found.select("doc_id", "page", parts.alias("k")).filter(F.size("k") > 0).groupBy("doc_id").agg(F.min_by("k", "page").alias("keywords"))


def counts(pieces: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, pages, headings, tables, figures, footnotes of documents that have pieces: headings and figures as they are met, footnotes
    that are left. pages: doc_id, pages."""
    kind = F.col("kind")
    found = pieces.groupBy("doc_id").agg(
        F.max("page").alias("last"), F.count_if(kind == "Heading").alias("headings"), F.count_if(kind == "Table").alias("tables"), F.count_if(kind.isin("Figure", "Caption", "Sixth")).alias("figures"),
        F.count_if((kind == "Footnote") & ~F.col("cleared")).alias("footnotes"),
    )
    found = found.withColumn("pages", F.col("last") + 1) if pages is None else found.join(pages, "doc_id")
    return found.select("doc_id", "pages", "headings", "tables", "figures", "footnotes")


def markdown_of(blocks: DataFrame, titles: DataFrame | None = None, abstract_as_h1: bool = True, keywords_as_h2: bool = True, endnotes: bool = True) -> DataFrame:
    """doc_id, markdown: the body of each document; a block that repeats the title goes, footnotes follow as endnotes if asked for."""
    low = T.ascii_lower(F.col("text"))
    if titles is not None:
        blocks = blocks.join(titles, "doc_id", "left").filter((F.coalesce("title", F.lit("")) == "") | (T.ascii_lower(T.collapse(F.col("text"))) != T.ascii_lower(T.collapse(F.col("title"))))).drop("title")
    level = F.when(F.lit(abstract_as_h1) & (low == "abstract"), 1).when(F.lit(keywords_as_h2) & low.isin("keywords", "key words"), 2).otherwise(F.col("level"))
    body = F.when(F.col("kind") == "Heading", F.concat(T.heading_prefix(level), "text", F.lit("\n\n"))).when(F.col("kind") == "Paragraph", F.concat("text", F.lit("\n\n")))
    body = body.when(F.col("kind") == "Caption", F.concat(F.lit("**"), "text", F.lit("**\n\n"))).when(F.col("kind") == "ListItem", F.concat(F.lit("- "), "text", F.lit("\n"))).otherwise("")
    note = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("block_no"))
    rows = blocks.withColumn("md", body).withColumn("note", F.when(F.col("kind") == "Footnote", F.concat(F.lit("[^"), note.cast("string"), F.lit("]: "), "text", F.lit("\n\n"))).otherwise(""))
    refs = F.max(((F.col("kind") == "Heading") & (low == "references")).cast("int"))
    held = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "md", "note"))).alias("b"), refs.alias("refs"))
    joined, notes = (F.array_join(F.transform("b", lambda x: x[c]), "") for c in ("md", "note"))
    tail = F.when((notes == "") | F.lit(not endnotes), "").otherwise(F.concat(F.when(F.col("refs") == 1, "\n").otherwise("\n\n"), notes))
    return held.select("doc_id", F.concat(joined, tail).alias("markdown"))


def object_url(doi: Column) -> Column:
    """Where a DOI leads; empty without one."""
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


def front_matter(meta: dict[str, Column], authors: Column, keywords: Column, abstract: Column) -> Column:
    """The head of a document's Markdown, quoted where YAML asks for it. meta: title, and of FIELDS those that are known; a field whose
    value is empty or null isn't written, the title and the source's format always are."""
    some = lambda x: F.coalesce(x, F.lit(""))
    out = [F.lit("---\ntitle: "), T.yaml_escape(some(meta["title"])), F.lit("\nauthors:\n")]
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("  - "), T.yaml_escape(x), F.lit("\n"))), "")
    out.append(F.when(F.size(authors) > 0, listed(authors)).otherwise("  []\n"))
    for name in FIELDS:
        value = some(meta.get(name, F.lit("PDF" if name == "source-format" else "")))
        line = F.concat(F.lit(f"{name}: "), T.yaml_escape(value), F.lit("\n"))
        out.append(line if name == "source-format" else F.when(value != "", line).otherwise(""))
    out.append(F.when(F.size(keywords) > 0, F.concat(F.lit("keywords:\n"), listed(keywords))).otherwise(""))
    body = F.array_join(F.transform(F.split(F.regexp_replace(some(abstract), "\n$", ""), "\n"), lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), "")
    out.append(F.when(some(abstract) != "", F.concat(F.lit("abstract: |\n"), body)).otherwise(""))
    return F.concat(*out, F.lit("---\n\n"))


def stats_record() -> Column:
    """A document's statistics as JSON, of columns input, output, pages, headings, tables, figures, footnotes, title, doi."""
    return F.to_json(F.struct("input", "output", "pages", "headings", "tables", "figures", "footnotes", "title", "doi"))
