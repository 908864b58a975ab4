"""Jobs over folders of texts: from the command line, and in an interactive session."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import convert as E
from quire.operators import lines as L
from quire.operators import rules as R
from quire.operators import streams as S
from quire.sources import jobs, pdf, settings, sinks
from quire.sources.settled import settled

#: Settings that a session may change.
SETTABLE = ["paragraph_gap_pts", "column_gap_min_pts", "min_text_quality", "rejoin_hyphenation", "strip_running_headers", "strip_page_numbers", "ocr_dpi", "ocr_workers"]
HELP = "help | show heuristics | set <name> <value> | load <file> | save <file> | convert <paths> -o <folder> | jobs | quit"


def converted(files: DataFrame, heuristics: settings.Heuristics = settings.Heuristics()) -> DataFrame:
    """path, output_path and the columns of `convert.markdown` of text files (path, content, output_path); form feeds part pages."""
    rows = files.withColumn("doc_id", F.xxhash64("path")).withColumn("text", F.decode("content", "UTF-8"))
    documents = rows.select("doc_id", R.layout_family(F.col("path"), F.lit("")).alias("family"), F.lit("").alias("title"), F.lit("").alias("authors"))
    pages = rows.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("page", "text"))
    every = pages.withColumn("place", F.xxhash64("doc_id", "page"))
    lines = L.stream_lines(L.physical_lines(every.select(F.col("place").alias("doc_id"), "text"))).withColumnRenamed("doc_id", "place")
    lines = lines.join(every.select("place", "doc_id", F.col("page").cast("long").alias("page")), "place").join(documents, "doc_id")
    found = E.markdown(documents, lines.select("doc_id", "page", "family", "title", F.col("line_no").cast("long").alias("line_no"), "text"), settings=heuristics)
    return found.join(rows.select("doc_id", "path", "output_path"), "doc_id")


def converted_pdf(files: DataFrame, heuristics: settings.Heuristics = settings.Heuristics(), ocr: Callable | None = None) -> DataFrame:
    """The same of PDF files; files that can't be decoded have no row. ocr: from pages to read (doc_id, page, content) to lines
    (doc_id, page, line_no, text)."""
    own = files.select(F.xxhash64("path").alias("doc_id"), "path", "output_path", "content")
    words = settled(pdf.decoded(files).filter("error IS NULL").withColumn("doc_id", F.xxhash64("path")))
    family = R.layout_family(F.col("path"), F.coalesce("title", F.lit("")))
    pages = words.groupBy("doc_id", "page").agg(F.first("path").alias("path"), F.first("title").alias("title"), F.first("author").alias("authors"))
    pages = settled(pages.withColumn("family", family).drop("path"))
    documents = pages.filter("page = 0").select("doc_id", "family", "title", "authors")
    boxes = pdf.fitted(pdf.normalized_boxes(pdf.raw_boxes(words))).withColumn("family", family).drop("path", "title", "author", "error", "width", "height")
    asked = S.ocr_requests(pages, pdf.raw_boxes(words), int(heuristics.min_text_layer_chars_per_page), heuristics.ocr_when_scan_present)
    asked = settled(asked.join(pages.select("doc_id", "page", "family"), ["doc_id", "page"]))
    lines = E.page_lines(boxes, pages, heuristics, asked.filter("kind = 'direct'"))
    if ocr:
        lines = E.with_recognised(lines, ocr(asked.select("doc_id", "page").join(own.select("doc_id", "content"), "doc_id")), asked)
    lines = lines.join(documents.select("doc_id", "title"), "doc_id").select("doc_id", F.col("page").cast("long").alias("page"), "family", "title", F.col("line_no").cast("long").alias("line_no"), "text")
    counted = pages.groupBy("doc_id").agg((F.max("page") + 1).alias("n"))
    return E.markdown(documents, lines, settings=heuristics, pages=counted).join(own.drop("content"), "doc_id")


def convert(spark: SparkSession, inputs: list[str], out: str, recursive: bool = True, heuristics: settings.Heuristics = settings.Heuristics()) -> tuple[int, int]:
    """(files, files written): Markdown under out and statistics in out/run-reports, of PDF and text files."""
    kinds = [(jobs.listed(spark, inputs, out, recursive, pattern), work) for pattern, work in (("*.[pP][dD][fF]", converted_pdf), ("*.[tT][xX][tT]", converted))]
    total = done = 0
    for files, work in kinds:
        some = files.count()
        if some:
            total += some
            done += _written(work(files, heuristics), out)
    return total, done


def _written(found: DataFrame, out: str) -> int:
    done = found.persist()
    try:
        written = sinks.write_texts(done.select(F.col("output_path").alias("path"), F.col("markdown").alias("text"))).count()
        counted = done.select(F.col("path").alias("input"), F.col("output_path").alias("output"), "pages", "headings", "tables", "figures", "footnotes", "title", "doi")
        sinks.write_texts(sinks.stats_files(counted, f"{out.rstrip('/')}/run-reports")).count()
        return written
    finally:
        done.unpersist()


class Session:
    """Commands one by one; conversions run beside each other with the settings of their start, and quit waits for them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.heuristics, self.running, self.pool = spark, settings.Heuristics(), [], ThreadPoolExecutor(4)

    def run(self, line: str) -> str | None:
        """The answer to a command; None ends the session."""
        words = shlex.split(line)
        if not words:
            return ""
        command, rest = words[0], words[1:]
        if command in ("quit", "exit"):
            for job in self.running:
                job.result()
            return None
        if command == "show":
            return "\n".join(f"{x.name} = {getattr(self.heuristics, x.name)}" for x in fields(self.heuristics))
        if command == "set" and len(rest) == 2 and rest[0] in SETTABLE:
            self.heuristics = replace(self.heuristics, **{rest[0]: settings.coerced(rest[1], getattr(self.heuristics, rest[0]))})
            return f"{rest[0]} = {getattr(self.heuristics, rest[0])}"
        if command == "load" and len(rest) == 1:
            self.heuristics = settings.load(rest[0])
            return "loaded"
        if command == "save" and len(rest) == 1:
            settings.save(self.heuristics, rest[0])
            return "saved"
        if command == "convert" and len(rest) >= 3 and rest[-2] == "-o":
            self.running.append(self.pool.submit(convert, self.spark, rest[:-2], rest[-1], True, self.heuristics))
            return "started"
        if command == "jobs":
            return f"{sum(not x.done() for x in self.running)} of {len(self.running)} running"
        return HELP


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all written; 1: wrong usage or no input; 2: a failure. Settings that can't be read are left at their defaults."""
    arguments = list(sys.argv[1:] if arguments is None else arguments)
    parser = argparse.ArgumentParser(prog="quire", description="Markdown and statistics of documents.")
    parser.add_argument("paths", nargs="*")
    parser.add_argument("-o", "--output", default="out")
    parser.add_argument("--heuristics")
    parser.add_argument("--metadata")
    parser.add_argument("--no-recursive", action="store_true")
    parser.add_argument("-i", "--interactive", action="store_true")
    given, unknown = parser.parse_known_args(arguments[1:] if arguments[:1] == ["convert"] else arguments)
    if unknown:
        parser.print_help()
        return 0
    held = settings.Heuristics()
    for path, load in ((given.heuristics, settings.load), (given.metadata, settings.load_metadata_spec)):
        try:
            read = load(path) if path else None
            held = read if isinstance(read, settings.Heuristics) else held
        except (OSError, ValueError) as e:
            print(f"warning: {path}: {e}; defaults are used", file=sys.stderr)
    if not given.paths and not given.interactive:
        parser.print_usage()
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    if given.interactive:
        session = Session(spark)
        session.heuristics = held
        for line in sys.stdin:
            answer = session.run(line)
            if answer is None:
                break
            print(answer)
        return 0
    files, written = convert(spark, given.paths, given.output, not given.no_recursive, held)
    return 1 if not files else 0 if written == files else 2


if __name__ == "__main__":
    sys.exit(main())
