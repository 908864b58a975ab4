"""Views that the queries share. The documents hold neither boxes nor headings, so both are derived by integer arithmetic: MARKED
sets marked lines beside the documents' own, which stay whole, BOXES lays words out in two columns whose rows drift, over pages of all
layout families. The same SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lines as L

#: By (doc_id * 7 + line_no) % 23 the lines that a line becomes; 'raw' is the line itself.
MARKED = [
    "'Abstract', raw", "'Keywords', raw", "'1. Introduction', raw", "raw, 'References'", "'Figure 3 shows', raw, 'Figure 6 has', 'Figure 4b.'", "raw || ' exam-', 'ple goes on', 'and so on-'", "'ple of it-', raw",
    "'some words-', 'that go on-', 'and end', raw", "'Open Access', raw", "'See doi 10.1145/' || CAST(doc_id AS STRING) || '.77, it says that the measure which is used in all of the parts stands for what is meant, as is told below in more words', raw", "raw || ' B'",
    "'Published 3 May 2020 by', 'Permission to make digital or hard copies', 'of parts', 'Copyright 2002 ACM 1-58113', raw", "'THE END OF IT', raw, 'Managing the texts and more'", "'Adams, Baker, Crane, Chavez, Dole and Evans', raw", "'Conclusion ' || raw", "raw || ' precedent1. See fact3, a2b end9'", "'12 ' || raw", "'1.2 Methods', raw, 'one in region, last 36 months', '1 Introduction'",
    "'Communications of the ACM 12', raw", "'  ' || raw || '  and so on '", "raw, 'Subscription claims form'", "raw, ''", "'Keywords', 'Keywords', 'one, two ,, three', raw",
]


def marked_case(array: str) -> str:
    """The lines as a CASE whose arrays are written as `array` says."""
    return "CASE (doc_id * 7 + line_no) % 23 " + " ".join(f"WHEN {i} THEN {array.format(x)}" for i, x in enumerate(MARKED)) + " END"


WORD_TEXT = "CASE WHEN k % 96 = 0 THEN 'Figure' WHEN k % 96 = 1 THEN '3' WHEN k % 89 = 0 THEN CAST(k % 100 AS STRING) WHEN k % 211 = 5 THEN 'copyright' ELSE word END"
ROW_Y = "40 + CAST(floor(k % 400 / 8.0) AS INT) * 15 + CASE WHEN CAST(floor(k % 400 / 8.0) AS INT) % 4 = 1 THEN (k % 8) * 0.5D WHEN CAST(floor(k % 400 / 8.0) AS INT) % 4 = 3 THEN (k * 5 % 8) * 0.25D ELSE 0D END"
BOXES = f"""doc_id, CAST(floor(k / 800.0) AS INT) AS page, CAST(k % 800 AS INT) AS box_id, {WORD_TEXT} AS text,
 CAST(50 + CAST(floor(k / 400.0) AS INT) % 2 * 260 + k % 8 * 28 AS DOUBLE) AS x0, CAST({ROW_Y} AS DOUBLE) AS y0,
 CAST(76 + CAST(floor(k / 400.0) AS INT) % 2 * 260 + k % 8 * 28 AS DOUBLE) AS x1, CAST({ROW_Y} + CASE WHEN k % 89 = 0 THEN 7 ELSE 10 END AS DOUBLE) AS y1,
 CAST(CASE WHEN k % 11 = 0 THEN 7 ELSE 10 END AS DOUBLE) AS font_size, CASE WHEN k % 301 = 7 THEN 90 ELSE 0 END AS rotation,
 CASE doc_id % 5 WHEN 0 THEN 'acm' WHEN 1 THEN 'magazine' WHEN 2 THEN 'scan' WHEN 3 THEN 'frontiers' ELSE 'generic' END AS family"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, raw with marked lines."""
    rows = L.physical_lines(documents(spark, sf_dir).select("doc_id", "text"))
    rows = rows.select("doc_id", "line_no", F.posexplode(F.expr(marked_case("array({})"))).alias("k", "raw"))
    return rows.select("doc_id", (F.col("line_no") * 8 + F.col("k")).alias("line_no"), "raw")


def marked_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rows: each document's marked lines (line_no, raw) in order; documents travel whole, no line does."""
    one = f"transform(split(coalesce(text, ''), '\\n', -1), (raw, line_no) -> transform({marked_case('array({})')}, (x, k) -> struct(line_no * 8 + k AS line_no, x AS raw)))"
    lists = documents(spark, sf_dir).select("doc_id", F.flatten(F.expr(one)).alias("rows"))
    return lists.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.streamed(marked_streams(spark, sf_dir))


#: Pages of marked lines, and titles that their documents are said to have.
PER_PAGE = 24
LINE_PAGE, TITLE = f"CAST(floor(line_no / {PER_PAGE}.0) AS BIGINT)", "CASE doc_id % 4 WHEN 1 THEN 'The End' WHEN 2 THEN 'THE END OF IT' ELSE '' END"


def paged(lines: DataFrame) -> DataFrame:
    """Lines with page, family and title."""
    return lines.select("doc_id", F.expr(LINE_PAGE).alias("page"), F.col("line_no").cast("long").alias("line_no"), "text", family().alias("family"), F.expr(TITLE).alias("title"))


def titled_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked streams with family and title."""
    return marked_streams(spark, sf_dir).select("doc_id", "rows", family().alias("family"), F.expr(TITLE).alias("title"))


def family():
    """The layout family that a document of the view stands for."""
    return F.expr("CASE doc_id % 5 WHEN 0 THEN 'acm' WHEN 1 THEN 'magazine' WHEN 2 THEN 'scan' WHEN 3 THEN 'frontiers' ELSE 'generic' END")


def boxes(spark: SparkSession, sf_dir: str, by: tuple = ("doc_id", "page")) -> DataFrame:
    """Boxes dealt by `by`: pages are dealt as lists of words and laid out behind the exchange, so that no box is, and what groups by page
    deals nothing again."""
    parts = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / 800).cast("int") - 1), lambda i: F.slice(w, i * 800 + 1, F.lit(800))))
    text = F.array(T.words(F.coalesce("text", F.lit(""))))
    pages = documents(spark, sf_dir).select("doc_id", F.posexplode(F.transform(text, parts)[0]).alias("page", "words")).repartition(*by)
    words = pages.select("doc_id", "page", F.posexplode("words").alias("n", "word")).select("doc_id", "page", (F.col("page") * 800 + F.col("n")).alias("k"), "word")
    given = [x for x in _columns(BOXES) if not x.endswith(" AS page")]
    return words.selectExpr(given[0], "page", *given[1:])


def _columns(sql: str) -> list[str]:
    """The select list of a text, at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[at:i].strip())
            at = i + 1
    return [*out, sql[at:].strip()]


# ---- the same in DuckDB's SQL ----
S = r"[\s\x0B]"


def d_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def d_collapse(x: str) -> str:
    return d_trim(rf"regexp_replace({x}, '{S}+', ' ', 'g')")


def d_low(x: str) -> str:
    return f"translate({x}, '{T.UPPER}', '{T.LOWER}')"


def d_quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def d_typography(x: str) -> str:
    for a, b in T.TYPOGRAPHY:
        x = f"replace({x}, {d_quote(a)}, {d_quote(b)})"
    return x


def d_detach(x: str) -> str:
    return rf"regexp_replace({x}, '([A-Za-z])([1-9])([\s\x0B.,;:)]|$)', '\1 \2\3', 'g')"


def d_appended(a: str, b: str) -> str:
    """Two parts of a paragraph."""
    return f"CASE WHEN {b} = '' THEN {a} WHEN {a} LIKE '%-' THEN left({a}, length({a}) - 1) || {b} WHEN {a} = '' THEN {b} ELSE {a} || ' ' || {b} END"


def d_words(x: str) -> str:
    return rf"regexp_extract_all({x}, '(?:[0-9A-Za-z''\-]|[^\x00-\x7F])+')"


def d_authors(x: str) -> str:
    return f"list_filter(list_transform(flatten(list_transform(regexp_split_to_array({x}, '[;,]'), lambda p: string_split({d_trim('p')}, ' and '))), lambda p: {d_trim('p')}), lambda p: p <> '')"


def d_any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {d_quote(p)})" for p in phrases) + ")"


def d_starts(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {d_quote(p)})" for p in phrases) + ")"


def d_in(x: str, phrases: list[str]) -> str:
    return f"{x} IN ({', '.join(d_quote(p) for p in phrases)})"


def d_suspect(w: str) -> str:
    return f"(strlen({w}) > 24 OR regexp_matches(hex(encode({w})), '^(?:..)*?(?:{T.SUSPECT_BYTES})'))"


RAW = "raw_lines AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))"
MARK = f"{RAW}, marks AS (SELECT doc_id, line_no, {marked_case('[{}]')} AS m FROM raw_lines), marked AS (SELECT doc_id, line_no * 8 + unnest(range(len(m))) AS line_no, unnest(m) AS raw FROM marks)"


def d_stream(source: str) -> str:
    """lines(doc_id, line_no, text) from source(doc_id, line_no, raw)."""
    text = d_detach(d_trim(d_typography("replace(raw, chr(12), '')")))
    return f"""t0 AS (SELECT doc_id, line_no, {text} AS t FROM {source}),
t1 AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY line_no) LIKE '%-' AND regexp_matches(t, '^[a-z]'), false) AS joins FROM t0),
t2 AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM t1 WHERE t <> ''),
t3 AS (SELECT *, lead(joins) OVER (PARTITION BY doc_id ORDER BY line_no) AS goes_on FROM t2),
lines AS (SELECT doc_id, min(line_no) AS line_no, string_agg(CASE WHEN goes_on THEN regexp_replace(t, '-$', '') ELSE t END, '' ORDER BY line_no) AS text FROM t3 GROUP BY doc_id, run)"""


LINES = f"{MARK}, {d_stream('marked')}"
WORDS = f"words AS (SELECT doc_id, unnest(range(len(w))) AS k, unnest(w) AS word FROM (SELECT doc_id, {d_words("coalesce(text, '')")} AS w FROM documents))"
BOX = f"{WORDS}, boxes AS (SELECT {BOXES.replace('0.5D', '0.5::DOUBLE').replace('0.25D', '0.25::DOUBLE').replace('0D END', '0::DOUBLE END')} FROM words)"
