"""The library's queries by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import layout as G
from quire.operators import lines as L
from quire.operators import rules as R
from quire.operators import streams as S

from . import views as V

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def line_query(name: str, spark_columns: Callable[[], dict[str, Column]], sql_columns: dict[str, str], raw: bool = False) -> None:
    """A query of columns over the marked lines."""
    source = V.marked if raw else V.marked_lines

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), *[c.alias(n) for n, c in spark_columns().items()])

    listed = ", ".join(f"{c} AS {n}" for n, c in sql_columns.items())
    _queries[name] = run
    _sql[name] = f"WITH {V.MARK if raw else V.LINES} SELECT doc_id, line_no, {listed} FROM {'marked' if raw else 'lines'}"


# ---- text functions ----
line_query(
    "normalized_lines",
    lambda: {"trimmed": T.trim(F.col("raw")), "collapsed": T.collapse(F.col("raw")), "typography": T.normalize_typography(F.col("raw")), "lower_text": T.ascii_lower(F.col("raw")), "n_bytes": T.size(F.col("raw")).cast("long")},
    {"trimmed": V.d_trim("raw"), "collapsed": V.d_collapse("raw"), "typography": V.d_typography("raw"), "lower_text": V.d_low("raw"), "n_bytes": "strlen(raw)"},
    raw=True,
)
line_query("footnote_detach", lambda: {"detached": T.detach_footnote(F.col("raw"))}, {"detached": V.d_detach("raw")}, raw=True)
line_query("stream_lines", lambda: {"text": F.col("text")}, {"text": "text"})
line_query(
    "doi_extract", lambda: {"doi": T.extract_doi(F.col("text")), "doi_like": T.looks_like_doi(F.col("text"))},
    {
        "doi": r"regexp_replace(regexp_extract(text, '(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)', 1), '[.,]+$', '')",
        "doi_like": f"starts_with({V.d_low(V.d_trim('text'))}, '10.') OR contains({V.d_low(V.d_trim('text'))}, 'doi:') OR contains({V.d_low(V.d_trim('text'))}, 'doi.org/')",
    },
)
line_query(
    "author_lists", lambda: {"authors": T.joined(T.authors(F.col("text")), "|")},
    {"authors": f"array_to_string({V.d_authors('text')}, '|')"},
)
YAML_SQL = r"""CASE WHEN {x} = '' OR regexp_matches({x}, '[:"''#{{}}\[\],&*?|>!%@`\\]') OR {x} LIKE ' %' OR {x} LIKE '% ' OR contains({x}, chr(10)) THEN '"' || replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' ELSE {x} END"""
line_query("yaml_scalars", lambda: {"yaml": T.yaml_escape(F.col("raw"))}, {"yaml": YAML_SQL.format(x="raw")}, raw=True)
line_query(
    "sentence_end", lambda: {"ends": T.ends_sentence(F.col("text")), "digits": T.is_digits(F.col("text")), "mostly": T.mostly_digits(F.col("text"))},
    {"ends": rf"""regexp_matches({V.d_trim('text')}, '[.!?]["'')\]*]*$')""", "digits": f"regexp_matches({V.d_trim('text')}, '^[0-9]+$')", "mostly": r"regexp_matches(text, '^[0-9\s/-]*[0-9][0-9\s/-]*$')"},
)
line_query("split_word_repair", lambda: {"repaired": T.fix_split_word(F.col("text"))}, {"repaired": rf"regexp_replace({V.d_collapse('text')}, '(?i)\bprofes-\s*sional\b|\bprofes\s+sional\b', 'professional', 'g')"})

LOW, TRIM = V.d_low(V.d_trim("text")), V.d_trim("text")
D_CAPTION = f"regexp_matches({LOW}, '^(figure |fig\\. |table )')"
D_FOOTNOTE = rf"(regexp_matches({TRIM}, '^(\[\d+\]|\d+)\s+\S') AND strlen({TRIM}) >= 2 AND strlen({TRIM}) < 300)"
D_BOILER = f"({V.d_in(LOW, R.BOILERPLATE_EXACT)} OR regexp_matches({LOW}, '^[a-z]$') OR {V.d_starts(LOW, R.BOILERPLATE_STARTS)} OR {V.d_any(LOW, R.BOILERPLATE_CONTAINS)} OR regexp_matches({LOW}, '{R.PUBLICATION_DATE}'))"
D_ANCILLARY = f"({LOW} <> '' AND ({V.d_any(LOW, R.ANCILLARY_CONTAINS)} OR (starts_with({LOW}, 'american psychological') AND strlen({LOW}) < 80) OR (contains({LOW}, 'american psychological association') AND contains({LOW}, 'subscription'))))"
D_LEVEL = rf"""CASE WHEN {V.d_in(LOW, R.SECTIONS_EXACT)} OR starts_with({LOW}, 'appendix ') THEN 1 WHEN {LOW} IN ('keywords', 'key words') THEN 2
 WHEN {LOW} IN ('general terms', 'categories and subject descriptors') THEN 1
 WHEN regexp_matches({TRIM}, '{R.NUMBERED}') THEN least(6, len(regexp_extract_all(regexp_extract({TRIM}, '{R.NUMBERED}', 1), '\.')) + 1)
 WHEN {V.d_in(LOW, [*R.SECTIONS, 'references'])} OR {V.d_starts(LOW, [f'{s} ' for s in [*R.SECTIONS, 'references']])} THEN 1
 WHEN strlen({TRIM}) < 80 AND NOT contains({TRIM}, '.') AND len(regexp_extract_all({TRIM}, '[A-Za-z]')) >= 4 AND len(regexp_extract_all({TRIM}, '[A-Z]')) >= len(regexp_extract_all({TRIM}, '[A-Za-z]')) // 2 THEN 1 ELSE 0 END"""
D_ACCEPT = rf"(({D_LEVEL}) > 0 AND strlen({TRIM}) < 120 AND (regexp_matches({TRIM}, '{R.NUMBERED}') OR NOT contains({TRIM}, ' ') OR strlen({TRIM}) < 90 OR {LOW} IN ('abstract', 'keywords', 'references', 'conclusion')))"
NAMES = "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in R.SECTIONS)
D_NAME = f"regexp_extract({V.d_low('text')}, '^({NAMES})', 1)"
D_GLUED = f"({D_NAME} <> '' AND ({V.d_low('text')} = {D_NAME} OR strlen(text) > strlen({D_NAME}) + 1))"
PAIRS = " OR ".join(f"(contains({LOW}, '{a}') AND contains({LOW}, '{b}'))" for a, b in R.ROSTER_PAIRS)
D_ROSTER = rf"""(strlen({TRIM}) BETWEEN 10 AND 280 AND NOT {V.d_any(LOW, R.PROSE)} AND ({PAIRS} OR (len(regexp_extract_all({TRIM}, ',')) >= 3 AND contains({LOW}, ' and ')
 AND len(regexp_extract_all({TRIM}, '(?:^|[^A-Za-z])[A-Z]')) >= 6 AND regexp_matches({TRIM}, '^[A-Z]') AND strlen({TRIM}) < 200)))"""
line_query("boilerplate_lines", lambda: {"boilerplate": R.is_boilerplate(F.col("text")), "ancillary": R.is_ancillary(F.col("text"))}, {"boilerplate": D_BOILER, "ancillary": D_ANCILLARY})
line_query("heading_levels", lambda: {"level": R.heading_level(F.col("text")).cast("long"), "accepted": R.is_accepted_heading(F.col("text"))}, {"level": f"CAST({D_LEVEL} AS BIGINT)", "accepted": D_ACCEPT})
line_query("caption_footnote_lines", lambda: {"caption": T.is_caption(F.col("text")), "footnote": T.is_footnote(F.col("text"))}, {"caption": D_CAPTION, "footnote": D_FOOTNOTE})
line_query("author_roster", lambda: {"roster": R.is_author_roster(F.col("text"))}, {"roster": D_ROSTER})
line_query(
    "glued_heading", lambda: {"heading": R.glued_heading(F.col("text"))["heading"], "rest": R.glued_heading(F.col("text"))["rest"]},
    {"heading": f"CASE WHEN {D_GLUED} THEN left(text, length({D_NAME})) ELSE '' END", "rest": f"CASE WHEN {D_GLUED} THEN {V.d_trim(f'substring(text, length({D_NAME}) + 1)')} ELSE text END"},
)
D_REFS = f"({V.d_in(LOW, ['references', 'bibliography', 'works cited'])} OR (starts_with({LOW}, 'references') AND strlen({LOW}) <= 14))"
line_query("references_heading", lambda: {"refs": R.is_references_heading(F.col("text"))}, {"refs": D_REFS})


def _d_cut(x: str) -> str:
    for phrase in R.CHROME_CUT:
        x = f"CASE WHEN position('{phrase}' IN {V.d_low(x)}) > 1 THEN {V.d_trim(f"left({x}, position('{phrase}' IN {V.d_low(x)}) - 1)")} ELSE {x} END"
    return x


def _d_head(x: str) -> str:
    t = V.d_collapse(x)
    low = V.d_low(t)
    under = " OR ".join(f"(contains({low}, '{p}') AND strlen({t}) < {n})" for p, n in R.CHROME_UNDER)
    return rf"""({t} = '' OR {V.d_any(low, R.CHROME_CONTAINS)} OR {V.d_in(low, R.CHROME_EXACT)} OR (contains({low}, 'vol.') AND contains({low}, 'no.')) OR contains({low}, '/vol.') OR {under}
 OR (regexp_matches({t}, '^[0-9\s/-]*[0-9][0-9\s/-]*$') AND strlen({t}) <= 3) OR (strlen({t}) = 1 AND NOT regexp_matches({t}, '^[0-9aAiI]$')))"""


def cut_sql(source: str, columns: str = "doc_id, line_no") -> str:
    return f"""c0 AS (SELECT {columns}, {_d_cut('text')} AS text FROM {source}),
cut AS (SELECT {columns}, CASE WHEN regexp_matches(text, '[\\s\\x0B][B-HJ-Zb-hj-z]$') AND strlen(text) >= 3 THEN {V.d_trim("regexp_replace(text, '[A-Za-z]$', '')")} ELSE text END AS text FROM c0),
clean AS (SELECT {columns}, text FROM cut WHERE NOT {_d_head('text')})"""


CUT_SQL = f"{V.LINES}, {cut_sql('lines')}"


@query(f"WITH {CUT_SQL} SELECT doc_id, line_no, text FROM clean")
def chrome_filter(spark, sf_dir):
    """Lines without running heads and feet."""
    return L.without_chrome(V.marked_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


QUALITY_SQL = f"""SELECT doc_id, words, suspect, CASE WHEN words < 8 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - least(0.75::DOUBLE, 4.0::DOUBLE * suspect / words) END AS quality FROM
(SELECT doc_id, count(w) AS words, count(*) FILTER ({V.d_suspect('w')}) AS suspect FROM (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS w FROM (SELECT doc_id, {V.d_words('text')} AS l FROM lines)) GROUP BY doc_id)"""


@query(f"WITH {V.RAW}, {V.d_stream('raw_lines')} {QUALITY_SQL}")
def doc_quality(spark, sf_dir):
    """A3, the flagship: quality of each document's line stream."""
    return L.quality(L.stream_lines(L.physical_lines(V.documents(spark, sf_dir))))


@query(f"WITH {V.WORDS} SELECT doc_id, count(*) AS n, sum(strlen(word))::BIGINT AS n_bytes, count(DISTINCT word) AS n_distinct FROM words GROUP BY doc_id")
def word_tokens(spark, sf_dir):
    """T5: words of each document."""
    w = V.documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    # words hold no blanks, so a document's distinct ones travel as one text; rows of one doc_id meet
    rows = w.select("doc_id", F.size("w").alias("n"), T.size(F.array_join("w", "")).alias("b"), F.array_join(F.array_distinct("w"), " ").alias("d"))
    found = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("b").alias("n_bytes"), F.array_join(F.collect_list("d"), " ").alias("d"))
    return found.select("doc_id", "n", "n_bytes", F.size(F.array_distinct(F.split("d", " "))).cast("long").alias("n_distinct"))


RUN_SQL = """, r1 AS (SELECT *, coalesce(lag(text) OVER w LIKE '%-' AND regexp_matches(text, '^[a-z]'), false) AS can FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r2 AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS chain FROM r1),
r3 AS (SELECT *, {joins} AS joins FROM r2), r4 AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, lead(joins) OVER (PARTITION BY doc_id ORDER BY line_no) AS goes_on FROM r3)
SELECT doc_id, min(line_no) AS line_no, string_agg(CASE WHEN goes_on THEN regexp_replace(text, '-$', '') ELSE text END, '' ORDER BY line_no) AS text FROM r4 GROUP BY doc_id, run"""
PLAIN = f"{V.MARK}, plain AS (SELECT doc_id, line_no, {V.d_collapse('raw')} AS text FROM marked WHERE {V.d_collapse('raw')} <> '')"


def _plain(spark, sf_dir):
    return V.marked(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.collapse(F.col("raw")).alias("text")).filter("text <> ''")


@query(f"WITH {PLAIN}{RUN_SQL.format(src='plain', joins='can')}")
def hyphen_rejoin(spark, sf_dir):
    """Chains of lines that end in a hyphen."""
    return L.rejoin_hyphens(_plain(spark, sf_dir))


@query(f"WITH {PLAIN}{RUN_SQL.format(src='plain', joins='can AND row_number() OVER (PARTITION BY doc_id, chain ORDER BY line_no) % 2 = 0')}")
def hyphen_pairs(spark, sf_dir):
    """The same, pair by pair."""
    return L.stitch_pairs(_plain(spark, sf_dir))


SCORE_SQL = f"""WITH {V.LINES}, a AS (SELECT doc_id, {V.d_low('text')} AS low, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS share FROM lines)
SELECT doc_id, CAST(sum(CASE WHEN starts_with(low, 'abstract') THEN CASE WHEN share < 0.25 THEN 50 ELSE -20 END ELSE 0 END + CASE WHEN starts_with(low, '1. introduction') OR low = '1. storyspace' THEN CASE WHEN share < 0.4 THEN 30 ELSE -10 END ELSE 0 END
 - CASE WHEN contains(low, 'permission to make digital') THEN 25 ELSE 0 END + CASE WHEN starts_with(low, 'what explains') THEN 20 ELSE 0 END + CASE WHEN starts_with(low, 'perseus and other') THEN 20 ELSE 0 END) + least(count(*), 200) AS BIGINT) AS score FROM a GROUP BY doc_id"""


@query(SCORE_SQL)
def stream_score(spark, sf_dir):
    """Marks of a line stream."""
    return L.stream_score(V.marked_lines(spark, sf_dir))


# ---- blocks ----
T_SQL = rf"regexp_replace({V.d_collapse(V.d_typography('text'))}, '(?i)\bprofes-\s*sional\b|\bprofes\s+sional\b', 'professional', 'g')"
D_NOISE = r"regexp_replace({x}, '(?i)\bprofes-\s*sional\b|\bprofes\s+sional\b', 'professional', 'g')"
DOC, ON_PAGE = "PARTITION BY doc_id ORDER BY page, line_no", "PARTITION BY doc_id, page ORDER BY line_no"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LOWT = V.d_low("text")
D_LIKE = "(lt <> '' AND (contains(lc, lt) OR (contains(lt, 'drudgery') AND contains(lc, 'rudgery') AND contains(lc, 'deep thought'))))"
D_REST = V.d_trim(f"CASE WHEN title <> '' AND starts_with({LOWT}, {V.d_low('title')}) THEN substring(text, length(title) + 1) ELSE regexp_replace(text, '(?i)^\\{{?\\s*d?\\s*rudgery and deep thought\\s*', '') END")


def block_sql(source: str) -> str:
    """blocks(doc_id, page, block_no, line_no, kind, level, text) and pieces from source(doc_id, page, line_no, text, family, title)."""
    like_rest = D_LIKE.replace("lc", V.d_low(V.d_collapse("rest")))
    return rf"""b0 AS (SELECT doc_id, page, line_no, family, title, {T_SQL} AS text FROM {source}), b1 AS (SELECT *, {LOWT} AS low, {V.d_low(V.d_collapse('text'))} AS lc, {V.d_low(V.d_collapse('title'))} AS lt, row_number() OVER ({ON_PAGE}) AS n, count(*) OVER (PARTITION BY doc_id, page) AS n_all FROM b0 WHERE text <> ''),
b2 AS (SELECT *, contains(low, '{B.PERMISSION}') OR coalesce(last_value(CASE WHEN contains(low, '{B.PERMISSION}') THEN true WHEN contains(low, '{B.PERMISSION_END}') THEN false END IGNORE NULLS) OVER ({ON_PAGE} {BEFORE}), false) AS held,
 coalesce(last_value(CASE WHEN {V.d_in('low', B.KEYWORDS)} THEN true WHEN regexp_matches(text, '{B.INTRODUCTION}') THEN false END IGNORE NULLS) OVER ({DOC} {BEFORE}), false) AND NOT {V.d_in('low', B.KEYWORDS)} AND NOT regexp_matches(text, '{B.INTRODUCTION}') AND NOT coalesce({V.d_in(f'lag(low) OVER ({ON_PAGE})', B.KEYWORDS)}, false) AS waits FROM b1),
b3 AS (SELECT *, {D_REST} AS rest, (family = 'acm' AND held) OR (family = 'frontiers' AND (waits OR (contains(low, 'in region') AND contains(low, 'last 36 months')))) OR {D_BOILER} OR (family = 'magazine' AND {D_ROSTER}) AS skips, {D_LIKE} AS titled, low IN ('abstract', 'keywords') OR starts_with(low, '{B.ANCHORS[0]}') AS plain FROM b2),
b4 AS (SELECT *, NOT skips AND CASE WHEN family = 'scan' THEN starts_with(low, '{B.SCAN_BODY}') ELSE plain OR CASE WHEN titled THEN rest <> '' AND NOT {like_rest} ELSE {V.d_starts('low', B.ANCHORS[1:])} END END AS anchor FROM b3),
b5 AS (SELECT *, coalesce(bool_or(anchor) OVER ({DOC} {BEFORE}), false) AS was FROM b4),
b6 AS (SELECT doc_id, page, line_no, n, n_all, family, (was OR anchor) AND NOT skips AS live, CASE WHEN NOT was AND anchor AND NOT plain AND family <> 'scan' AND titled THEN rest ELSE text END AS text FROM b5),
b7 AS (SELECT *, {D_CAPTION} AS caps, {D_GLUED} AS glues, {D_ACCEPT} AND NOT {D_GLUED} AND NOT {D_CAPTION} AS heading FROM b6),
b8 AS (SELECT *, coalesce(bool_or(live AND heading AND {LOWT} IN ('references', 'bibliography', 'works cited')) OVER ({DOC} {BEFORE}), false) AS seen FROM b7),
b9 AS (SELECT *, bool_or(seen AND {D_ANCILLARY}) OVER ({ON_PAGE}) AS dropped, n > 1 AND n + 2 > n_all AS at_end FROM b8),
b10 AS (SELECT *, CASE WHEN caps AND family = 'acm' THEN CASE WHEN regexp_matches(text, '(?i)^\s*(?:figure|fig\.)\s+0*6(?:[^0-9]|$)') THEN 'Sixth' ELSE 'Caption' END WHEN caps AND family = 'frontiers' AND regexp_matches(text, '{B.SHORT_FIGURE}') THEN 'Reference' WHEN caps THEN 'Figure'
 WHEN heading THEN 'Heading' WHEN {D_FOOTNOTE} AND at_end THEN 'Footnote' ELSE 'Paragraph' END AS kind FROM b9 WHERE live AND NOT dropped),
b11 AS (SELECT doc_id, page, line_no, n, family, at_end, 0 AS part, CASE WHEN glues AND NOT caps THEN 'Heading' ELSE kind END AS kind, CASE WHEN glues AND NOT caps THEN 1 WHEN kind = 'Heading' THEN {D_LEVEL} ELSE 0 END AS level, CASE WHEN glues AND NOT caps THEN left(text, length({D_NAME})) ELSE text END AS text FROM b10
 UNION ALL SELECT doc_id, page, line_no, n, family, at_end, 1, 'Paragraph', 0, {V.d_trim(f'substring(text, length({D_NAME}) + 1)')} FROM b10 WHERE glues AND NOT caps),
pieces AS (SELECT doc_id, page, line_no, n, part, CASE WHEN part = 1 AND {D_FOOTNOTE} AND at_end THEN 'Footnote' ELSE kind END AS kind, level, text, coalesce(n < max(CASE WHEN family = 'magazine' AND kind = 'Heading' AND {LOWT} = '{B.CLEARING}' THEN n END) OVER (PARTITION BY doc_id, page), false) AS cleared FROM b11 WHERE text <> ''),
b12 AS (SELECT *, kind IN ('Paragraph', 'Reference') AS prose FROM pieces WHERE kind <> 'Figure' AND NOT cleared),
b13a AS (SELECT *, NOT prose OR coalesce(NOT lag(prose) OVER w, true) OR coalesce(kind = 'Paragraph' AND n - lag(n) OVER w > 1 AND regexp_matches({V.d_trim('lag(text) OVER w')}, '[.!?]["'')\]*]*$'), false) AS opens FROM b12 WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no, part)),
b13 AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_no, part) AS run FROM b13a),
b14 AS (SELECT *, lead(kind) OVER (PARTITION BY doc_id, page, run ORDER BY line_no, part) AS next_kind FROM b13 WHERE kind <> 'Sixth'),
b15 AS (SELECT doc_id, page, run, min(line_no) AS line_no, min(CASE WHEN kind = 'Reference' THEN 'Paragraph' ELSE kind END) AS kind, CAST(min(level) AS BIGINT) AS level, string_agg(CASE WHEN next_kind IS NULL OR (text LIKE '%-' AND next_kind <> 'Reference') THEN text ELSE text || ' ' END, '' ORDER BY line_no, part) AS text FROM b14 GROUP BY doc_id, page, run),
blocks AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, run) AS block_no, line_no, kind, level, CASE WHEN kind = 'Paragraph' THEN {D_NOISE.format(x=V.d_collapse('text'))} ELSE text END AS text FROM b15)"""


PAGED = f"""{V.LINES}, paged AS (SELECT doc_id, {V.LINE_PAGE} AS page, line_no, text, CASE doc_id % 5 WHEN 0 THEN 'acm' WHEN 1 THEN 'magazine' WHEN 2 THEN 'scan' WHEN 3 THEN 'frontiers' ELSE 'generic' END AS family, {V.TITLE} AS title FROM lines)"""
BLOCK_SQL = f"{PAGED}, {block_sql('paged')}"
GENERIC_SQL = f"{V.LINES}, plain_page AS (SELECT doc_id, 0::BIGINT AS page, line_no, text, 'generic' AS family, '' AS title FROM lines), {block_sql('plain_page')}"


def _made(spark, sf_dir, what):
    return B.of_streams(V.titled_streams(spark, sf_dir), what, V.PER_PAGE)


@query(f"WITH {GENERIC_SQL} SELECT doc_id, block_no, line_no, kind, level, text FROM blocks")
def generic_blocks(spark, sf_dir):
    """Blocks of the generic layout."""
    found = B.of_streams(V.marked_streams(spark, sf_dir).withColumn("family", F.lit("generic")).withColumn("title", F.lit("")), "blocks")
    return found.select("doc_id", F.col("block_no").cast("long").alias("block_no"), "line_no", "kind", F.col("level").cast("long").alias("level"), "text")


@query(f"WITH {BLOCK_SQL} SELECT doc_id, page, block_no, line_no, kind, level, text FROM blocks")
def family_blocks(spark, sf_dir):
    """Blocks of all layout families, page by page."""
    return _made(spark, sf_dir, "blocks").select("doc_id", "page", F.col("block_no").cast("long").alias("block_no"), "line_no", "kind", F.col("level").cast("long").alias("level"), "text")


def title_sql(source: str = "blocks") -> str:
    return f"SELECT doc_id, arg_min(text, block_no) AS title FROM {source} WHERE kind = 'Heading' AND strlen(text) >= 8 AND {LOWT} NOT IN ('abstract', 'keywords', 'references') GROUP BY doc_id"


def abstract_sql(source: str = "blocks") -> str:
    return f"""SELECT doc_id, arg_min(t, page) AS abstract FROM (SELECT doc_id, page, arg_min(kind, block_no) AS k, arg_min(text, block_no) AS t FROM (SELECT *, bool_or(kind = 'Heading' AND {LOWT} = 'abstract') OVER (PARTITION BY doc_id, page ORDER BY block_no) AS after_it FROM {source})
 WHERE after_it AND (kind = 'Paragraph' OR (kind = 'Heading' AND {LOWT} <> 'abstract')) GROUP BY ALL) WHERE k = 'Paragraph' AND len({V.d_words('t')}) >= 40 GROUP BY doc_id"""


def keywords_sql(source: str = "blocks") -> str:
    named = f"(kind = 'Heading' AND {LOWT} IN ('keywords', 'key words'))"
    return f"""SELECT doc_id, arg_min(k, page) AS keywords FROM (SELECT doc_id, page, list_filter(list_transform(string_split(arg_min(text, block_no), ','), lambda p: {V.d_trim('p')}), lambda p: p <> '' AND strlen(p) < 80) AS k FROM (SELECT *, bool_or({named}) OVER (PARTITION BY doc_id, page ORDER BY block_no) AS after_it FROM {source})
 WHERE after_it AND NOT {named} AND kind IN ('Paragraph', 'Heading') GROUP BY ALL) WHERE len(k) > 0 GROUP BY doc_id"""


@query(f"WITH {BLOCK_SQL} {title_sql()}")
def title_fallback(spark, sf_dir):
    """Titles from headings."""
    return _made(spark, sf_dir, "title")


@query(f"WITH {BLOCK_SQL} {abstract_sql()}")
def abstract_extract(spark, sf_dir):
    """Abstracts."""
    return _made(spark, sf_dir, "abstract")


@query(f"WITH {BLOCK_SQL} SELECT doc_id, array_to_string(keywords, '|') AS keywords FROM ({keywords_sql()})")
def keywords_split(spark, sf_dir):
    """Keywords."""
    return _made(spark, sf_dir, "keywords").select("doc_id", F.array_join("keywords", "|").alias("keywords"))


COUNTS = "counted AS (SELECT doc_id, max(page) + 1 AS pages, count(*) FILTER (kind = 'Heading') AS headings, count(*) FILTER (kind = 'Table') AS tables, count(*) FILTER (kind IN ('Figure', 'Caption', 'Sixth')) AS figures, count(*) FILTER (kind = 'Footnote' AND NOT cleared) AS footnotes FROM pieces GROUP BY doc_id)"


@query(f"WITH {BLOCK_SQL}, {COUNTS} SELECT * FROM counted")
def doc_stats(spark, sf_dir):
    """A13 and SNK9: counts of each document."""
    return _made(spark, sf_dir, "counts")


def body_sql(source: str, titles: str) -> str:
    """body(doc_id, markdown) of blocks, without those that repeat the title."""
    same = f"{V.d_low(V.d_collapse('b.text'))} = {V.d_low(V.d_collapse('t.title'))}"
    return f"""m AS (SELECT b.*, {V.d_low('b.text')} AS low FROM {source} b LEFT JOIN {titles} t USING (doc_id) WHERE coalesce(t.title, '') = '' OR NOT {same} OR b.kind = 'Footnote'),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY block_no) AS note FROM m),
o AS (SELECT doc_id, block_no, low, kind, CASE WHEN kind = 'Heading' THEN repeat('#', greatest(1, least(CASE WHEN low = 'abstract' THEN 1 WHEN low IN ('keywords', 'key words') THEN 2 ELSE level END, 6))::INT) || ' ' || text || chr(10) || chr(10) WHEN kind = 'Paragraph' THEN text || chr(10) || chr(10) WHEN kind = 'Caption' THEN '**' || text || '**' || chr(10) || chr(10) ELSE '' END AS md,
 CASE WHEN kind = 'Footnote' THEN '[^' || note || ']: ' || text || chr(10) || chr(10) ELSE '' END AS fn FROM n),
p AS (SELECT doc_id, string_agg(md, '' ORDER BY block_no) AS body, string_agg(fn, '' ORDER BY block_no) AS notes, bool_or(kind = 'Heading' AND low = 'references') AS refs FROM o GROUP BY doc_id),
body AS (SELECT doc_id, body || CASE WHEN notes = '' THEN '' WHEN refs THEN chr(10) || notes ELSE chr(10) || chr(10) || notes END AS markdown FROM p)"""


@query(f"WITH {BLOCK_SQL}, titles AS ({title_sql()}), {body_sql('blocks', 'titles')} SELECT * FROM body")
def markdown_body(spark, sf_dir):
    """SNK1, SNK3, SNK5 to SNK7: Markdown of each document."""
    return _made(spark, sf_dir, "markdown")


MERGE_SQL = f"""WITH {V.LINES}, k AS (SELECT doc_id, line_no, CASE WHEN {D_ACCEPT} THEN 'Heading' ELSE 'Paragraph' END AS kind, text FROM lines),
f AS (SELECT *, coalesce(kind = 'Paragraph' AND lag(kind) OVER w = 'Paragraph' AND NOT regexp_matches({V.d_trim('lag(text) OVER w')}, '[.!?]["'')\\]*]*$'), false) AS follows FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run, coalesce(lead(follows) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS goes_on FROM f)
SELECT doc_id, min(line_no) AS line_no, arg_min(kind, line_no) AS kind, string_agg(CASE WHEN NOT goes_on THEN text WHEN text LIKE '%-' THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY line_no) AS text FROM g GROUP BY doc_id, run"""


@query(MERGE_SQL)
def paragraph_merge(spark, sf_dir):
    """Paragraphs that don't end a sentence take on the next."""
    rows = V.marked_lines(spark, sf_dir).withColumn("kind", F.when(R.is_accepted_heading(F.col("text")), "Heading").otherwise("Paragraph"))
    return L.merge_paragraphs(rows).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", "text")


def yaml_sql(x: str) -> str:
    return YAML_SQL.format(x=x)


def head_sql(title: str, authors: str, doi: str, keywords: str, abstract: str, more: str = "''") -> str:
    """A document's head; more: lines between the DOI and the keywords."""
    item = f"lambda a: '  - ' || {yaml_sql('a')} || chr(10)"
    return f"""'---' || chr(10) || 'title: ' || {yaml_sql(title)} || chr(10) || 'authors:' || chr(10) || CASE WHEN len({authors}) > 0 THEN array_to_string(list_transform({authors}, {item}), '') ELSE '  []' || chr(10) END
 || CASE WHEN {doi} <> '' THEN 'object-url: ' || {yaml_sql(f"('https://doi.org/' || {doi})")} || chr(10) ELSE '' END || 'source-format: PDF' || chr(10) || CASE WHEN {doi} <> '' THEN 'doi: ' || {yaml_sql(doi)} || chr(10) ELSE '' END || {more}
 || CASE WHEN len({keywords}) > 0 THEN 'keywords:' || chr(10) || array_to_string(list_transform({keywords}, {item}), '') ELSE '' END || CASE WHEN {abstract} <> '' THEN 'abstract: |' || chr(10) || array_to_string(list_transform(string_split(regexp_replace({abstract}, '\n$', ''), chr(10)), lambda a: '  ' || a || chr(10)), '') ELSE '' END || '---' || chr(10) || chr(10)"""


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {V.d_authors("coalesce(text, '')")} AS authors, CASE WHEN doc_id % 2 = 0 THEN '10.1000/' || doc_id ELSE '' END AS doi FROM documents)
SELECT doc_id, {head_sql('t', 'authors', 'doi', "list_filter([coalesce(NULL, t)], lambda k: doc_id % 3 = 0)", "CASE WHEN doc_id % 5 = 0 THEN t ELSE '' END", "'date-extracted: 2020-05-03' || chr(10)")} AS head FROM d""")
def yaml_front_matter(spark, sf_dir):
    """SNK1, SNK2, W16: heads of Markdown files, of whole texts as titles, authors, keywords and abstracts."""
    t = F.coalesce("text", F.lit(""))
    doi = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string"))).otherwise("")
    meta = {"title": t, "object-url": B.object_url(doi), "doi": doi, "date-extracted": F.lit("2020-05-03")}
    head = B.front_matter(meta, T.authors(t), F.when(F.col("doc_id") % 3 == 0, F.array(t)).otherwise(F.array().cast("array<string>")), F.when(F.col("doc_id") % 5 == 0, t).otherwise(""))
    return V.documents(spark, sf_dir).select("doc_id", head.alias("head"))


FAMILY = "CASE " + " ".join(f"WHEN {V.d_any(V.d_low("path || ' ' || title"), p)} THEN '{n}'" for n, p in R.FAMILIES) + " ELSE 'generic' END"
PATHS = "concat('/in/Sub.', cast(doc_id as string), '/', element_at(array('CCP_Addis2000', 'acm_bernstein2002', 'paper', 'candidate_paper'), cast(doc_id % 4 as int) + 1), '.PDF')"


@query(f"""WITH d AS (SELECT doc_id, '/in/Sub.' || doc_id || '/' || ['CCP_Addis2000', 'acm_bernstein2002', 'paper', 'candidate_paper'][doc_id % 4 + 1] || '.PDF' AS path, CASE WHEN doc_id % 5 = 0 THEN 'Drudgery' ELSE lang END AS title FROM documents)
SELECT doc_id, {FAMILY} AS family, {V.d_low('path')} LIKE '%.pdf' AS is_pdf, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, '/out/' || regexp_replace(substring(path, 5), '\\.[^./]*$', '.md') AS output_path FROM d""")
def layout_family(spark, sf_dir):
    """P18, SRC1, SRC3, T12: families and output places of input paths."""
    from quire.sources import jobs

    d = V.documents(spark, sf_dir).select("doc_id", F.expr(PATHS).alias("path"), F.when(F.col("doc_id") % 5 == 0, "Drudgery").otherwise(F.col("lang")).alias("title"))
    return d.select("doc_id", R.layout_family(F.col("path"), F.col("title")).alias("family"), jobs.is_pdf(F.col("path")).alias("is_pdf"), T.stem(F.col("path")).alias("stem"), jobs.output_path(F.col("path"), "/in", "/out").alias("output_path"))


# ---- geometry ----
MEDIANS = """med AS (SELECT doc_id, page, coalesce(list_sort(list(font_size) FILTER (font_size > 0))[count(*) FILTER (font_size > 0) // 2 + 1], 0.0::DOUBLE) AS median_font,
 coalesce(list_sort(list(y1 - y0) FILTER (y1 - y0 > 0))[count(*) FILTER (y1 - y0 > 0) // 2 + 1], 0.0::DOUBLE) AS median_height FROM boxes GROUP BY doc_id, page)"""
HIST = """enough AS (SELECT doc_id, page FROM reg WHERE region = 'Body' AND x1 - x0 <= 360 GROUP BY doc_id, page HAVING count(*) >= 30),
cov AS (SELECT doc_id, page, unnest(range(least(239, greatest(0, floor(x0 / 600 * 240)))::INT, least(239, greatest(0, ceil(x1 / 600 * 240)))::INT + 1)) AS bin FROM reg WHERE region = 'Body' AND x1 - x0 <= 360),
bins AS (SELECT e.doc_id, e.page, g.bin, coalesce(c.n, 0) AS n FROM enough e CROSS JOIN (SELECT unnest(range(240))::INT AS bin) g LEFT JOIN (SELECT doc_id, page, bin, count(*) AS n FROM cov GROUP BY ALL) c ON c.doc_id = e.doc_id AND c.page = e.page AND c.bin = g.bin)"""
CUTS = """fr AS (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS island FROM bins WHERE bin >= 67 AND bin < 172 AND n <= 1),
ru AS (SELECT doc_id, page, min(bin) AS a, count(*) AS k FROM fr GROUP BY doc_id, page, island), be AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k DESC, a) AS r FROM ru),
cuts AS (SELECT doc_id, page, k * 600.0::DOUBLE / 240 AS gap, (2 * a + k) * 0.5::DOUBLE / 240 * 600 AS cut FROM be WHERE r = 1 AND k * 600.0::DOUBLE / 240 >= 12)"""


@query(f"WITH {V.BOX}, {MEDIANS} SELECT * FROM med")
def box_medians(spark, sf_dir):
    """A1, A2."""
    return G.medians(V.boxes(spark, sf_dir))


@query(f"""WITH {V.BOX}, g AS (SELECT *, lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0, box_id) AS x_before, count(*) OVER (PARTITION BY doc_id, page) AS n_all FROM boxes),
f AS (SELECT doc_id, page, (x_before + x0) / 2 AS m FROM g WHERE n_all >= 20 AND x0 - x_before >= 12 AND x0 > 168 AND x0 < 432), c AS (SELECT doc_id, page, (min(row(abs(m - 300), m)))[2] AS cut FROM f GROUP BY ALL)
SELECT b.doc_id, b.page, c.cut FROM boxes b JOIN c ON b.doc_id = c.doc_id AND b.page = c.page GROUP BY ALL HAVING count(*) FILTER ((b.x0 + b.x1) / 2 < c.cut) > 15 AND count(*) FILTER ((b.x0 + b.x1) / 2 >= c.cut) > 15""")
def x_gap_columns(spark, sf_dir):
    """A8."""
    return G.gap_column(V.boxes(spark, sf_dir))


STARTS = """fs AS (SELECT b.doc_id, b.page, coalesce(min(y0) FILTER (hit AND (x0 + x1) / 2 < 300), 801.0::DOUBLE) AS start_left, coalesce(min(y0) FILTER (hit AND NOT (x0 + x1) / 2 < 300), 801.0::DOUBLE) AS start_right FROM
 (SELECT boxes.*, regexp_matches(text, '^[0-9]+$') AND strlen(text) <= 2 AND y0 >= 800 * 0.68::DOUBLE AND (median_height <= 0 OR y1 - y0 <= median_height * 0.82::DOUBLE) AND (x0 / 600 < 0.15 OR abs(x0 / 600 - 0.53::DOUBLE) < 0.055) AS hit FROM boxes JOIN med USING (doc_id, page)) b GROUP BY ALL)"""
SEEDS = r"""seeds AS (SELECT s.doc_id, s.page, s.box_id FROM (SELECT * FROM boxes WHERE regexp_matches(text, '(?i)^(figure|fig\.|table)(?:\s+\d+[a-z]?[\.:]?)?$')) s LEFT JOIN boxes o ON s.doc_id = o.doc_id AND s.page = o.page
 AND ((s.x0 + s.x1) / 2 < 300) = ((o.x0 + o.x1) / 2 < 300) AND abs(o.y0 - s.y0) <= 2.5 AND o.box_id <> s.box_id GROUP BY ALL
 HAVING bool_or(regexp_matches(s.text, '\d') OR coalesce(o.x0 > s.x1 AND o.x0 - s.x1 < 45 AND regexp_matches(o.text, '^\d+[A-Za-z]?[\.:]?$'), false)) AND NOT bool_or(coalesce(o.x1 < s.x0, false)))"""


@query(f"WITH {V.BOX}, {MEDIANS}, {STARTS} SELECT * FROM fs")
def footnote_start(spark, sf_dir):
    """A5."""
    return G.footnote_start(V.boxes(spark, sf_dir))


@query(f"WITH {V.BOX}, {SEEDS} SELECT * FROM seeds")
def caption_seed(spark, sf_dir):
    """J3."""
    return G.caption_seeds(V.boxes(spark, sf_dir))


LOWB = V.d_low("text")
#: Page overrides of the queries: regions of page 1, kept captions on page 2.
OVERRIDES = ["page=1; region=sidebar; units=frac; origin=bottomleft; box=0.0,0.9,0.4,0.7", "page=1; region=header; box=300,200,600,230", "page=2; keep_captions=true"]
D_ROLE = "CASE WHEN page = 1 AND (x0 + x1) / 2 BETWEEN 0 AND 240 AND (y0 + y1) / 2 BETWEEN 800 - 0.9::DOUBLE * 800 AND 800 - 0.7::DOUBLE * 800 THEN 'Sidebar' WHEN page = 1 AND (x0 + x1) / 2 BETWEEN 300 AND 600 AND (y0 + y1) / 2 BETWEEN 200 AND 230 THEN 'Header' END"
REGIONS = f"""reg AS (SELECT b.*, median_height, CASE WHEN family IN ('acm', 'magazine') AND b.page = 0 THEN 'Wrapper' WHEN text = '' THEN 'Metadata' WHEN {D_ROLE.replace('page =', 'b.page =')} IS NOT NULL THEN {D_ROLE.replace('page =', 'b.page =')}
 WHEN family = 'frontiers' AND ({V.d_in(LOWB, G.RAIL_HEADS)} OR {V.d_any(LOWB, G.RAIL_HEAD_WORDS)}) THEN 'Header'
 WHEN rotation <> 0 OR ((x0 < 27 OR x1 > 573) AND {V.d_any(LOWB, G.MARGIN_WORDS)}) THEN 'MarginOverlay' WHEN family = 'frontiers' AND b.page > 0 AND y0 < 48 THEN 'Header'
 WHEN y0 < 48 AND (regexp_matches(text, '^[0-9]+$') OR {V.d_any(LOWB, G.HEADER_WORDS)}) THEN 'Header' WHEN y1 > 800 * (1 - 0.06::DOUBLE) AND (regexp_matches(text, '^[0-9]+$') OR {V.d_any(LOWB, G.FOOTER_WORDS)}) THEN 'Footer'
 WHEN s.box_id IS NOT NULL AND family <> 'acm' AND b.page <> 2 THEN 'Float' WHEN CASE WHEN (x0 + x1) / 2 < 300 THEN start_left ELSE start_right END <= 800 AND y0 >= CASE WHEN (x0 + x1) / 2 < 300 THEN start_left ELSE start_right END - 1 THEN 'Footnote'
 WHEN family = 'frontiers' AND b.page = 0 AND x1 <= 600 * 0.30::DOUBLE THEN 'Sidebar' WHEN family = 'frontiers' AND b.page = 0 AND x0 > 600 * 0.30::DOUBLE AND y0 > 800 * 0.72::DOUBLE THEN 'Footnote'
 WHEN {V.d_any(LOWB, G.METADATA_WORDS)} THEN 'Metadata' WHEN family = 'acm' AND {V.d_any(LOWB, G.CONFERENCE_WORDS)} THEN 'Metadata'
 WHEN family = 'scan' AND b.page = 0 AND y0 > 800 * 0.72::DOUBLE AND x1 < 300 AND (median_font = 0 OR font_size < median_font * 0.9::DOUBLE) THEN 'AuthorNote'
 WHEN y0 > 800 * 0.82::DOUBLE AND median_font > 0 AND font_size > 0 AND font_size < median_font * 0.82::DOUBLE THEN 'Footnote' ELSE 'Body' END AS region
 FROM boxes b JOIN med USING (doc_id, page) JOIN fs USING (doc_id, page) LEFT JOIN seeds s ON s.doc_id = b.doc_id AND s.page = b.page AND s.box_id = b.box_id)"""
REG = f"{V.BOX}, {MEDIANS}, {STARTS}, {SEEDS}, {REGIONS}"


def _classified(boxes):
    from quire.sources import settings

    return G.classify(boxes, settings.overrides(OVERRIDES)[0])


def _regions(spark, sf_dir):
    return _classified(V.boxes(spark, sf_dir))


@query(f"WITH {REG} SELECT doc_id, page, box_id, region FROM reg")
def region_classify(spark, sf_dir):
    """P24, J1, J2, P19."""
    return _regions(spark, sf_dir).select(*G.PAGE, "box_id", "region")


@query(f"WITH {REG}, {HIST} SELECT doc_id, page, bin, n FROM bins")
def column_histogram(spark, sf_dir):
    """A6."""
    return G.histogram(_regions(spark, sf_dir))


@query(f"WITH {REG}, {HIST}, {CUTS} SELECT doc_id, page, gap, cut FROM cuts")
def column_cut(spark, sf_dir):
    """A7."""
    return G.column_cut(_regions(spark, sf_dir))


@query(f"""WITH {REG}, w AS (SELECT doc_id, page, region, text, {V.d_words('text')} AS l FROM reg), c AS (SELECT doc_id, page, coalesce(sum(strlen(text)) FILTER (region = 'Body'), 0) AS bytes, coalesce(sum(len(l)) FILTER (region = 'Body'), 0) AS words,
 coalesce(sum(len(list_filter(l, lambda x: strlen(x) > 24)) + 2 * len(list_filter(l, lambda x: {V.d_suspect('x').partition(' OR ')[2]})) FILTER (region = 'Body'), 0) AS bad FROM w GROUP BY ALL)
SELECT doc_id, page, CASE WHEN bytes < 40 OR words < 8 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - least(0.75::DOUBLE, bad::DOUBLE / words * 4.0) END AS quality FROM c""")
def box_quality(spark, sf_dir):
    """A4."""
    return G.box_quality(_regions(spark, sf_dir))


#: From each seed down its half page's rows, step by step, as written.
ISLANDS = f"""WITH RECURSIVE {REG}, sd AS (SELECT DISTINCT doc_id, page, (x0 + x1) / 2 < 300 AS l, y0 AS start, median_height AS h FROM reg WHERE region = 'Float'),
ro AS MATERIALIZED (SELECT doc_id, page, l, start, h, y, row_number() OVER (PARTITION BY doc_id, page, l, start ORDER BY y) AS i FROM (SELECT DISTINCT sd.*, r.y0 AS y FROM sd JOIN reg r ON r.doc_id = sd.doc_id AND r.page = sd.page AND ((r.x0 + r.x1) / 2 < 300) = sd.l WHERE r.y0 + 1 >= sd.start)),
st AS (SELECT doc_id, page, l, start, h, 0::BIGINT AS i, start + greatest(18, h * 2) AS finish, start AS last, NULL::DOUBLE AS kept, false AS done FROM sd UNION ALL
 SELECT s.doc_id, s.page, s.l, s.start, s.h, r.i, CASE WHEN NOT coalesce(abs(s.kept - r.y) <= 2, false) AND r.y >= s.start AND NOT r.y - s.last > greatest(18, s.h * 1.8::DOUBLE) THEN r.y + s.h * 1.2::DOUBLE ELSE s.finish END,
  CASE WHEN NOT coalesce(abs(s.kept - r.y) <= 2, false) AND r.y >= s.start AND NOT r.y - s.last > greatest(18, s.h * 1.8::DOUBLE) THEN r.y ELSE s.last END, CASE WHEN coalesce(abs(s.kept - r.y) <= 2, false) THEN s.kept ELSE r.y END,
  NOT coalesce(abs(s.kept - r.y) <= 2, false) AND r.y >= s.start AND r.y - s.last > greatest(18, s.h * 1.8::DOUBLE) FROM st s JOIN ro r ON r.doc_id = s.doc_id AND r.page = s.page AND r.l = s.l AND r.start = s.start AND r.i = s.i + 1 WHERE NOT s.done),
bd AS (SELECT doc_id, page, l, start, max(finish) AS finish FROM st GROUP BY ALL)
SELECT doc_id, page, box_id, CASE WHEN EXISTS (SELECT 1 FROM bd WHERE bd.doc_id = reg.doc_id AND bd.page = reg.page AND bd.l = ((reg.x0 + reg.x1) / 2 < 300) AND reg.y0 >= bd.start - 2 AND reg.y0 <= bd.finish) THEN 'Float' ELSE region END AS region FROM reg"""


@query(ISLANDS)
def float_islands(spark, sf_dir):
    """W5."""
    return G.float_islands(_regions(spark, sf_dir)).select(*G.PAGE, "box_id", "region")


REGION_ROWS = "(0, 1, 'header', 0.0, 0.0, 1.0, 0.1, true, true), (0, 2, 'margin_overlay', 300.0, 80.0, 400.0, 200.0, false, true), (0, 3, 'unknown', 0.0, 0.0, 600.0, 120.0, false, false), (1, 1, 'sidebar', 0.4, 0.9, 0.1, 0.2, true, false)"
REGION_NAMES = "page, region_ord, role, x0, y0, x1, y1, fractional, top_origin"


@query(f"""WITH {V.BOX}, o AS (SELECT page, region_ord, CASE role WHEN 'header' THEN 'Header' WHEN 'margin_overlay' THEN 'MarginOverlay' WHEN 'sidebar' THEN 'Sidebar' ELSE 'Float' END AS role, x0::DOUBLE * w AS a, x1::DOUBLE * w AS b, CASE WHEN top_origin THEN y0::DOUBLE * h ELSE 800 - y0::DOUBLE * h END AS c, CASE WHEN top_origin THEN y1::DOUBLE * h ELSE 800 - y1::DOUBLE * h END AS d
 FROM (SELECT *, CASE WHEN fractional THEN 600.0::DOUBLE ELSE 1 END AS w, CASE WHEN fractional THEN 800.0::DOUBLE ELSE 1 END AS h FROM (VALUES {REGION_ROWS}) t({REGION_NAMES})))
SELECT bx.doc_id, bx.page, bx.box_id, arg_min(o.role, o.region_ord) AS role FROM boxes bx JOIN o ON o.page = bx.page AND (bx.x0 + bx.x1) / 2 BETWEEN least(a, b) AND greatest(a, b) AND (bx.y0 + bx.y1) / 2 BETWEEN least(c, d) AND greatest(c, d) GROUP BY ALL""")
def override_regions(spark, sf_dir):
    """J1, J2, P20, P21, T18."""
    regions = spark.sql(f"SELECT * FROM VALUES {REGION_ROWS} AS t({REGION_NAMES})")
    regions = regions.select("page", "region_ord", R.region_kind(F.col("role")).alias("role"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "fractional", "top_origin")
    return G.override_hits(V.boxes(spark, sf_dir), G.page_points(regions))


LEAN = r"""(regexp_matches(text, '^[.,;:)\]}?!%'']') OR text LIKE '-%' OR before LIKE '%-')"""
VISUAL = f"""v0 AS (SELECT *, lag(y0) OVER w AS y_before, lag(region) OVER w AS r_before FROM reg WHERE region <> 'Body' WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, box_id)),
v1 AS (SELECT *, sum(CASE WHEN y_before IS NULL OR abs(y0 - y_before) > 2.5 OR region <> r_before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, box_id) AS line FROM v0),
v2 AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, page, line ORDER BY y0, x0, box_id) AS before FROM v1),
visual AS (SELECT doc_id, page, CAST(line AS BIGINT) AS line, min(region) AS region, string_agg(CASE WHEN before IS NULL OR {LEAN} THEN text ELSE ' ' || text END, '' ORDER BY y0, x0, box_id) AS text FROM v2 GROUP BY ALL)"""


@query(f"WITH {REG}, {VISUAL} SELECT * FROM visual")
def visual_lines(spark, sf_dir):
    """A15, T11."""
    return G.visual_lines(_regions(spark, sf_dir))


#: Rows within 1.5 points go by x, then lines within 2.5 of their first box, box by box, as written.
LINEAR = f"""l0 AS (SELECT r.*, CASE WHEN family = 'frontiers' AND r.page >= 2 THEN 300.0::DOUBLE WHEN family IN ('magazine', 'acm', 'scan') THEN c.cut END AS cut_at FROM reg r LEFT JOIN cuts c ON c.doc_id = r.doc_id AND c.page = r.page WHERE region = 'Body'),
l1 AS (SELECT *, CASE WHEN cut_at IS NULL THEN 0 WHEN x1 - x0 > 360 THEN -1 WHEN (x0 + x1) / 2 >= cut_at THEN 1 ELSE 0 END AS col FROM l0),
ys AS (SELECT doc_id, page, col, y0 AS y, row_number() OVER (PARTITION BY doc_id, page, col ORDER BY y0) AS i FROM (SELECT DISTINCT doc_id, page, col, y0 FROM l1)),
ya AS (SELECT doc_id, page, col, i, y, y AS a FROM ys WHERE i = 1 UNION ALL SELECT ys.doc_id, ys.page, ys.col, ys.i, ys.y, CASE WHEN ys.y - ya.a > 1.5 THEN ys.y ELSE ya.a END FROM ya JOIN ys ON ys.doc_id = ya.doc_id AND ys.page = ya.page AND ys.col = ya.col AND ys.i = ya.i + 1),
l2 AS (SELECT l1.*, row_number() OVER (PARTITION BY l1.doc_id, l1.page, l1.col ORDER BY ya.a, l1.x0, l1.box_id) AS i FROM l1 JOIN ya ON ya.doc_id = l1.doc_id AND ya.page = l1.page AND ya.col = l1.col AND ya.y = l1.y0),
la AS (SELECT doc_id, page, col, i, y0 AS a, 1 AS n FROM l2 WHERE i = 1 UNION ALL SELECT l2.doc_id, l2.page, l2.col, l2.i, CASE WHEN abs(l2.y0 - la.a) > 2.5 THEN l2.y0 ELSE la.a END, la.n + CASE WHEN abs(l2.y0 - la.a) > 2.5 THEN 1 ELSE 0 END
 FROM la JOIN l2 ON l2.doc_id = la.doc_id AND l2.page = la.page AND l2.col = la.col AND l2.i = la.i + 1),
l3 AS (SELECT l2.*, la.n AS ln, lag(text) OVER (PARTITION BY l2.doc_id, l2.page, l2.col, la.n ORDER BY l2.i) AS before FROM l2 JOIN la ON la.doc_id = l2.doc_id AND la.page = l2.page AND la.col = l2.col AND la.i = l2.i),
l4 AS (SELECT doc_id, page, col, ln, string_agg(CASE WHEN before IS NULL OR {LEAN} THEN text ELSE ' ' || text END, '' ORDER BY i) AS text FROM l3 GROUP BY ALL),
linear AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, ln) - 1 AS line_no, text FROM l4)"""


def _linear(spark, sf_dir):
    return G.linearize(_regions(spark, sf_dir))


@query(f"WITH RECURSIVE {REG}, {HIST}, {CUTS}, {LINEAR} SELECT * FROM linear")
def linearize(spark, sf_dir):
    """W1, W2."""
    return _linear(spark, sf_dir)


FOLDS = LINEAR[LINEAR.index("ys AS") : LINEAR.index("l4 AS")].replace("> 1.5", "> 1.0")


@query(f"""WITH RECURSIVE {V.BOX}, l1 AS (SELECT *, CASE WHEN page % 2 = 0 AND (x0 + x1) / 2 >= 292.5::DOUBLE THEN 1 ELSE 0 END AS col FROM boxes),
{FOLDS} l4 AS (SELECT doc_id, page, col, ln, string_agg(CASE WHEN before IS NULL OR before LIKE '%-' THEN text ELSE ' ' || text END, '' ORDER BY i) AS text FROM l3 GROUP BY ALL)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, ln) - 1 AS line_no, text FROM l4""")
def merged_lines(spark, sf_dir):
    """W3."""
    b = V.boxes(spark, sf_dir)
    return G.merged_lines(b, b.filter("page % 2 = 0").select(*G.PAGE).distinct().withColumn("cut", F.lit(292.5)))


#: The stream of a page: its words as they come, in lines of 13.
FLOW = "flow AS (SELECT doc_id, page, floor(box_id / 13.0)::BIGINT AS line_no, string_agg(text, ' ' ORDER BY box_id) AS text, min(family) AS family FROM boxes GROUP BY ALL)"
D_V, D_T = V.d_low(V.d_collapse("text")), V.d_low("f.t")
KEPT = f"""vis AS MATERIALIZED (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS i, region = 'Float' AS fl, {D_V} AS v, CASE WHEN len({V.d_words(D_V)}) >= 4 THEN array_to_string(({V.d_words(D_V)})[1:4], ' ') END AS pre FROM visual WHERE {D_V} <> ''),
fd AS (SELECT doc_id, page, line_no, 0::BIGINT AS i, {V.d_collapse('text')} AS t, {V.d_collapse('text')} = '' AS gone FROM flow UNION ALL
 SELECT doc_id, page, line_no, i, CASE WHEN cuts_it THEN cut ELSE t END, coalesce((lng AND low = v) OR (lng AND pl = 0 AND strlen(low) >= 8 AND contains(v, low) AND (NOT fl OR NOT regexp_matches(t, '{S.SHORT_FIGURE}'))) OR (NOT inside AND starts_with(low, pre) AND NOT fl) OR (cuts_it AND cut = ''), false) FROM
 (SELECT *, inside AND NOT (fl AND regexp_matches(v, '{S.INLINE}') AND left(low, pl - 1) LIKE '%as shown in ') AS cuts_it FROM (SELECT f.doc_id, f.page, f.line_no, x.i, f.t, {D_T} AS low, x.v, x.fl, x.pre, strlen(x.v) >= 8 AS lng, position(x.v IN {D_T}) AS pl,
  strlen(x.v) >= 8 AND position(x.v IN {D_T}) > 0 AND {D_T} <> x.v AS inside, {V.d_collapse("left(f.t, position(x.v IN " + D_T + ") - 1) || substring(f.t, position(x.v IN " + D_T + ") + length(x.v))")} AS cut FROM fd f JOIN vis x ON x.doc_id = f.doc_id AND x.page = f.page AND x.i = f.i + 1 WHERE NOT f.gone)))"""


def _flow(boxes):
    rows = boxes.groupBy(*G.PAGE, F.floor(F.col("box_id") / 13).alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("box_id", "text"))).alias("b"), F.min("family").alias("family"))
    return rows.select(*G.PAGE, "line_no", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"), "family")


@query(f"WITH RECURSIVE {REG}, {VISUAL}, {FLOW}, {KEPT} SELECT doc_id, page, line_no, t AS text FROM fd QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY i DESC) = 1 AND NOT gone")
def quarantine(spark, sf_dir):
    """A page's stream without what stands outside its body."""
    b = V.boxes(spark, sf_dir)
    return S.quarantine(_flow(b), G.visual_lines(_classified(b))).select(*G.PAGE, "line_no", "text")


PAGES_SQL = f"{V.LINES}, pg AS (SELECT doc_id, line_no // 32 AS page, text FROM lines)"


def _pages(spark, sf_dir):
    return V.marked_lines(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 32).cast("long").alias("page"), "text")


@query(f"WITH {PAGES_SQL}, h AS (SELECT doc_id, page, bool_or({D_REFS}) AS has FROM pg GROUP BY ALL) SELECT doc_id, page, bool_or(has) OVER (PARTITION BY doc_id ORDER BY page) AS active FROM h")
def references_active(spark, sf_dir):
    """W6, P17."""
    return S.references_active(_pages(spark, sf_dir))


#: A document's pages: those of its words, one at least, and an empty one behind every third document.
EVERY_PAGE = "every AS (SELECT doc_id, unnest(range(n)) AS page, CASE doc_id % 5 WHEN 0 THEN 'acm' WHEN 1 THEN 'magazine' WHEN 2 THEN 'scan' WHEN 3 THEN 'frontiers' ELSE 'generic' END AS family FROM (SELECT doc_id, greatest(1, ceil(len(w) / 800.0))::BIGINT + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, {} AS w FROM documents)))".format(V.d_words("coalesce(text, '')"))


@query(f"""WITH {V.BOX}, {EVERY_PAGE}, s AS (SELECT doc_id, page, sum(strlen(text))::BIGINT AS bytes FROM boxes GROUP BY ALL), j AS (SELECT e.*, coalesce(s.bytes, 0) AS bytes FROM every e LEFT JOIN s ON s.doc_id = e.doc_id AND s.page = e.page WHERE NOT (family IN ('acm', 'magazine') AND e.page = 0))
SELECT doc_id, page, bytes, CASE WHEN bytes < 40 THEN 'direct' ELSE 'candidate' END AS kind FROM j WHERE bytes < 40 OR family = 'scan'""")
def ocr_requests(spark, sf_dir):
    """P23, W18."""
    n = F.greatest(F.lit(1), F.ceil(F.size(T.words(F.coalesce("text", F.lit("")))) / 800)).cast("int") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    pages = V.documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"), V.family().alias("family"))
    return S.ocr_requests(pages, V.boxes(spark, sf_dir))


#: Streams of a page: flow, its body's lines, and flow without running heads as raw.
D_STREAMS = f"""streams AS (SELECT doc_id, page, 'flow' AS stream, text FROM flow UNION ALL SELECT doc_id, page, 'geometry', text FROM linear UNION ALL SELECT doc_id, page, 'raw', text FROM flow WHERE NOT {_d_head('text')}),
sq AS (SELECT doc_id, page, stream, count(*) AS lines, sum(len({V.d_words('text')})) AS words, sum(len(list_filter({V.d_words('text')}, lambda x: {V.d_suspect('x')}))) AS bad FROM streams GROUP BY ALL),
ql AS (SELECT *, CASE WHEN words < 8 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - least(0.75::DOUBLE, 4.0::DOUBLE * bad / words) END AS quality FROM sq),
cand AS (SELECT p.doc_id, p.page, p.family, {', '.join(f"coalesce(max(q.{x}) FILTER (q.stream = '{s}'), 0) AS {s}_{x}" for s in ('flow', 'geometry', 'raw') for x in ('lines', 'quality'))} FROM (SELECT DISTINCT doc_id, page, family FROM boxes) p LEFT JOIN ql q ON q.doc_id = p.doc_id AND q.page = p.page GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {REG}, {HIST}, {CUTS}, {LINEAR}, {FLOW}, {D_STREAMS}
SELECT doc_id, page, CASE WHEN family IN ('acm', 'scan') THEN CASE WHEN raw_lines > 0 THEN 'raw' ELSE 'geometry' END WHEN family IN ('magazine', 'frontiers') THEN CASE WHEN (page = 1 OR (family = 'frontiers' AND page >= 2)) AND geometry_lines > 0 THEN 'geometry' WHEN flow_lines > 0 THEN 'flow' ELSE 'geometry' END
 WHEN flow_quality >= geometry_quality THEN 'flow' ELSE 'geometry' END AS stream FROM cand""")
def stream_select(spark, sf_dir):
    """Which stream a page's lines come from."""
    b = V.boxes(spark, sf_dir)
    streams = F.when(R.is_running_head(F.col("text")), F.array(F.lit("flow"))).otherwise(F.array(F.lit("flow"), F.lit("raw")))
    lines = _flow(b).select(*G.PAGE, F.explode(streams).alias("stream"), "text").unionByName(G.linearize(_classified(b)).select(*G.PAGE, F.lit("geometry").alias("stream"), "text"))
    found = L.quality(lines, (*G.PAGE, "stream"), counted=True).withColumn("family", V.family())
    return S.select_stream(found.withColumn("overridden", F.col("page") == 1))


@query("""WITH n AS (SELECT doc_id, doc_id % 3 AS page, (doc_id % 20) / 20.0::DOUBLE AS quality, doc_id % 7 = 0 AS direct FROM documents), o AS (SELECT doc_id, doc_id % 3 AS page, (doc_id * 3 % 20) / 20.0::DOUBLE AS ocr_quality FROM documents WHERE doc_id % 5 > 0 AND doc_id % 2 = 0)
SELECT n.doc_id, n.page, CASE WHEN coalesce(direct AND ocr_quality IS NOT NULL OR ocr_quality > quality + 0.04::DOUBLE, false) THEN 'ocr' ELSE 'native' END AS source, CASE WHEN coalesce(direct AND ocr_quality IS NOT NULL OR ocr_quality > quality + 0.04::DOUBLE, false) THEN ocr_quality ELSE quality END AS quality FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.page = o.page""")
def ocr_arbitrate(spark, sf_dir):
    """J5."""
    d = V.documents(spark, sf_dir)
    native = d.selectExpr("doc_id", "doc_id % 3 AS page", "(doc_id % 20) / 20.0D AS quality", "doc_id % 7 = 0 AS direct")
    ocr = d.filter("doc_id % 5 > 0").selectExpr("doc_id", "doc_id % 3 AS page", "(doc_id * 3 % 20) / 20.0D AS ocr_quality", "CAST(1 - doc_id % 2 AS INT) AS ocr_lines")
    return S.arbitrate(native, ocr)


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


from . import overleaf  # noqa: E402, F401  adds its queries to these
