"""Queries of what passes from page to page, and the same in SQL; the catalogue imports this module."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import convert as E
from quire.operators import layout as G
from quire.operators import lines as L
from quire.operators import overleaf as O
from quire.operators import rules as R

from . import views as V
from . import catalog as C
from .catalog import CUT_SQL, D_ACCEPT, D_REFS, MEDIANS, PLAIN, REGIONS, SEEDS, STARTS, _classified, query

#: Page by page, as written: a page's first row goes if the page before, which has rows left, ends openly.
STEPS = """pg AS (SELECT doc_id, page, count(*) AS n, min(pos) AS a, max(pos) AS z, arg_min(text, pos) AS head, arg_min(starts, pos) AS starts, arg_max(ends, pos) AS ends FROM units GROUP BY doc_id, page),
 pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM pg),
 st AS (SELECT doc_id, i, page, n, ends, false AS gives FROM pn WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, p.page, p.n, p.ends, coalesce(p.page = s.page + 1 AND s.ends AND p.starts AND NOT (s.n = 1 AND s.gives), false) FROM st s JOIN pn p ON p.doc_id = s.doc_id AND p.i = s.i + 1),
 met AS (SELECT u.*, CASE WHEN u.pos = p.z AND nx.gives THEN np.head END AS taken FROM units u JOIN pn p ON p.doc_id = u.doc_id AND p.page = u.page JOIN st s ON s.doc_id = p.doc_id AND s.i = p.i
  LEFT JOIN st nx ON nx.doc_id = p.doc_id AND nx.i = p.i + 1 LEFT JOIN pn np ON np.doc_id = p.doc_id AND np.i = p.i + 1 WHERE NOT (s.gives AND u.pos = p.a))"""


def steps(n: int) -> str:
    """STEPS under names of their own."""
    return re.sub(r"\b(pg|pn|st|met|units)\b", rf"\g<1>{n}", STEPS)


@query(f"""WITH RECURSIVE {PLAIN}, units AS (SELECT doc_id, line_no // 16 AS page, line_no AS pos, text, true AS starts, text LIKE '%-' AS ends FROM plain), {STEPS}
SELECT doc_id, page, pos AS line_no, CASE WHEN taken IS NULL THEN text ELSE regexp_replace(text, '-$', '') || taken END AS text FROM met""")
def page_stitch(spark, sf_dir):
    """Lines that go on overleaf."""
    rows = V.marked(spark, sf_dir).select("doc_id", F.floor(F.col("line_no") / 16).cast("long").alias("page"), F.col("line_no").cast("long").alias("line_no"), T.collapse(F.col("raw")).alias("text"))
    return O.stitch_lines(rows.filter("text <> ''"))


@query(f"""WITH RECURSIVE {V.LINES}, kinds AS (SELECT doc_id, line_no // 16 AS page, line_no AS pos, text, CASE WHEN {D_ACCEPT} THEN 'Heading' ELSE 'Paragraph' END AS kind FROM lines),
 units AS (SELECT *, kind = 'Paragraph' AS starts, kind = 'Paragraph' AND NOT regexp_matches({V.d_trim('text')}, '[.!?]["'')\\]*]*$') AS ends FROM kinds), {STEPS}
SELECT doc_id, page, pos AS block_no, kind, CASE WHEN taken IS NULL THEN text ELSE {V.d_appended('text', 'taken')} END AS text FROM met""")
def page_paragraphs(spark, sf_dir):
    """Paragraphs that go on overleaf."""
    number = F.col("line_no").cast("long")
    kind = F.when(R.is_accepted_heading(F.col("text")), "Heading").otherwise("Paragraph")
    rows = V.marked_lines(spark, sf_dir).select("doc_id", F.floor(number / 16).cast("long").alias("page"), number.alias("block_no"), kind.alias("kind"), "text")
    return O.merge_paragraphs(rows)


DIAGRAM_KIND = "CASE WHEN (doc_id + line_no) % 7 = 0 THEN 'Caption' ELSE 'Paragraph' END"
DIAGRAM_TEXT = "CASE WHEN (doc_id + line_no) % 11 = 3 THEN text || ' Biotechnography x' WHEN (doc_id + line_no) % 11 = 5 THEN 'bi ot echnogram' ELSE text END"


@query(f"""WITH {V.LINES}, b AS (SELECT doc_id, line_no AS block_no, {DIAGRAM_KIND} AS kind, {DIAGRAM_TEXT} AS text FROM lines),
m AS (SELECT *, CASE WHEN kind <> 'Paragraph' THEN 0 WHEN contains({V.d_low('text')}, 'biotechnography') THEN position('biotechnography' IN {V.d_low('text')}) ELSE position('bi ot echnogr' IN {V.d_low('text')}) END AS place FROM b),
e AS (SELECT *, coalesce(last_value(CASE WHEN place > 0 THEN true WHEN kind = 'Caption' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM m),
c AS (SELECT *, CASE WHEN place > 0 THEN {V.d_trim('left(text, place - 1)')} ELSE text END AS kept FROM e)
SELECT doc_id, block_no, kind, kept AS text FROM c WHERE CASE WHEN place > 0 THEN kept <> '' ELSE NOT inside OR kind = 'Caption' END""")
def diagram_filter(spark, sf_dir):
    """Diagrams of the conference family."""
    rows = V.marked_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("block_no"), F.expr(DIAGRAM_KIND).alias("kind"), F.expr(DIAGRAM_TEXT).alias("text"))
    return O.without_diagrams(rows)


@query(f"""WITH {CUT_SQL}, e AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS early FROM clean WHERE line_no // 32 < 2 GROUP BY doc_id)
SELECT doc_id, early, regexp_replace(regexp_extract(early, '(?i)(10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[.,]+$', '') AS doi FROM e""")
def early_doi(spark, sf_dir):
    """The first pages' text and its DOI."""
    rows = L.without_chrome(V.marked_lines(spark, sf_dir)).select("doc_id", F.floor(F.col("line_no") / 32).cast("long").alias("page"), "line_no", "text")
    return O.early_text(rows).withColumn("doi", T.extract_doi(F.col("early")))


#: The words laid out, with a heading, an abstract and a form among them.
FORMS = "CASE WHEN box_id = 16 AND doc_id % 2 = 0 THEN 'References' WHEN box_id = 24 AND doc_id % 3 = 0 THEN 'Abstract' WHEN box_id = 390 AND doc_id % 5 = 0 THEN 'appendix' WHEN box_id % 97 = 5 AND doc_id % 7 > 0 THEN 'print full name' ELSE text END"
FORM_BOX = f"{V.WORDS}, bare AS ({V.BOX[V.BOX.index("boxes AS (") + len("boxes AS ("):-1]}), boxes AS (SELECT * REPLACE ({FORMS} AS text) FROM bare)"


def _forms(spark, sf_dir, by=("doc_id", "page")):
    return V.boxes(spark, sf_dir, by).withColumn("text", F.expr(FORMS))


@query(f"""WITH {FORM_BOX}, f AS (SELECT doc_id, page, arg_min((y0 + y1) / 2, box_id) FILTER ({V.d_low('text')} = 'abstract') AS a, arg_min((y0 + y1) / 2, box_id) FILTER (contains({V.d_low('text')}, 'copyright') OR contains({V.d_low('text')}, 'permission')) AS c,
 arg_min((y0 + y1) / 2, box_id) FILTER ({V.d_low('text')} IN ('storyspace', 'storyspace 1')) AS t FROM boxes GROUP BY doc_id, page) SELECT doc_id, page, coalesce(a > c, t > c, true) AS top_is_high FROM f""")
def page_orientation(spark, sf_dir):
    """A10."""
    return O.orientation(_forms(spark, sf_dir))


LOW = V.d_low("text")
#: Body boxes of a page in order, each into the first row within three points, whose y becomes the mean, as written.
DROPS = f"""hd AS (SELECT doc_id, page, coalesce(bool_or({D_REFS}), false) AS has, min(row(box_id, y0)) FILTER ({D_REFS}) AS top FROM boxes GROUP BY doc_id, page),
ac AS (SELECT doc_id, page, bool_or(has) OVER (PARTITION BY doc_id ORDER BY page) AS active, coalesce(top[2] + 4, 0) AS fl FROM hd),
cb AS MATERIALIZED (SELECT r.doc_id, r.page, y0, (x0 + x1) / 2 < 292 AS l, (x0 + x1) / 2 > 308 AS r, row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY box_id) AS i FROM reg r JOIN ac ON ac.doc_id = r.doc_id AND ac.page = r.page WHERE active AND region = 'Body' AND y0 >= fl AND x1 - x0 >= 24 AND text <> ''),
bn AS (SELECT doc_id, page, i, [y0] AS ys, [l] AS ls, [r] AS rs FROM cb WHERE i = 1 UNION ALL SELECT doc_id, page, i, CASE WHEN p IS NULL THEN list_append(ys, y0) ELSE ys[:p - 1] || [(ys[p] + y0) * 0.5::DOUBLE] || ys[p + 1:] END, CASE WHEN p IS NULL THEN list_append(ls, l) ELSE ls[:p - 1] || [ls[p] OR l] || ls[p + 1:] END, CASE WHEN p IS NULL THEN list_append(rs, r) ELSE rs[:p - 1] || [rs[p] OR r] || rs[p + 1:] END
 FROM (SELECT c.*, b.ys, b.ls, b.rs, nullif(list_position(list_transform(b.ys, lambda y: abs(y - c.y0) <= 3), true), 0) AS p FROM bn b JOIN cb c ON c.doc_id = b.doc_id AND c.page = b.page AND c.i = b.i + 1)),
bd AS (SELECT doc_id, page, unnest(ys) AS y, unnest(ls) AS l, unnest(rs) AS r FROM (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) = 1)),
tw AS (SELECT doc_id, page, max(y) FILTER (l AND r) AS two FROM bd GROUP BY doc_id, page),
dr AS (SELECT bd.doc_id, bd.page, min(y) AS drop_y FROM bd JOIN tw USING (doc_id, page) JOIN med USING (doc_id, page) WHERE y > two + greatest(14, greatest(8, CASE WHEN median_height > 0 THEN median_height ELSE 12 END) * 1.6::DOUBLE) GROUP BY bd.doc_id, bd.page),
fo AS (SELECT b.doc_id, b.page, drop_y FROM boxes b JOIN dr USING (doc_id, page) WHERE y0 + 1 >= drop_y AND text <> '' GROUP BY b.doc_id, b.page, drop_y
 HAVING bool_or({V.d_any(LOW, O.FORM_WORDS)}) OR bool_or((starts_with({LOW}, 'american psychological') OR contains({LOW}, 'american psychological association')) AND strlen(text) < 80) OR (bool_or(x1 - x0 > 330) AND NOT bool_or(starts_with({LOW}, 'appendix') OR starts_with({LOW}, 'acknowledg'))))"""


@query(f"""WITH RECURSIVE {FORM_BOX}, {MEDIANS}, {STARTS}, {SEEDS}, {REGIONS}, {DROPS}
SELECT r.doc_id, r.page, r.box_id, CASE WHEN coalesce(r.y0 + 1 >= fo.drop_y, false) THEN 'Metadata' ELSE r.region END AS region FROM reg r LEFT JOIN fo ON fo.doc_id = r.doc_id AND fo.page = r.page""")
def post_references(spark, sf_dir):
    """A11, A12, P22."""
    return O.post_references(_classified(_forms(spark, sf_dir, ("doc_id",)))).select(*G.PAGE, "box_id", "region")


CELLS = [("coalesce(lang, '')", "coalesce(source, '')"), ("CAST(doc_id AS STRING)", "CAST(n_chars AS STRING)"), ("'only'", "''")]


def _d_row(a: str, b: str) -> str:
    return "'|'" + "".join(f" || ' ' || {x} || repeat(' ', w{i} - strlen({x})) || ' |'" for i, x in enumerate((a, b))) + " || chr(10)"


@query(f"""WITH w AS (SELECT *, {', '.join(f"greatest({', '.join(f'strlen({r[i]})' for r in CELLS)}) AS w{i}" for i in range(2))} FROM documents)
SELECT doc_id, {_d_row(*CELLS[0])} || '| ' || repeat('-', greatest(3, w0)) || ' | ' || repeat('-', greatest(3, w1)) || ' |' || chr(10) || {_d_row(*CELLS[1])} || {_d_row(*CELLS[2])} AS md FROM w""")
def pipe_tables(spark, sf_dir):
    """SNK4: tables of Markdown."""
    rows = F.array(F.array(*map(F.expr, CELLS[0])), F.array(*map(F.expr, CELLS[1])), F.array(F.expr(CELLS[2][0])))
    return V.documents(spark, sf_dir).select("doc_id", T.pad_table(rows).alias("md"))


RUN = """{n}a AS (SELECT *, coalesce(lag(text) OVER w LIKE '%-' AND regexp_matches(text, '^[a-z]'), false) AS can FROM {src} WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
{n}b AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS chain FROM {n}a),
{n}c AS (SELECT *, {joins} AS joins FROM {n}b), {n}d AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS run, lead(joins) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS goes_on FROM {n}c),
{n} AS (SELECT doc_id, page, min(line_no) AS line_no, string_agg(CASE WHEN goes_on THEN regexp_replace(text, '-$', '') ELSE text END, '' ORDER BY line_no) AS text FROM {n}d GROUP BY doc_id, page, run)"""
ENDS = f"regexp_matches({V.d_trim('text')}, '[.!?][\"'')\\]*]*$')"
LOWM = V.d_low("text")
D_SAID = f"(CASE WHEN contains({LOWM}, 'biotechnography') THEN position('biotechnography' IN {LOWM}) ELSE position('bi ot echnogr' IN {LOWM}) END)"
WHOLE = f"""{C.PAGED}, docs AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'acm' WHEN 1 THEN 'magazine' WHEN 2 THEN 'scan' WHEN 3 THEN 'frontiers' ELSE 'generic' END AS family, {V.TITLE} AS title, {V.d_authors("coalesce(source, '') || '; ' || coalesce(lang, '') || ' and Co'")} AS authors FROM documents),
kept AS (SELECT doc_id, page, line_no, text FROM paged WHERE NOT (family IN ('acm', 'magazine') AND page = 0)), {C.cut_sql('kept', 'doc_id, page, line_no')}, {RUN.format(n='rp', src='clean', joins='can AND row_number() OVER (PARTITION BY doc_id, page, chain ORDER BY line_no) % 2 = 0')},
units1 AS (SELECT doc_id, page, line_no AS pos, text, true AS starts, text LIKE '%-' AS ends FROM rp), {steps(1)}, over1 AS (SELECT doc_id, page, pos AS line_no, CASE WHEN taken IS NULL THEN text ELSE regexp_replace(text, '-$', '') || taken END AS text FROM met1),
{RUN.format(n='rq', src='over1', joins='can')}, body_lines AS (SELECT r.*, d.family, d.title FROM rq r JOIN docs d USING (doc_id)), {C.block_sql('body_lines')},
f1 AS (SELECT *, coalesce(kind = 'Paragraph' AND lag(kind) OVER w = 'Paragraph' AND NOT {ENDS.replace('(text', '(lag(text) OVER w').replace('regexp_replace(text', 'regexp_replace(lag(text) OVER w')}, false) AS follows FROM blocks WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_no)),
f2 AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY block_no) AS run, coalesce(lead(follows) OVER (PARTITION BY doc_id, page ORDER BY block_no), false) AS goes_on FROM f1),
units2 AS (SELECT doc_id, page, min(block_no) AS pos, arg_min(kind, block_no) AS kind, arg_min(level, block_no) AS level, string_agg(CASE WHEN NOT goes_on THEN text WHEN text LIKE '%-' THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY block_no) AS text FROM f2 GROUP BY doc_id, page, run),
units3 AS (SELECT *, kind = 'Paragraph' AS starts, kind = 'Paragraph' AND NOT {ENDS} AS ends FROM units2), {steps(3)}, over3 AS (SELECT doc_id, page, pos AS block_no, kind, level, CASE WHEN taken IS NULL THEN text ELSE {V.d_appended('text', 'taken')} END AS text FROM met3),
g1 AS (SELECT o.*, CASE WHEN kind = 'Paragraph' AND d.family = 'acm' THEN {D_SAID} ELSE 0 END AS place FROM over3 o JOIN docs d USING (doc_id)),
g2 AS (SELECT *, coalesce(last_value(CASE WHEN place > 0 THEN true WHEN kind = 'Caption' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM g1),
final AS (SELECT doc_id, page, block_no, kind, level, CASE WHEN place > 0 THEN {V.d_trim('left(text, place - 1)')} ELSE text END AS text FROM g2 WHERE CASE WHEN place > 0 THEN {V.d_trim('left(text, place - 1)')} <> '' ELSE NOT inside OR kind = 'Caption' END),
sc AS (SELECT *, {V.d_low(C.T_SQL)} AS lo, bool_or(starts_with({V.d_low(C.T_SQL)}, '{B.SCAN_BODY}')) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS begun FROM body_lines WHERE family = 'scan'),
sct AS (SELECT doc_id, arg_max(text, row(page, line_no)) FILTER (starts_with(lo, '{B.SCAN_TITLE}')) AS a, arg_min(text, row(page, line_no)) FILTER (lo = '{B.SCAN_SUBTITLE}') AS b FROM sc WHERE NOT begun GROUP BY doc_id),
names AS ({C.title_sql('final')}), titles AS (SELECT d.doc_id, coalesce(CASE WHEN sct.a IS NOT NULL THEN concat_ws(': ', sct.a, sct.b) END, nullif(d.title, ''), names.title, '') AS title FROM docs d LEFT JOIN sct ON sct.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id),
early AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, line_no) AS early FROM body_lines WHERE page < 2 GROUP BY doc_id), dois AS (SELECT doc_id, regexp_replace(regexp_extract(early, '(?i)(10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+)', 1), '[.,]+$', '') AS doi FROM early),
abstracts AS ({C.abstract_sql('final')}), words_of AS ({C.keywords_sql('final')}), {C.body_sql('final', 'titles')}, {C.COUNTS}, npages AS (SELECT doc_id, max(page) + 1 AS n FROM paged GROUP BY doc_id),
every AS (SELECT d.doc_id, titles.title, coalesce(dois.doi, '') AS doi, d.authors, coalesce(words_of.keywords, []) AS kw, coalesce(abstracts.abstract, '') AS ab, coalesce(body.markdown, '') AS body, coalesce(npages.n, 0) AS pages, {', '.join(f'coalesce(counted.{c}, 0) AS {c}' for c in ('headings', 'tables', 'figures', 'footnotes'))}
 FROM docs d LEFT JOIN titles ON titles.doc_id = d.doc_id LEFT JOIN dois ON dois.doc_id = d.doc_id LEFT JOIN words_of ON words_of.doc_id = d.doc_id LEFT JOIN abstracts ON abstracts.doc_id = d.doc_id LEFT JOIN body ON body.doc_id = d.doc_id LEFT JOIN counted ON counted.doc_id = d.doc_id LEFT JOIN npages ON npages.doc_id = d.doc_id)"""


@query(f"""WITH RECURSIVE {WHOLE} SELECT doc_id, title, doi, {C.head_sql('title', 'authors', 'doi', 'kw', 'ab', "'date-extracted: 2020-05-03' || chr(10)")} || body AS markdown, pages, headings, tables, figures, footnotes FROM every""")
def document_markdown(spark, sf_dir):
    """A document from its lines to Markdown and statistics: P4, W7, J6, W8 to W10, J7, W11 to W16, A13, A14, T8, T15, SNK1 to SNK7, SNK9."""
    authors = F.concat(F.coalesce("source", F.lit("")), F.lit("; "), F.coalesce("lang", F.lit("")), F.lit(" and Co"))
    documents = V.documents(spark, sf_dir).select("doc_id", V.family().alias("family"), F.expr(V.TITLE).alias("title"), authors.alias("authors"))
    return E.markdown(documents, V.paged(V.marked_lines(spark, sf_dir)), "2020-05-03")
