"""Scalar functions against hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout as G
from quire.operators import rules as R

CASES = [
    (T.collapse, "  a \t b\n", "a b"),
    (T.normalize_typography, "“Hi”—it’s", '"Hi" - it\'s'),
    (T.normalize_typography, "''x''", '"x"'),
    (lambda c: T.joined(T.words(c), "|"), "It's 3.5% über-x", "It's|3|5|über-x"),
    (T.detach_footnote, "precedent1. See a2b fact3, end9", "precedent 1. See a2b fact 3, end 9"),
    (T.extract_doi, "see doi 10.1145/1234.5678. End", "10.1145/1234.5678"),
    (lambda c: T.joined(T.authors(c), "|"), "Ann Lee and Bo Chu; Cy Dee", "Ann Lee|Bo Chu|Cy Dee"),
    (T.ends_sentence, 'He said "stop."', True),
    (T.ends_sentence, "e.g. (see)", False),
    (R.without_chrome, "Appendix B", "Appendix"),
    (R.without_chrome, "Vitamin A", "Vitamin A"),
    (R.heading_level, "1.2 Methods", 2),
    (R.heading_level, "12 apples", 1),
    (R.heading_level, "Keywords", 2),
    (R.heading_level, "THE END", 1),
    (R.heading_level, "The End", 0),
    (T.yaml_escape, "A: b", '"A: b"'),
    (T.yaml_escape, "", '""'),
    (T.yaml_escape, "plain", "plain"),
    (T.yaml_escape, "-x", "-x"),
    (lambda c: T.stem(c), "/a/b.c/paper.v2.pdf", "paper.v2"),
    (R.region_kind, "Margin", "MarginOverlay"),
    (R.region_kind, "nothing", "Float"),
    (lambda c: R.layout_family(c, F.lit("Storyspace 1")), "/x.pdf", "acm"),
    (lambda c: G.attached(F.split(c, " ")), "well - known , yes ( no )", "well-known, yes ( no)"),
    (lambda c: T.pad_table(F.array(F.array(c, F.lit("b")), F.array(F.lit("ccccc")))), "a", "| a     | b |\n| ----- | --- |\n| ccccc |   |\n"),
    (lambda c: R.without_title(c, F.lit("My Paper")), "my paper and more", "and more"),
    (T.is_caption_word, " Fig. 2b: x", True),
    (T.is_caption_word, "figures 2", False),
    (lambda c: T.appended(c, F.lit("ple")), "exam-", "example"),
    (lambda c: T.today().rlike(r"^\d{4}-\d\d-\d\d$"), "", True),
    (lambda c: R.is_title_like(c, F.lit("My Paper")), "On MY  paper", True),
]


@pytest.fixture(scope="module")
def results(spark):
    one = spark.range(1)
    return one.select(*[f(F.lit(x)).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES)]).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(results, i):
    assert results[i] == CASES[i][2]
