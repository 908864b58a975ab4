"""Text functions over Columns. Lengths are of UTF-8 bytes and letter classes are ASCII, as in a byte-oriented engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of typography and what stands for them, in the order of replacement.
TYPOGRAPHY = [
    (" ", " "), ("‘", "'"), ("’", "'"), ("′", "'"), ("“", '"'), ("”", '"'), ("–", " - "), ("—", " - "), ("…", "..."), ("''", '"'), ("``", '"'),
]
#: One class, for a group that repeats would call itself for every character.
WORD = r"[0-9A-Za-z'\-\x{80}-\x{10FFFF}]+"
#: What \s stands for.
BLANKS = " \t\n\x0b\f\r"
DOI = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
#: Bytes of the characters that mark a badly decoded word.
SUSPECT_BYTES = "EF|BF|BD|EE|80|BC"
YAML_SPECIAL = r"""[:"'#{}\[\],&*?|>!%@`\\]"""


def size(x: Column) -> Column:
    return F.octet_length(x)


def is_ascii(x: Column) -> Column:
    return F.octet_length(x) == F.char_length(x)


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def let(x: Column, f) -> Column:
    """f of x, which is computed once however often f names it; without it the expressions of a rule grow with each use of their text,
    beyond what can be compiled."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def collapse(x: Column) -> Column:
    """Few texts have runs of blanks, so that the expression is met by them alone."""
    return let(x, lambda v: F.when(contains_any(v, ["  ", *BLANKS[1:]]), trim(F.regexp_replace(v, r"\s+", " "))).otherwise(F.btrim(v)))


def normalize_typography(x: Column) -> Column:
    """ASCII texts hold none but the last pairs."""
    put = lambda v, pairs: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, v)
    return let(x, lambda v: F.when(is_ascii(v), put(v, [p for p in TYPOGRAPHY if p[0].isascii()])).otherwise(put(v, TYPOGRAPHY)))


def ascii_lower(x: Column) -> Column:
    """Translation costs microseconds a text, so it is kept for texts with other letters."""
    return F.when(is_ascii(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), 0)


def joined(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def appended(a: Column, b: Column) -> Column:
    """Two parts of a paragraph: a hyphen at the first one's end goes, else a blank comes between."""
    return F.when(b == "", a).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), b)).when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))


def looks_like_doi(x: Column) -> Column:
    t = ascii_lower(trim(x))
    return t.startswith("10.") | t.contains("doi:") | t.contains("doi.org/")


def extract_doi(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(x, DOI, 1), "[.,]+$", "")


def detach_footnote(x: Column) -> Column:
    """A digit glued to the end of a word stands apart: precedent1. -> precedent 1."""
    return F.regexp_replace(x, r"([A-Za-z])([1-9])(?=[\s.,;:)]|$)", "$1 $2")


def fix_split_word(x: Column) -> Column:
    split = lambda t: F.regexp_replace(t, r"(?i)\bprofes-\s*sional\b|\bprofes\s+sional\b", "professional")
    return let(collapse(x), lambda t: F.when(F.lower(t).contains("profes"), split(t)).otherwise(t))


def authors(x: Column) -> Column:
    parts = F.flatten(F.transform(F.split(x, "[;,]"), lambda p: F.split(trim(p), " and ")))
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def contains_any(x: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(n) for n in needles], F.lit(False))


def equals_any(x: Column, values: list[str]) -> Column:
    return x.isin(values)


def starts_any(x: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [x.startswith(p) for p in prefixes], F.lit(False))


def split_entries(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ";"), trim), lambda p: p != "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def yaml_escape(x: Column) -> Column:
    quoted = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    special = (x == "") | x.rlike(YAML_SPECIAL) | x.startswith(" ") | x.endswith(" ") | x.contains("\n")
    return F.when(special, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(x)


def heading_prefix(level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(level, F.lit(6)))), F.lit(" "))


def pad_table(rows: Column) -> Column:
    """An array of rows of cells as a pipe table; widths in bytes, the rule's three at least; short rows get empty cells."""
    columns = F.array_max(F.transform(rows, F.size))
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    numbers = F.sequence(F.lit(0), columns - 1)
    widths = F.transform(numbers, lambda i: F.array_max(F.transform(rows, lambda r: size(cell(r, i)))))
    line = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(numbers, lambda i: F.concat(F.lit(" "), cell(r, i), F.repeat(F.lit(" "), F.get(widths, i) - size(cell(r, i))), F.lit(" |"))), ""), F.lit("\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda w: F.concat(F.lit(" "), F.repeat(F.lit("-"), F.greatest(F.lit(3), w)), F.lit(" |"))), ""), F.lit("\n"))
    head = line(F.get(rows, F.lit(0)))
    return F.when(F.size(rows) > 0, F.concat(head, rule, F.array_join(F.transform(F.slice(rows, F.lit(2), F.size(rows)), line), ""))).otherwise("")


def is_digits(x: Column) -> Column:
    return trim(x).rlike("^[0-9]+$")


def mostly_digits(x: Column) -> Column:
    return x.rlike(r"^[0-9\s/-]*[0-9][0-9\s/-]*$")


def ends_sentence(x: Column) -> Column:
    return trim(x).rlike(r"""[.!?]["')\]*]*$""")


def is_caption(x: Column) -> Column:
    return ascii_lower(trim(x)).rlike(r"^(figure |fig\. |table )")


def is_caption_word(x: Column) -> Column:
    """A caption's first words: figure, fig. or table, a number, and what ends it."""
    return x.rlike(r"(?i)^\s*(figure|fig\.|table)\s+\d+[a-z]?(?:[.:]|\s)")


def today() -> Column:
    """The date in UTC, as text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")


def is_footnote(x: Column) -> Column:
    t = trim(x)
    return t.rlike(r"^(\[\d+\]|\d+)\s+\S") & (size(t) >= 2) & (size(t) < 300)


def has_suspect_byte(word: Column) -> Column:
    """Whether one of SUSPECT_BYTES stands in the word's UTF-8: in two steps, for few words have a byte above 127."""
    return word.rlike(r"[^\x00-\x7F]") & F.hex(F.encode(word, "UTF-8")).rlike(f"^(..)*?({SUSPECT_BYTES})")


def is_suspect(word: Column) -> Column:
    return (size(word) > 24) | has_suspect_byte(word)


def letters(x: Column, which: str = "A-Za-z") -> Column:
    return F.regexp_count(x, F.lit(f"[{which}]"))
