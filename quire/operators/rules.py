"""Line classifiers: phrase tables, and the predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Phrases of running heads and feet.
CHROME_CONTAINS = ["communications of the acm", "front. polit", "permission to make digital", "total citations", "pdf download", "citation in bibtex", "open access support", "conference sponsors", "latest updates"]
CHROME_EXACT = ["chin and kirkpatrick", "10.3389/fpos.2023.1077945", "frontiersin.org", "open access", "steve adler"]
CHROME_UNDER = [("frontiers in", 90), ("doi 10.", 120), ("doi: 10.", 120), ("copyright 20", 80), ("doi.org/", 100)]
CHROME_CUT = ["communications of the acm", "frontiersin.org"]
# Phrases of publishers' boilerplate.
BOILERPLATE_EXACT = ["", "{", "}", "|", "•", "open access", "article"]
BOILERPLATE_STARTS = ["reviewed by", "correspondence", "specialty section", "received ", "accepted ", "citation", "copyright ©", "copyright (c)", "copyright 20"]
BOILERPLATE_CONTAINS = [
    "this article was submitted", "creative commons", "permission to make digital", "personal or classroom use is granted", "are not made or distributed for profit", "copies bear this notice",
    "full citation on the first page", "to copy otherwise", "republish, to post on servers", "redistribute to lists", "prior specific permission", "ht'02, june", "acm isbn", "copyright is held by",
    "dls in application", "frontiers in political science", "chin jj and kirkpatrick",
]
PUBLICATION_DATE = r"^published\s+\d{1,2}\s+[a-z]+\s+\d{4}\b"
# Phrases of forms that follow the references.
ANCILLARY_CONTAINS = [
    "subscription claims", "we provide this form", "print full name or key name", "please print clearly and in ink", "to be filled out by", "please do not remove", "photocopy may be used",
    "member or customer number", "apa subscription claims",
]
# Words that an author roster never holds; pairs that it is known by.
PROSE = [
    "classical", "language", "languages", "library", "digital", "university of", "hieroglyph", "sanskrit", "published", "developed", "including", "research", "focuses", "objects", "diagrams",
    "economically", "accurate", "http", "perseus", "funded", "agency", "agencies", "national science", "foundation", "endowment",
]
ROSTER_PAIRS = [("crane", "chavez"), ("milbank", "rydberg"), ("clifford", "wulfman")]
# Section names.
SECTIONS_EXACT = ["abstract", "references", "conclusion", "acknowledgments", "acknowledgements", "appendix"]
SECTIONS = ["challenges for the humanities", "case studies for general problems", "space and time", "managing the texts", "language tools (not just english)", "general principles", "conclusion"]
NUMBERED = r"^(\d{1,3}(?:\.\d+)*)[\.\)]?\s+\S"
# What tells a layout family by path and title, in order.
FAMILIES = [
    ("scan", ["ccp_addis2000", "treatment manuals"]), ("acm", ["acm_bernstein2002", "storyspace 1"]), ("magazine", ["acm_crane2001", "drudgery"]), ("frontiers", ["candidate_paper", "african coups"]),
]
# Names of page regions.
REGION_NAMES = {
    "header": "Header", "footer": "Footer", "sidebar": "Sidebar", "footnote": "Footnote", "float": "Float", "margin": "MarginOverlay", "marginoverlay": "MarginOverlay", "margin_overlay": "MarginOverlay",
    "metadata": "Metadata", "wrapper": "Wrapper", "authornote": "AuthorNote", "author_note": "AuthorNote",
}


def _low(x: Column) -> Column:
    return T.let(T.trim(x), T.ascii_lower)


def is_running_head(x: Column, strip_page_numbers: bool = True) -> Column:
    t = T.collapse(x)
    low = T.ascii_lower(t)
    found = (t == "") | T.contains_any(low, CHROME_CONTAINS) | low.isin(CHROME_EXACT) | (low.contains("vol.") & low.contains("no."))
    found |= low.contains("/vol.")
    for phrase, under in CHROME_UNDER:
        found |= low.contains(phrase) & (T.size(t) < under)
    if strip_page_numbers:
        found |= T.mostly_digits(t) & (T.size(t) <= 3)
    return found | ((T.size(t) == 1) & ~t.rlike("^[0-9aAiI]$"))


def without_chrome(x: Column) -> Column:
    """The line up to a running head that stands within it, without a single letter at its end other than a or i."""
    t = x
    for phrase in CHROME_CUT:
        at = F.locate(phrase, T.ascii_lower(t))
        t = F.when(at > 1, T.trim(F.substring(t, F.lit(1), at - 1))).otherwise(t)
    return F.when(t.rlike(r"\s[B-HJ-Zb-hj-z]$") & (T.size(t) >= 3), T.trim(F.regexp_replace(t, r"[A-Za-z]$", ""))).otherwise(t)


def is_chrome(cut: Column, strip_page_numbers: bool = True) -> Column:
    t = T.trim(cut)
    return is_running_head(cut, strip_page_numbers) | (T.mostly_digits(t) & (T.size(t) <= 3))


def is_boilerplate(x: Column) -> Column:

    def of(low: Column) -> Column:
        return low.isin(BOILERPLATE_EXACT) | low.rlike("^[a-z]$") | T.starts_any(low, BOILERPLATE_STARTS) | T.contains_any(low, BOILERPLATE_CONTAINS) | low.rlike(PUBLICATION_DATE)

    return T.let(_low(x), of)


def is_ancillary(x: Column) -> Column:

    def of(low: Column) -> Column:
        return (low != "") & (
            T.contains_any(low, ANCILLARY_CONTAINS)
            | (low.startswith("american psychological") & (T.size(low) < 80))
            | (low.contains("american psychological association") & low.contains("subscription"))
        )

    return T.let(_low(x), of)


def is_author_roster(x: Column) -> Column:

    def of(t: Column, low: Column) -> Column:
        pairs = F.lit(False)
        for a, b in ROSTER_PAIRS:
            pairs |= low.contains(a) & low.contains(b)
        capitals = F.regexp_count(t, F.lit("(?<![A-Za-z])[A-Z]"))
        listed = (F.regexp_count(t, F.lit(",")) >= 3) & low.contains(" and ") & (capitals >= 6) & t.rlike("^[A-Z]") & (T.size(t) < 200)
        return T.size(t).between(10, 280) & ~T.contains_any(low, PROSE) & (pairs | listed)

    return T.let(T.trim(x), lambda t: T.let(T.ascii_lower(t), lambda low: of(t, low)))


def heading_level(x: Column, keywords_as_h2: bool = True, nest_numbers: bool = True) -> Column:

    def of(t: Column, low: Column) -> Column:
        number = F.regexp_extract(t, NUMBERED, 1)
        known = low.isin([*SECTIONS, "references"]) | T.starts_any(low, [f"{s} " for s in [*SECTIONS, "references"]])
        alpha, capital = T.letters(t), T.letters(t, "A-Z")
        short = (T.size(t) < 80) & ~t.contains(".") & (alpha >= 4) & (capital >= F.floor(alpha / 2))
        level = F.when(low.isin(SECTIONS_EXACT) | low.startswith("appendix "), 1).when(low.isin("keywords", "key words"), 2 if keywords_as_h2 else 1)
        level = level.when(low.isin("general terms", "categories and subject descriptors"), 1)
        if nest_numbers:
            level = level.when(number != "", F.least(F.lit(6), F.regexp_count(number, F.lit(r"\.")) + 1))
        return level.when(known, 1).when(short, 1).otherwise(0)

    return T.let(T.trim(x), lambda t: T.let(T.ascii_lower(t), lambda low: of(t, low)))


def is_accepted_heading(x: Column) -> Column:
    """A heading by level that is short enough and numbered, of one word, under 90 bytes, or by name."""

    def of(t: Column) -> Column:
        return (T.size(t) < 120) & (t.rlike(NUMBERED) | ~t.contains(" ") | (T.size(t) < 90) | _low(t).isin("abstract", "keywords", "references", "conclusion")) & (heading_level(t) > 0)

    return T.let(T.trim(x), of)


def glued_heading(x: Column) -> Column:
    """(heading, rest): a section's name at the start of a line, and what follows."""
    low, name = T.ascii_lower(x), "|".join(s.replace("(", r"\(").replace(")", r"\)") for s in SECTIONS)
    found = F.regexp_extract(low, f"^({name})", 1)
    cut = (found != "") & ((low == found) | (T.size(x) > T.size(found) + 1))
    heading = F.when(cut, F.substring(x, F.lit(1), F.length(found))).otherwise("")
    rest = F.when(cut, T.trim(F.substring(x, F.length(found) + 1, F.length(x)))).otherwise(x)
    return F.struct(heading.alias("heading"), rest.alias("rest"))


def is_title_like(x: Column, title: Column) -> Column:

    def of(a: Column, b: Column) -> Column:
        mangled = b.contains("drudgery") & a.contains("rudgery") & a.contains("deep thought")
        return (b != "") & (a.contains(b) | mangled)

    return T.let(T.let(T.collapse(x), T.ascii_lower), lambda a: T.let(T.let(T.collapse(title), T.ascii_lower), lambda b: of(a, b)))


def without_title(x: Column, title: Column) -> Column:
    same = (title != "") & F.startswith(T.ascii_lower(x), T.ascii_lower(title))
    return T.trim(F.when(same, F.substring(x, F.length(title) + 1, F.length(x))).otherwise(F.regexp_replace(x, r"(?i)^\{?\s*d?\s*rudgery and deep thought\s*", "")))


def is_references_heading(x: Column) -> Column:

    def of(low: Column) -> Column:
        return low.isin("references", "bibliography", "works cited") | (low.startswith("references") & (T.size(low) <= 14))

    return T.let(_low(x), of)


def layout_family(path: Column, title: Column) -> Column:
    key = T.ascii_lower(F.concat_ws(" ", path, title))
    out = F.lit("generic")
    for name, phrases in reversed(FAMILIES):
        out = F.when(T.contains_any(key, phrases), name).otherwise(out)
    return out


def is_wrapper(family: Column, page: Column) -> Column:
    """Pages that only wrap a document: the first of conference and magazine papers."""
    return family.isin("acm", "magazine") & (page == 0)


def region_kind(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REGION_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, T.ascii_lower(name)), F.lit("Float"))
