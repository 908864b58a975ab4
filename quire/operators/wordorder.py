"""Whether two Markdown files hold the same words in the same order."""

from __future__ import annotations

import re


def words_in_order(markdown: str) -> list[str]:
    """The words of a Markdown text: no head, lower case, straight quotes, words broken at a hyphen joined."""
    body = re.sub(r"\A---\n.*?\n---\n", "", markdown, flags=re.DOTALL)
    body = body.lower().translate(str.maketrans("‘’“”", "''\"\""))
    return re.findall(r"[a-z0-9']+", re.sub(r"(\w)-\s+(\w)", r"\1\2", body))


def compared(got: str, want: str) -> tuple[int | None, float]:
    """(place of the first word that differs, None if none does; percent of the wanted words before it)."""
    a, b = words_in_order(got), words_in_order(want)
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return (None if len(a) == len(b) == at else at), 100.0 * at / len(b) if b else 100.0
