"""First headings of a Markdown text."""

from __future__ import annotations

from .text import LINE_BREAK, cut, extract, strip


def first_heading(markdown: str) -> str:
    """First level 1-3 heading, else the first non-blank line."""
    line = strip(f"{cut(strip(markdown), LINE_BREAK)}[0]")
    return f"coalesce({strip(extract(markdown, HEADING_3, 1))}, {line})"


def name_heading(markdown: str) -> str:
    """First level 1-2 heading, else null."""
    return strip(extract(markdown, HEADING_2, 1))


HEADING_3 = r"(?md)^#{1,3}\s+(.+)$"
HEADING_2 = r"(?md)^#{1,2}\s+(.+)$"
