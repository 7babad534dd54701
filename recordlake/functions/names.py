"""Is this text the name of an organisation?"""

from __future__ import annotations

from ..constants import (
    ERROR_TITLE,
    GENERIC_TITLES,
    NON_LATIN,
    PICTOGRAM,
    PROSE_MARKERS,
    SLOGAN_OPENER,
    SLOGAN_TAIL,
    TRAILING_SEPARATOR,
)
from .text import WHITE, alternation, bind, cut, one_of, q, replace, strip, strip_end
from .urls import host_name, host_of


def is_error_title(title: str) -> str:
    """Titles of challenge, denial and error pages."""
    return f"coalesce({title} RLIKE {q(ERROR_TITLE)}, false)"


def is_org_name(name: str) -> str:
    """False for taglines, headlines and slogans; null input is false."""

    def gate(s: str) -> str:
        words = f"size({cut(s, WHITE + '+')})"
        return (
            f"NOT ({s} = '' OR length({s}) > 60 OR {s} RLIKE {q(PICTOGRAM)} OR endswith({s}, '!') OR contains({s}, '?') "
            f"OR {s} RLIKE {q(NON_LATIN)} OR {words} > 6 OR ({s} RLIKE {q(SLOGAN_OPENER)} AND {words} > 2) "
            f"OR {s} RLIKE {q(SLOGAN_TAIL)} "
            f"OR concat(' ', lower({s}), ' ') RLIKE {q(alternation(PROSE_MARKERS))})"
        )

    return f"coalesce({bind(strip(name), gate)}, false)"


def trim_separator(text: str) -> str:
    return strip(replace(strip(text), TRAILING_SEPARATOR))


def best_name(title: str, heading: str, url: str) -> str:
    """A usable title, else a usable first heading, else the host's first label."""

    def usable(text: str) -> str:
        return bind(
            trim_separator(text),
            lambda c: f"CASE WHEN {c} <> '' AND NOT {one_of(strip_end(f'lower({c})', '!'), GENERIC_TITLES)} "
            f"AND {is_org_name(c)} THEN {c} END",
        )

    return f"coalesce({usable(title)}, {usable(heading)}, {host_name(host_of(url))})"
