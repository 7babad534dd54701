"""Builders of Spark SQL text shared by every function module.

Functions in this package take and return SQL text; operators hand the result to
``F.expr``.  The expressions are large, and one parsed string costs the driver
far less than thousands of Column calls.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterable

# Unicode white space as Python understands it: what strip() and split() remove.
WHITE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

_fresh = itertools.count(1)


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    Catalyst does not share sub-expressions inside lambda functions, so a value
    that is needed twice is bound through a one-element array.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def bind(value: str, body: Callable[[str], str]) -> str:
    """``let`` with a generated name."""
    name = f"v{next(_fresh)}"
    return let(value, name, body(name))


def match_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def match(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group})"


def replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)})"


CUT_MARK = "\x10"


def cut(text: str, pattern: str) -> str:
    """Text between the matches of ``pattern``.

    ``split`` compiles its pattern for every row unless it is one plain
    character, so the matches are first replaced by a control character, which
    page text never holds.
    """
    return f"split({replace(text, pattern, CUT_MARK)}, {q(CUT_MARK)}, -1)"


def strip(text: str) -> str:
    return f"btrim({text}, {q(WHITE_CHARS)})"


def collapse(text: str) -> str:
    return strip(replace(text, WHITE + "+", " "))


def strip_end(text: str, chars: str) -> str:
    return f"trim(TRAILING {q(chars)} FROM {text})"


def blank_to_null(text: str) -> str:
    return f"nullif({text}, '')"


def extract(text: str, pattern: str, group: int = 0) -> str:
    """First match of ``pattern``, null when there is none or it is empty."""
    return blank_to_null(match(text, pattern, group))


def compact(text: str) -> str:
    """Lower case, letters and digits only: the form names are compared in."""
    return f"regexp_replace(lower({text}), '[^a-z0-9]', '')"


def compact_text(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def one_of(text: str, words: Iterable[str]) -> str:
    return f"{text} IN ({', '.join(q(w) for w in words)})"


def alternation(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def weave(between: str, tokens: str) -> str:
    """Text pieces and the tokens between them, back in order."""
    return (
        f"array_join(flatten(zip_with({between}, {tokens}, "
        "(s, t) -> array(coalesce(s, ''), coalesce(t, '')))), '')"
    )


def text_map(pairs: dict[str, str]) -> str:
    """A constant map, folded at plan time."""
    return f"from_json({q(json.dumps(pairs))}, 'map<string,string>')"


_END = "\x1fend"


def parse_json(text: str) -> str:
    """``try_parse_json`` that rejects anything behind the value.

    Spark's parser stops at the end of the first value.  Inside an array that
    ends with a marker, a second value or trailing text makes the whole invalid.
    """
    wrapped = f"try_variant_get(try_parse_json(concat('[', {text}, {q(',' + json.dumps(_END) + ']')})), '$', 'array<variant>')"
    return let(
        wrapped,
        "jsn",
        f"CASE WHEN size(jsn) = 2 AND try_variant_get(jsn[1], '$', 'string') = {q(_END)} THEN jsn[0] END",
    )
