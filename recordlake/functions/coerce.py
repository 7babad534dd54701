"""Typed coercion of raw cell text.

Every function maps unusable input to null and never raises.  ``kind`` is absent
for text cells; cells that came from JSON carry the JSON type (``bool``,
``int``, ``float``, ``list`` or ``text``) because numbers and lists are treated
differently from text there.
"""

from __future__ import annotations

from ..constants import FALSE_WORDS, NUMBER_IN_TEXT, TRUE_WORDS, URL_IN_TEXT, YEAR_IN_TEXT
from ..spec import FieldSpec
from .contacts import first_email, is_placeholder_email
from .text import bind, blank_to_null, collapse, extract, match, one_of, q, replace, strip, strip_end
from .urls import promote_bare_domain, unwrap_redirect


def present(text: str) -> str:
    """Blank text counts as missing."""
    return blank_to_null(strip(text))


def to_email(text: str) -> str:
    return bind(f"lower({first_email(text)})", lambda e: f"CASE WHEN NOT {is_placeholder_email(e)} THEN {e} END")


def to_url(text: str, page_link: str | None = None) -> str:
    """A url in the text, else the page link that goes with it, else a bare domain."""

    def pick(t: str) -> str:
        literal = unwrap_redirect(strip_end(extract(t, URL_IN_TEXT), ".,;"))
        return f"coalesce({literal}, {page_link or 'NULL'}, {promote_bare_domain(t)})"

    return bind(present(text), pick)


def to_number(text: str, kind: str | None = None) -> str:
    parsed = f"try_cast(replace({extract(text, NUMBER_IN_TEXT)}, ',', '') AS DOUBLE)"
    if kind is None:
        return parsed
    return (
        f"CASE WHEN {kind} = 'bool' THEN CASE WHEN lower({text}) = 'true' THEN 1D ELSE 0D END "
        f"WHEN {kind} IN ('int', 'float') THEN try_cast({text} AS DOUBLE) ELSE {parsed} END"
    )


def to_integer(text: str, kind: str | None = None) -> str:
    # Text rounds half to even; a JSON fraction is cut off.
    rounded = f"try_cast(bround({to_number(text)}, 0) AS BIGINT)"
    if kind is None:
        return rounded
    return (
        f"CASE WHEN {kind} = 'bool' THEN CASE WHEN lower({text}) = 'true' THEN 1L ELSE 0L END "
        f"WHEN {kind} = 'int' THEN try_cast({text} AS BIGINT) "
        f"WHEN {kind} = 'float' THEN try_cast(try_cast({text} AS DOUBLE) AS BIGINT) ELSE {rounded} END"
    )


def to_boolean(text: str) -> str:
    return bind(
        f"lower({strip(text)})",
        lambda t: f"CASE WHEN {one_of(t, TRUE_WORDS)} THEN true WHEN {one_of(t, FALSE_WORDS)} THEN false END",
    )


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_FULL_MONTHS = "january february march april may june july august september october november december"
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_YEAR = r"([0-9]{4})"
# Accepted date shapes in the order they are tried: year, month, day, or b for
# the name of a month, in the order of their groups.
_DATE_SHAPES = (
    (rf"^{_YEAR}-{_MONTH}-{_DAY}$", "ymd"),
    (rf"(?i)^{_DAY}\s+({'|'.join(_MONTHS.split())})\s+{_YEAR}$", "dby"),
    (rf"(?i)^({'|'.join(_FULL_MONTHS.split())}|{'|'.join(_MONTHS.split())})\s+{_DAY},\s+{_YEAR}$", "bdy"),
    (rf"^{_DAY}/{_MONTH}/{_YEAR}$", "dmy"),
    (rf"^{_MONTH}/{_DAY}/{_YEAR}$", "mdy"),
    (rf"^{_YEAR}$", "y"),
    (rf"^{_DAY}-{_MONTH}-{_YEAR}$", "dmy"),
)


def to_date(text: str) -> str:
    """ISO date for a known shape, else the first year in the text."""

    def parse(t: str) -> str:
        tries = []
        for pattern, order in _DATE_SHAPES:
            part = {p: match(t, pattern, i + 1) for i, p in enumerate(order)}
            month = part.get("m", "'1'")
            if "b" in part:
                month = f"cast((instr({q(_MONTHS)}, lower(left({part['b']}, 3))) - 1) DIV 4 + 1 AS STRING)"
            iso = f"concat_ws('-', {part['y']}, lpad({month}, 2, '0'), lpad({part.get('d', chr(39) + '1' + chr(39))}, 2, '0'))"
            tries.append(f"CASE WHEN {t} RLIKE {q(pattern)} THEN date_format(try_cast({iso} AS DATE), 'yyyy-MM-dd') END")
        return f"coalesce({', '.join(tries)}, {extract(t, YEAR_IN_TEXT, 1)})"

    return bind(strip(text), parse)


def to_array(text: str, kind: str | None = None, items: str | None = None) -> str:
    def parse(t: str) -> str:
        # A second value behind the list would make the outer array longer.
        outer = f"try_variant_get(try_parse_json(concat('[', {t}, ',0]')), '$', 'array<variant>')"
        listed = bind(outer, lambda n: f"CASE WHEN size({n}) = 2 THEN try_variant_get({n}[0], '$', 'array<string>') END")
        parts = f"filter(transform(split(translate({t}, ';|', ',,'), ','), p -> {strip('p')}), p -> p <> '')"
        return (
            f"coalesce(CASE WHEN startswith({t}, '[') THEN transform({listed}, p -> {strip('p')}) END, "
            + bind(parts, lambda p: f"CASE WHEN size({p}) > 0 THEN {p} END")
            + ")"
        )

    parsed = bind(present(text), parse)
    if kind is None:
        return parsed
    kept = f"filter(transform({items}, p -> {strip('p')}), p -> p <> '')"
    return f"CASE WHEN {kind} = 'list' THEN {kept} ELSE {parsed} END"


def to_text(text: str) -> str:
    return blank_to_null(collapse(replace(strip(text), r"\[([^\]]*)\]\([^)]*\)", "$1")))


def coerce(
    field: FieldSpec,
    text: str,
    *,
    page_link: str | None = None,
    kind: str | None = None,
    items: str | None = None,
) -> str:
    """Value of ``field`` in its Spark type, null when the text cannot give one."""
    if field.type == "email":
        return to_email(text)
    if field.type == "url":
        return to_url(text, page_link)
    if field.type == "number":
        return to_number(text, kind)
    if field.type == "integer":
        return to_integer(text, kind)
    if field.type == "boolean":
        return to_boolean(text)
    if field.type == "date":
        return to_date(text)
    if field.type == "array":
        return to_array(text, kind, items)
    return to_text(text)
