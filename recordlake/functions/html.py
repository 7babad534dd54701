"""HTML to Markdown as Column expressions.

A page becomes text inside one task without a shuffle and without Python
workers.  All steps are linear in the page: tokens are cut with regular
expressions, every tag is mapped to its Markdown literal, and only the nesting
depth of dropped elements is walked in order.
"""

from __future__ import annotations

from html.entities import html5

from ..constants import BANNER_HINTS, SKIP_TAGS
from .text import CUT_MARK, collapse, cut, let, match, match_all, one_of, q, replace, strip, text_map, weave
from .urls import PARTS

# Control characters that mark structure while a page is being rendered.
_CELL_OPEN, _CELL_CLOSE = "\x01", "\x02"
_ROW_OPEN, _ROW_CLOSE = "\x03", "\x04"
_TABLE_OPEN, _TABLE_CLOSE = "\x05", "\x06"
_HREF_OPEN, _HREF_CLOSE = "\x0e", "\x0f"
_MARKS = f"[{_CELL_OPEN}-{_TABLE_CLOSE}{_HREF_OPEN}{_HREF_CLOSE}{CUT_MARK}]"

# Rest of a tag behind its name: quotes only count after an equals sign.
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""
_TAG = rf"</?[A-Za-z]{_ATTRIBUTES}>"
_TAG_NAME = rf"<(?=(/?[A-Za-z][^\s/>]*))/?[A-Za-z]{_ATTRIBUTES}>"  # the same tags, their names as a group
_OPAQUE = (
    r"(?is)<!--.*?-->"
    r"|<(?:(script|style)(?=[\s/>])[^>]*>.*?(?:</\1[^>]*>|\z)"
    r"|![^>]*>|\?[^>]*>)"
)
_SKIP_NAME = rf"(?:{'|'.join(SKIP_TAGS)})(?=[\s/>]){_ATTRIBUTES}"
_SKIP = rf"(?i)</?{_SKIP_NAME}>"
# What lies before the next skip tag, then a skip element that holds no other; each right behind the last one.
_TO_SKIP = rf"(?:[^<]++|(?!</?{_SKIP_NAME}>)<)*+"
_FLAT_SKIP = rf"(?i)\G({_TO_SKIP})<{_SKIP_NAME}(?<!/)>{_TO_SKIP}</{_SKIP_NAME}>"
_SKIP_OR_DIV = rf"(?i)</?(?:{'|'.join(SKIP_TAGS)}|div)(?=[\s/>]){_ATTRIBUTES}>"
_BANNER = rf"""(?i)^<div(?=[\s/>]).*?\s(?:class|id)\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)(?:{'|'.join(BANNER_HINTS)})"""
_BANNER_ANYWHERE = (
    rf"""(?i)<div(?=\s)[^>]*?\s(?:class|id)\s*=\s*(?:"[^">]*|'[^'>]*|[^\s"'>]*)(?:{'|'.join(BANNER_HINTS)})"""
)
_ANCHOR = (
    r"""(?is)<a(?=[\s/>])(?:[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?[^>]*>(.*?)</a\s*>"""
)
_NESTING = r"(?i)<(?:img|li|table)[\s/>]"  # tags whose text may depend on others or on its attributes
_TITLE = r"(?is)<title(?=[\s/>])[^>]*>(.*?)</title\s*>"

_BLOCK = 256  # skip tags walked per inner fold

_TAG_TEXT = {
    "p": "\n\n", "/p": "\n\n", "br": "\n",
    **{f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)},
    **{f"/h{n}": "\n\n" for n in range(1, 7)},
    "strong": "**", "/strong": "**", "b": "**", "/b": "**",
    "em": "*", "/em": "*", "i": "*", "/i": "*",
    "code": "`", "/code": "`", "pre": "\n\n```\n", "/pre": "\n\n",
    "ul": "\n", "/ul": "\n", "ol": "\n", "/ol": "\n",
    "a": "[", "/a": "]",
    "table": "\n\n" + _TABLE_OPEN, "/table": _TABLE_CLOSE,
    "tr": _ROW_OPEN, "/tr": _ROW_CLOSE,
    "td": _CELL_OPEN, "th": _CELL_OPEN, "/td": _CELL_CLOSE, "/th": _CELL_CLOSE,
}


# ------------------------------------------------------------------ entities
_ENTITY = r"&(?:#[0-9]{1,8};?|#[xX][0-9A-Fa-f]{1,7};?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def _windows_1252() -> dict[str, str]:
    """Numbers 128-159 mean Windows-1252 characters in HTML."""
    table = {}
    for n in range(0x80, 0xA0):
        try:
            table[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            table[str(n)] = chr(n)
    return table


def unescape(text: str) -> str:
    """Named (HTML 5) and numeric character references decoded."""
    named = {n.removesuffix(";"): c for n, c in html5.items() if n.endswith(";")}
    # Old names also count without the semicolon, the longest one that the text starts with.
    bare = {n: c for n, c in html5.items() if not n.endswith(";")}
    hexadecimal = "^&#[xX]([0-9A-Fa-f]+)"
    number = (
        f"CASE WHEN e RLIKE {q(hexadecimal)} THEN try_cast(conv({match('e', hexadecimal)}, 16, 10) AS BIGINT) "
        f"ELSE try_cast({match('e', '^&#([0-9]+)')} AS BIGINT) END"
    )
    character = (
        "CASE WHEN n IS NULL OR n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd' "
        f"WHEN n BETWEEN 128 AND 159 THEN element_at({text_map(_windows_1252())}, cast(n AS STRING)) "
        "ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"
    )
    prefix = "^&(" + "|".join(sorted(bare, key=len, reverse=True)) + ")"
    one = (
        "CASE WHEN e = '&amp;' THEN '&' WHEN e = '&nbsp;' THEN '\xa0' WHEN e = '&lt;' THEN '<' "
        f"WHEN e = '&gt;' THEN '>' WHEN e = '&quot;' THEN {q(chr(34))} "
        f"WHEN startswith(e, '&#') THEN {let(number, 'n', character)} "
        "ELSE coalesce("
        f"CASE WHEN endswith(e, ';') THEN try_element_at({text_map(named)}, {match('e', '^&([A-Za-z][A-Za-z0-9]*)')}) END, "
        + let(
            match("e", prefix),
            "p",
            f"CASE WHEN p <> '' THEN concat(try_element_at({text_map(bare)}, p), substr(e, length(p) + 2)) END",
        )
        + ", e) END"
    )
    woven = weave(cut("u", _ENTITY), f"transform({match_all('u', _ENTITY)}, e -> {one})")
    return let(text, "u", f"CASE WHEN contains(u, '&') THEN {woven} ELSE u END")


# --------------------------------------------------------------- boilerplate
def _kept_after(tags: str, banner_scope: str) -> str:
    """For each skip tag: is the text behind it outside every dropped element?

    The depth is walked in blocks so that appending flags stays cheap on pages
    with very many tags.
    """
    code = (
        "CASE WHEN g ILIKE '<div%' THEN "
        f"CASE WHEN g RLIKE {q(_BANNER)} THEN 3 ELSE 2 END "
        "WHEN g ILIKE '</div%' THEN -2 WHEN startswith(g, '</') THEN -1 WHEN endswith(g, '/>') THEN 0 ELSE 1 END"
    )
    depth = "CASE c WHEN 1 THEN s.d + 1 WHEN -1 THEN greatest(s.d - 1, 0) ELSE s.d END"
    banner = (
        "CASE WHEN c = 3 OR (c = 2 AND s.b > 0) THEN s.b + 1 WHEN c = -2 THEN greatest(s.b - 1, 0) ELSE s.b END"
    )
    if banner_scope == "rest":
        depth = "CASE WHEN c IN (1, 3) THEN s.d + 1 WHEN c = -1 THEN greatest(s.d - 1, 0) ELSE s.d END"
        banner = "0"
    step = let(
        f"named_struct('d', {depth}, 'b', {banner})",
        "z",
        "named_struct('d', z.d, 'b', z.b, 'k', concat(s.k, array(z.d = 0 AND z.b = 0)))",
    )
    inner = (
        f"aggregate(slice(codes, blk * {_BLOCK} + 1, {_BLOCK}), "
        f"named_struct('d', o.d, 'b', o.b, 'k', cast(array() AS ARRAY<BOOLEAN>)), (s, c) -> {step})"
    )
    outer = let(inner, "w", "named_struct('d', w.d, 'b', w.b, 'k', concat(o.k, array(w.k)))")
    walk = (
        f"flatten(aggregate(sequence(0, cast((size(codes) - 1) DIV {_BLOCK} AS INT)), "
        f"named_struct('d', 0, 'b', 0, 'k', cast(array() AS ARRAY<ARRAY<BOOLEAN>>)), (o, blk) -> {outer}).k)"
    )
    return let(f"transform({tags}, g -> {code})", "codes", walk)


def drop_boilerplate(html: str, banner_scope: str = "element") -> str:
    """Page without comments, scripts, navigation, forms and the like.

    Any skip tag raises the depth and any closing one lowers it (never below
    zero); text counts only at depth zero.  A banner ``div`` is dropped up to
    its own end (``banner_scope="element"``), or raises the depth for good
    (``"rest"``), which hides the remainder of the page.
    """

    def tokens(pattern: str) -> str:
        return f"named_struct('tags', {match_all('page', pattern)}, 'parts', {cut('page', pattern)})"

    chosen = (
        f"CASE WHEN page RLIKE {q(_BANNER_ANYWHERE)} THEN {tokens(_SKIP_OR_DIV)} ELSE {tokens(_SKIP)} END"
    )
    joined = let(
        _kept_after("tok.tags", banner_scope),
        "kept",
        "array_join(filter(tok.parts, (part, i) -> i = 0 OR get(kept, i - 1)), '')",
    )
    walked = let(chosen, "tok", f"CASE WHEN size(tok.tags) = 0 THEN page ELSE {joined} END")
    # Most pages have skip elements side by side alone: what is left without them needs no walk.
    flat = let(
        replace("page", _FLAT_SKIP, "$1"),
        "flat",
        f"CASE WHEN flat RLIKE {q(_SKIP)} OR page RLIKE {q(_BANNER_ANYWHERE)} THEN {walked} ELSE flat END",
    )
    return let(replace(replace(html, _MARKS), _OPAQUE), "page", flat)


# ---------------------------------------------------------------------- links
def _without_dots(path: str) -> str:
    # The empty first segment stands for the root and is never removed.
    walked = (
        "aggregate(slice(split(p, '/'), 2, size(split(p, '/'))), array(''), (acc, seg) -> "
        "CASE seg WHEN '.' THEN acc WHEN '..' THEN slice(acc, 1, greatest(size(acc) - 1, 1)) "
        "ELSE concat(acc, array(seg)) END)"
    )
    tail = f"CASE WHEN p RLIKE {q(r'/[.]{1,2}$')} THEN '/' ELSE '' END"
    joined = let(
        f"concat(array_join({walked}, '/'), {tail})", "j", "CASE WHEN j = '' THEN '/' ELSE j END"
    )
    return let(path, "p", f"CASE WHEN contains(p, '/.') THEN {joined} ELSE p END")


def _resolve(base: str, href: str) -> str:
    """Absolute form of a link found on the page ``base`` (RFC 3986)."""
    site = let(
        f"named_struct('scheme', lower({match(base, PARTS, 1)}), 'host', {match(base, PARTS, 2)}, "
        f"'path', coalesce(nullif({match(base, PARTS, 3)}, ''), '/'), 'query', {match(base, PARTS, 4)})",
        "b",
        "CASE WHEN startswith(r, '//') THEN concat(b.scheme, ':', r) "
        "WHEN startswith(r, '?') THEN concat(b.scheme, '://', b.host, b.path, r) "
        "WHEN startswith(r, '#') THEN concat(b.scheme, '://', b.host, b.path, "
        "CASE WHEN b.query = '' THEN '' ELSE concat('?', b.query) END, r) "
        "ELSE concat(b.scheme, '://', b.host, "
        + _without_dots(
            f"CASE WHEN startswith(r, '/') THEN {match('r', '^([^?#]*)')} "
            f"ELSE concat({match('b.path', '^(.*/)[^/]*$')}, {match('r', '^([^?#]*)')}) END"
        )
        + f", {match('r', '^[^?#]*(.*)$')}) END",
    )
    return let(
        f"translate({strip(href)}, '\t\n\r', '')",
        "r",
        f"CASE WHEN r = '' THEN {base} WHEN r RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN r ELSE {site} END",
    )


def _resolve_marked(text: str, base: str) -> str:
    pattern = f"{_HREF_OPEN}([^{_HREF_CLOSE}]*){_HREF_CLOSE}"
    hrefs = f"transform({match_all('m', pattern, 1)}, h -> concat('(', {_resolve(base, 'h')}, ')'))"
    return let(
        text, "m", f"CASE WHEN contains(m, {q(_HREF_OPEN)}) THEN {weave(cut('m', pattern), hrefs)} ELSE m END"
    )


# ----------------------------------------------------------------- rendering
def _scan(codes: str, start: dict[str, int], step: dict[str, str], out: str) -> str:
    """Walk ``codes`` in order with a state of integers: ``out`` after every code ``c``.

    ``step`` has each field's next value from ``s.<field>`` and ``c``; ``out`` reads the new
    state as ``z.<field>`` and the old one as ``s.<field>``.  Blocks keep the appending cheap.
    """
    fields = ", ".join(f"'{f}', {sql}" for f, sql in step.items())
    kept = ", ".join(f"'{f}', z.{f}" for f in step)
    walk = let(f"named_struct({fields})", "z", f"named_struct({kept}, 'k', concat(s.k, array(CAST({out} AS INT))))")
    begin = ", ".join(f"'{f}', o.{f}" for f in step)
    inner = f"aggregate(slice(codes, blk * {_BLOCK} + 1, {_BLOCK}), named_struct({begin}, 'k', CAST(array() AS ARRAY<INT>)), (s, c) -> {walk})"
    ended = ", ".join(f"'{f}', w.{f}" for f in step)
    outer = let(inner, "w", f"named_struct({ended}, 'k', concat(o.k, array(w.k)))")
    first = ", ".join(f"'{f}', {v}" for f, v in start.items())
    whole = (
        f"flatten(aggregate(sequence(0, CAST((greatest(size(codes), 1) - 1) DIV {_BLOCK} AS INT)), "
        f"named_struct({first}, 'k', CAST(array() AS ARRAY<ARRAY<INT>>)), (o, blk) -> {outer}).k)"
    )
    return let(codes, "codes", whole)


# What a tag does to lists and tables.  Rows, cells and tables are closed by what a parser holds open that has one
# of each: a cell that opens drops the one before, a table that opens drops the rows so far.
_LIST, _LIST_END, _CELL_TAG, _CELL_END, _ROW_TAG, _ROW_END, _TABLE_TAG, _TABLE_END, _ITEM = range(1, 10)
_NOT_OPEN, _INNER_ITEM, _LOST = 10, 11, 10  # numbers of lost opening and closing tags are theirs plus ten


def _list_depths(codes: str) -> str:
    """1 for an item inside a list, else 0."""
    depth = f"CASE c WHEN {_LIST} THEN s.d + 1 WHEN {_LIST_END} THEN greatest(s.d - 1, 0) ELSE s.d END"
    return _scan(codes, {"d": 0}, {"d": depth}, f"IF(c = {_ITEM} AND z.d > 0, 1, 0)")


def _states(start: dict[str, int]) -> list[dict[str, int]]:
    """All states of fields that are 0 or 1; the number of a state is its place."""
    return [{f: n >> i & 1 for i, f in enumerate(start)} for n in range(1 << len(start))]


_FIRST = 24  # the character of state 0 with output 0


def _walk(codes: str, n_codes: int, fields: str, move) -> str:
    """Walk ``codes`` (0 to ``n_codes`` - 1) in order: the output after every one of them.

    ``move(state, code)`` is the next state, with fields of 0 or 1 that start as 0, and the
    output.  All moves are looked up in one text, as a page has many tags: a character is an
    output and the state behind it.  Blocks keep the appending cheap.
    """
    states = _states(dict.fromkeys(fields, 0))
    table = ""
    for state in states:
        for code in range(n_codes):
            after, out = move(state, code)
            table += chr(_FIRST + out * len(states) + states.index(after))
    if max(map(ord, table)) > 126:
        raise ValueError("too many states and outputs for one character each")
    value = f"(ascii(substr(k, -1, 1)) - {_FIRST})"
    step = f"concat(k, substr({q(table)}, {value} % {len(states)} * {n_codes} + c + 1, 1))"
    inner = f"aggregate(slice(codes, blk * {_BLOCK} + 1, {_BLOCK}), substr(element_at(o, -1), -1, 1), (k, c) -> {step})"
    blocks = (
        f"aggregate(sequence(0, CAST((greatest(size(codes), 1) - 1) DIV {_BLOCK} AS INT)), "
        f"array({q(chr(_FIRST))}), (o, blk) -> concat(o, array(substr({inner}, 2))))"
    )
    walked = let(blocks, "walked", "array_join(slice(walked, 2, size(walked) - 1), '')")
    outs = f"transform(split({walked}, ''), v -> CAST((ascii(v) - {_FIRST}) DIV {len(states)} AS INT))"
    return let(codes, "codes", f"CASE WHEN size(codes) > 0 THEN {outs} ELSE CAST(array() AS ARRAY<INT>) END")


def _open_move(s: dict[str, int], c: int) -> tuple[dict[str, int], int]:
    """Forward, with what is open of (t)able, (r)ow and (c)ell: the codes of ends that close nothing go."""
    after = {
        "t": {_TABLE_TAG: 1, _TABLE_END: 0}.get(c, s["t"]),
        "r": 1 if c == _ROW_TAG else 0 if c == _ROW_END and s["t"] else s["r"],
        "c": 1 if c == _CELL_TAG else 0 if c == _CELL_END and s["r"] else s["c"],
    }
    if c == _TABLE_END and not s["t"]:
        return after, _NOT_OPEN
    closes_nothing = c == _CELL_END and not (s["c"] and s["r"]) or c == _ROW_END and not (s["r"] and s["t"])
    return after, 0 if closes_nothing or c in (_LIST, _LIST_END, _ITEM) else c


# Codes that are left, and their places in what the backward walk puts out: with ten more for lost ones.
_EVENTS = (0, _CELL_TAG, _CELL_END, _ROW_TAG, _ROW_END, _TABLE_TAG, _TABLE_END, _NOT_OPEN)
_LOST_EVENTS = tuple(c + _LOST for c in (_CELL_TAG, _CELL_END, _ROW_TAG, _ROW_END, _TABLE_TAG))


def _lost_move(s: dict[str, int], c: int) -> tuple[dict[str, int], int]:
    """Backward: does the next end of a table, row or cell come before the next start?"""
    after = {
        "t": {_TABLE_END: 1, _TABLE_TAG: 0}.get(c, s["t"]),
        "r": s["t"] if c == _ROW_END else 0 if c == _ROW_TAG else s["r"],
        "c": s["r"] if c == _CELL_END else 0 if c == _CELL_TAG else s["c"],
    }
    ended = "t" if c in (_TABLE_TAG, _ROW_END) else "r" if c in (_ROW_TAG, _CELL_END) else "c" if c == _CELL_TAG else None
    return after, (_EVENTS + _LOST_EVENTS).index(c + _LOST if ended and not s[ended] else c) if c in _EVENTS else 0


def _table_events(codes: str) -> str:
    """The codes that count: ends of what is open, and 10 more than its own for all that belongs to a dropped table."""
    effective = _walk(codes, _ITEM + 1, "trc", _open_move)
    last = _walk(f"reverse({effective})", _NOT_OPEN + 1, "trc", _lost_move)
    named = f"array({', '.join(map(str, _EVENTS + _LOST_EVENTS))})"
    return f"transform(reverse({last}), e -> {named}[e])"


def _dropped_text(events: str) -> str:
    """1 where the text behind a tag lies in a cell that is dropped."""

    def move(s: dict[str, int], c: int) -> tuple[dict[str, int], int]:
        w = 1 if c == _CELL_TAG + _LOST else 0 if c in (_CELL_TAG, _CELL_END, _CELL_END + _LOST) else s["w"]
        return {"w": w}, w

    return _walk(events, 2 * _LOST, "w", move)


def _render_tags(text: str) -> str:
    alt = ", ".join(
        f"nullif({match('g', alt_pattern)}, '')"
        for alt_pattern in (
            r"(?i)\salt\s*=\s*" + quoted for quoted in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")
        )
    )
    code = (
        f"CASE WHEN n IN ('ul', 'ol') THEN {_LIST} WHEN n IN ('/ul', '/ol') THEN {_LIST_END} WHEN n = 'li' THEN {_ITEM} "
        f"WHEN n IN ('td', 'th') THEN {_CELL_TAG} WHEN n IN ('/td', '/th') THEN {_CELL_END} WHEN n = 'tr' THEN {_ROW_TAG} "
        f"WHEN n = '/tr' THEN {_ROW_END} WHEN n = 'table' THEN {_TABLE_TAG} WHEN n = '/table' THEN {_TABLE_END} ELSE 0 END"
    )
    names = f"transform({match_all('x', _TAG_NAME, 1)}, n -> lower(n))"
    codes = f"transform(names, n -> {code})"
    # Items are indented inside a list; pages with one table need no look at how tables lie in each other.
    inner = f"CASE WHEN array_contains(names, 'li') THEN {_list_depths(codes)} END"
    several = "size(filter(names, n -> n = 'table')) > 1"
    events = f"CASE WHEN {several} THEN {_table_events(codes)} END"
    dropped = f"CASE WHEN events IS NOT NULL THEN {_dropped_text('events')} END"
    image = f"coalesce(concat('![', coalesce({alt}), ']'), '')"
    literal = (
        f"CASE WHEN n = 'img' THEN {let('tags[i]', 'g', image)} "
        "WHEN n = 'li' THEN IF(inner[i] = 1, '\n - ', '\n- ') "
        f"WHEN events[i] >= {_LOST} THEN IF(events[i] IN ({_NOT_OPEN}, {_TABLE_TAG + _LOST}), '\n\n', '') "
        f"WHEN n IN ('/td', '/th', '/tr') AND events[i] = 0 THEN '' "
        f"ELSE coalesce(try_element_at({text_map(_TAG_TEXT)}, n), '') END"
    )
    # Inside a dropped cell only the marks of rows, cells and tables stay.
    shown = f"IF(i > 0 AND dropped[i - 1] = 1 AND coalesce(events[i], 0) = 0, '', {literal})"
    pieces = f"CASE WHEN dropped IS NULL THEN {cut('x', _TAG)} ELSE transform({cut('x', _TAG)}, (p, i) -> IF(i > 0 AND dropped[i - 1] = 1, '', p)) END"
    woven = weave(pieces, f"transform(names, (n, i) -> {shown})")
    tags = f"CASE WHEN array_contains(names, 'img') THEN {match_all('x', _TAG)} END"
    nested = let(tags, "tags", let(inner, "inner", let(events, "events", let(dropped, "dropped", woven))))
    # Most pages have no tag whose text depends on others or on its attributes.
    alone = weave(cut("x", _TAG), f"transform(names, n -> coalesce(try_element_at({text_map(_TAG_TEXT)}, n), ''))")
    bound = let(names, "names", f"CASE WHEN {several} OR arrays_overlap(names, array('img', 'li')) THEN {nested} ELSE {alone} END")
    # Without them one pass is enough: every second piece is a tag's name.
    marked = f"split({replace('x', _TAG_NAME, f'{CUT_MARK}$1{CUT_MARK}')}, {q(CUT_MARK)}, -1)"
    # A map is searched from its first key on; most tags have no text.
    text_of = let("lower(p)", "n", f"IF({one_of('n', _TAG_TEXT)}, try_element_at({text_map(_TAG_TEXT)}, n), '')")
    named = f"IF(i % 2 = 1, {text_of}, p)"
    plain = f"array_join(transform({marked}, (p, i) -> {named}), '')"
    return let(text, "x", f"CASE WHEN x RLIKE {q(_NESTING)} THEN {bound} ELSE {plain} END")


_TABLE = f"{_TABLE_OPEN}([^{_TABLE_OPEN}{_TABLE_CLOSE}]*){_TABLE_CLOSE}"
_CELL = f"{_CELL_OPEN}([^{_CELL_OPEN}{_CELL_CLOSE}]*){_CELL_CLOSE}"


def _table_rows(body: str) -> str:
    """Closed rows of a marked table with their closed cells; blank rows left out."""
    cells = f"transform({match_all(f'substring_index(r, {q(_ROW_OPEN)}, -1)', _CELL, 1)}, c -> {collapse('c')})"
    closed = let(
        cut(body, _ROW_CLOSE),
        "pieces",
        f"filter(slice(pieces, 1, size(pieces) - 1), r -> contains(r, {q(_ROW_OPEN)}))",
    )
    return f"filter(transform({closed}, r -> {cells}), row -> exists(row, c -> c <> ''))"


def _render_tables(text: str) -> str:
    padded = (
        "transform(rows, r -> concat('| ', "
        "array_join(concat(r, array_repeat('', width - size(r))), ' | '), ' |'))"
    )
    rule = "concat('|', array_join(array_repeat(' --- ', width), '|'), '|')"
    drawn = let(
        "array_max(transform(rows, r -> size(r)))",
        "width",
        let(padded, "p", f"array_join(concat(slice(p, 1, 1), array({rule}), slice(p, 2, size(p))), '\n')"),
    )
    table = let(
        _table_rows("body"),
        "rows",
        f"concat({replace('body', _CELL)}, CASE WHEN size(rows) > 0 THEN concat('\n', {drawn}, '\n') ELSE '\n\n' END)",
    )
    woven = weave(cut("x", _TABLE), f"transform({match_all('x', _TABLE, 1)}, body -> {table})")
    rendered = let(text, "x", f"CASE WHEN contains(x, {q(_TABLE_OPEN)}) THEN {woven} ELSE x END")
    return replace(rendered, _MARKS)


def _tidy(text: str) -> str:
    return strip(replace(replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


# ------------------------------------------------------------ public functions
def page_title(kept: str) -> str:
    titles = f"array_join({match_all(kept, _TITLE, 1)}, '')"
    return strip(unescape(replace(titles, _TAG)))


def to_markdown(kept: str, base_url: str) -> str:
    """Markdown of a page whose boilerplate is already gone."""
    linked = replace(replace(kept, _TITLE), _ANCHOR, f"<a>$4</a>{_HREF_OPEN}$1$2$3{_HREF_CLOSE}")
    rendered = _render_tags(_resolve_marked(linked, base_url))
    # Character references are decoded in the text and once more in the result.
    return _tidy(unescape(_render_tables(unescape(rendered))))


def table_rows(kept: str) -> str:
    """``array<array<array<string>>>``: tables, rows, cells of a cleaned page."""
    tables = f"transform({match_all(unescape(_render_tags(kept)), _TABLE, 1)}, body -> {_table_rows('body')})"
    return f"CASE WHEN {kept} RLIKE {q('(?i)<table[ >]')} THEN {tables} END"


def anchors(kept: str, base_url: str) -> str:
    """``array<struct<text, href>>``: links of a cleaned page in reading order."""
    href = "concat(" + ", ".join(match("a", _ANCHOR, g) for g in (1, 2, 3)) + ")"
    one = (
        f"named_struct('text', {collapse(unescape(replace(match('a', _ANCHOR, 4), _TAG)))}, "
        f"'href', {_resolve(base_url, unescape(href))})"
    )
    return f"transform({match_all(kept, _ANCHOR)}, a -> {one})"
