"""Where a byte-level BPE cuts text before it merges, found without a regular expression.

Every code point becomes one of eight symbols by its class and its neighbours'.
A symbol is a function from state to state; functions compose associatively, so
the state before every code point comes from a scan: blocks of code points are
composed side by side, the few block results are run through in order, and the
blocks are entered again from their known first states.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .bytewise import Texts

# Classes of code points, then the symbols that the automaton reads.
_LETTER, _NUMBER, _OTHER, _WHITE = range(4)
SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_SHORT, SYM_LONG, SYM_RUN, SYM_GLUE, SYM_LONE = range(8)
# States: what the code points so far leave open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, GLUED, ONE_MORE, TWO_MORE = range(8)
#: White space beyond ASCII in the cut pattern's sense (fixed values).
_WIDE_WHITE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state]: the next state; cut[symbol, state]: whether a piece starts at the symbol."""
    step = np.zeros((8, 8), np.uint8)
    cut = np.ones((8, 8), bool)
    for symbol, inside in ((SYM_LETTER, IN_LETTERS), (SYM_NUMBER, IN_NUMBERS), (SYM_OTHER, IN_OTHERS)):
        step[symbol] = inside
        cut[symbol, [inside, GLUED]] = False
    # A contraction takes one or two letters more; then a new piece starts.
    step[SYM_LETTER, ONE_MORE], step[SYM_LETTER, TWO_MORE] = FRESH, ONE_MORE
    cut[SYM_LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, after in ((SYM_SHORT, ONE_MORE), (SYM_LONG, TWO_MORE)):
        step[symbol] = after
        step[symbol, [IN_OTHERS, GLUED]] = IN_OTHERS  # not at a piece's start: a sign like others
        cut[symbol, [IN_OTHERS, GLUED]] = False
    step[SYM_RUN] = IN_WHITE
    cut[SYM_RUN, IN_WHITE] = False
    step[SYM_GLUE] = GLUED  # one space belongs to what follows
    step[SYM_LONE] = FRESH
    return step, cut


def _closure(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols: maps[f, state], then[f, g] (f first), and the map of (symbol, row start)."""
    maps = [tuple(range(8))]
    seen = {maps[0]: 0}
    basis = [tuple(int(x) for x in row) for row in step] + [(int(row[FRESH]),) * 8 for row in step]
    for f in maps:
        for g in basis:
            h = tuple(g[x] for x in f)
            if h not in seen:
                seen[h] = len(maps)
                maps.append(h)
    n = len(maps)
    then = np.zeros((n, n), np.uint16)
    for a, f in enumerate(maps):
        for b, g in enumerate(maps):
            then[a, b] = seen[tuple(g[x] for x in f)]
    return np.array(maps, np.uint8), then, np.array([seen[g] for g in basis], np.uint16)


_tables: dict[str, tuple] = {}


def _get_tables() -> tuple:
    if not _tables:
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for code in range(0x110000):
            group = unicodedata.category(chr(code))[0]
            if group == "L":
                kinds[code] = _LETTER
            elif group == "N":
                kinds[code] = _NUMBER
        kinds[[9, 10, 11, 12, 13, 32, *_WIDE_WHITE]] = _WHITE
        step, cut = _machine()
        _tables["all"] = (kinds, cut, *_closure(step))
    return _tables["all"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and values of the code points of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[at].astype(np.int32)
    wide = np.flatnonzero(value >= 0xC0)
    if len(wide):
        lead, base = value[wide], at[wide]
        tail = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two, three = (tail[base + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        code = ((lead & 0x1F) << 6) | one
        code = np.where(lead >= 0xE0, ((lead & 0x0F) << 12) | (one << 6) | two, code)
        value[wide] = np.where(lead >= 0xF0, ((lead & 0x07) << 18) | (one << 12) | (two << 6) | three, code)
    return at, value


def _symbols(value: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks those that open a row."""
    n = len(value)
    kind = kinds[value]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    white = kind == _WHITE
    inked_next = np.zeros(n, bool)
    inked_next[:-1] = ~white[1:] & ~last[:-1]
    out = kind.copy()  # letters, numbers and others have their symbols' numbers
    out[white] = SYM_RUN
    out[white & inked_next] = SYM_LONE
    out[white & inked_next & (value == 32)] = SYM_GLUE
    marks = np.flatnonzero((value == 39) & ~last)
    if len(marks):
        one = value[marks + 1]
        out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SYM_SHORT
        roomy = marks[~last[marks + 1]]
        pair = value[roomy + 1] * 256 + value[roomy + 2]
        out[roomy[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]] = SYM_LONG
    return out


def _states_before(functions: np.ndarray, maps: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The state before each code point, from FRESH, by a scan in blocks."""
    n = len(functions)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, np.uint16)  # function 0 changes nothing
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    flat, size = then.ravel(), then.shape[0]
    total = grid[0].astype(np.intp)
    for row in grid[1:]:
        total = flat[total * size + row].astype(np.intp)
    entry = np.zeros(blocks, np.uint8)
    state = FRESH
    for b, f in enumerate(total):
        entry[b] = state
        state = maps[f, state]
    before = np.empty((width, blocks), np.uint8)
    table = maps.ravel()
    for j, row in enumerate(grid):
        before[j] = entry
        entry = table[row.astype(np.intp) * 8 + entry]
    return before.T.reshape(-1)[:n]


def piece_bounds(texts: Texts) -> np.ndarray:
    """Byte positions at which the pieces of all rows start, then the number of bytes."""
    if not len(texts.data):
        return np.zeros(1, np.int64)
    kinds, cut, maps, then, basis = _get_tables()
    at, value = code_points(texts.data)
    first = np.zeros(len(at), bool)
    first[np.searchsorted(at, texts.edges()[0])] = True
    symbol = _symbols(value, first, kinds)
    before = _states_before(basis[symbol + 8 * first.astype(np.uint8)], maps, then)
    starts = at[np.take(cut.ravel(), symbol * np.uint8(8) + before) | first]
    return np.append(starts, len(texts.data))
