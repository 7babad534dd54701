"""Quality rules with repetition measured on suffix arrays.

Contract of edge cases: a null or empty text has no words and fails the base
rules; texts of any length are judged whole; ties cannot occur; repeated rows are
judged one by one and alike; other columns pass unchanged, a column named like the
output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewise import Hashes, Texts, mix, small_slices, tidy
from .suffixes import SuffixArray, covered

#: Words of the repeats that the base rule counts.
BASE_WINDOW = 5
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>")] = True

_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long"
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: Texts, least: int) -> list[np.ndarray]:
    """The measures of ``_FIELDS`` for each row."""
    rows = texts.rows
    if not len(texts.data):
        return [np.zeros(rows, np.int64)] * 7
    starts, ends = texts.words()
    row = texts.row_of(starts)
    bounds = np.searchsorted(starts, texts.bounds)
    n_words = np.diff(bounds)
    hashes = Hashes(texts.data)
    opens = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    word_chars = _sums(opens[ends] - opens[starts], bounds)
    n_symbols = texts.per_row(_SIGNS[texts.data])

    # Lines with a word that equal an earlier line of their row.
    line_starts, line_ends = texts.lines()
    inked = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[inked], line_ends[inked]
    line_row = texts.row_of(line_starts) if len(line_starts) else np.zeros(0, np.int64)
    keys = hashes.of(line_starts, line_ends) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    _, sample = np.unique(keys, return_index=True)
    n_dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[sample], minlength=rows)

    # Words carry their row, so no repeat crosses rows: one array serves all of them.
    symbols = mix(hashes.of(starts, ends) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    repeats = SuffixArray(symbols).longest_repeats()
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[repeats > 0], repeats[repeats > 0])
    n_repeat = _sums(covered(repeats, BASE_WINDOW), bounds)
    n_covered = _sums(covered(repeats, least), bounds)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_covered, longest]


def measures_column(least: int):
    """A column function: text to a struct of its measures."""

    @tidy
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [field.split()[0] for field in _FIELDS.split(", ")]
        for batch in batches:
            found = [measure(Texts(part), least) for part in small_slices(batch)]
            columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(len(names))]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return F.arrow_udf(judge, _FIELDS).asNondeterministic()


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    into: str = "quality",
    least_repeat: int = 3,
    max_covered: float = 0.25,
    max_longest: int = 40,
) -> DataFrame:
    """Add ``into``: the measures, ``base_failed`` and ``kept``.

    ``n_covered_words`` is the size of the union of all maximal repeated substrings of
    at least ``least_repeat`` words, ``longest_repeat`` the words of the longest of any
    size.  A text is kept if the base rules pass, at most ``max_covered`` of its words
    are covered and no repeat is longer than ``max_longest`` words.  A narrow step.
    """
    measured = docs.withColumn("__measured", measures_column(least_repeat)(F.col(text).cast("string")))
    failed = "(__measured.n_words < 10 OR 100 * __measured.n_repeat_words > 20 * __measured.n_words)"
    kept = (
        f"NOT {failed} AND __measured.n_covered_words <= {max_covered}D * __measured.n_words "
        f"AND __measured.longest_repeat <= {max_longest}"
    )
    out = F.expr(f"named_struct('n_words', __measured.n_words, 'word_chars', __measured.word_chars, "
                 f"'n_symbols', __measured.n_symbols, 'n_dup_lines', __measured.n_dup_lines, "
                 f"'n_repeat_words', __measured.n_repeat_words, 'n_covered_words', __measured.n_covered_words, "
                 f"'longest_repeat', __measured.longest_repeat, 'base_failed', {failed}, 'kept', {kept})")
    return measured.withColumn(into, out).drop("__measured")
