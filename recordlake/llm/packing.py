"""Packing tokenised documents into sequences of fixed capacity by bin completion.

Contract of edge cases: a null or empty text still has its end token; a text of
the control string's letters is encoded as the tokenizer library does; pieces of
equal length are interchangeable and numbered by (doc id, piece); repeated rows
are packed once each; an empty table gives an empty result.  Columns of the
documents other than id and text are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import materialise
from .bpe import Vocabulary, flatten_ids
from .bytewise import Texts, blobs, small_slices, tidy

#: Search steps for one sequence's fillings, and for all of them together.
FILLING_STEPS, SEARCH_STEPS = 1000, 1_000_000
#: Parts in which pieces of one length are numbered.
NUMBERING_PARTS = 4096


def ids_column(ranks_path: str, library_path: str, end_id: int):
    """A column function: text to packed ids (little-endian uint32) with ``end_id`` after the last."""

    @tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, library = Vocabulary.at(ranks_path), None
        try:
            for batch in batches:
                out = []
                for part in small_slices(batch):
                    texts = Texts(part)
                    flat, rows = flatten_ids(texts, vocabulary.ids_of, spare=1, table=vocabulary.table)
                    flat[rows[1:] - 1] = end_id
                    if b"<|" in texts.data.tobytes():
                        # Control strings: the library cuts the text at them first.
                        if library is None:
                            from tokenizers import Tokenizer

                            library = Tokenizer.from_file(library_path)
                            controls = [t.content for t in library.get_added_tokens_decoder().values()]
                        for i, text in enumerate(part.to_pylist()):
                            if text and any(c in text for c in controls):
                                own = np.array([*library.encode(text, add_special_tokens=False).ids, end_id], np.uint32)
                                flat = np.concatenate([flat[: rows[i]], own, flat[rows[i + 1] :]])
                                rows[i + 1 :] += len(own) - (rows[i + 1] - rows[i])
                    out.append(blobs(flat.view(np.uint8), rows * 4))
                yield pa.concat_arrays(out) if out else pa.array([], pa.binary())
        finally:
            vocabulary.forget()

    return F.arrow_udf(encode, "binary").asNondeterministic()


def token_pieces(docs: DataFrame, ids, *, doc_id: str = "doc_id", capacity: int = 1024) -> DataFrame:
    """Documents to pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    ``ids`` is a column of packed ids, never empty.  Only longer documents are cut;
    their first piece takes what is left over, so that all others are full.
    """
    n = F.expr("CAST(length(__ids) DIV 4 AS BIGINT)")
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), ids.alias("__ids"))
        .withColumn("__n", n)
        .withColumn("__head", F.expr(f"((__n - 1) % {capacity}) + 1"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0, CAST((__n - 1) DIV {capacity} AS INT))")))
    )
    rows = rows.withColumn("start", F.expr(f"IF(piece = 0, 0L, __head + (piece - 1L) * {capacity})"))
    rows = rows.withColumn("length", F.expr(f"IF(piece = 0, __head, {capacity}L)"))
    crc = F.expr("crc32(substring(__ids, CAST(start * 4 + 1 AS INT), CAST(length * 4 AS INT)))")
    return rows.select("doc_id", "piece", "start", "length", crc.alias("ids_crc32"))


# A packing is a list of (filling, copies); a filling lists (length, how often), longest first.
Filling = tuple[tuple[int, int], ...]
Packing = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over counts of lengths: each piece goes where it leaves the least room."""
    open_: dict[int, list[tuple[Filling, int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                fit = capacity // length
                whole, rest = divmod(left, fit)
                if whole:
                    open_.setdefault(capacity - fit * length, []).append((((length, fit),), whole))
                if rest:
                    open_.setdefault(capacity - rest * length, []).append((((length, rest),), 1))
                break
            filling, copies = open_[room].pop()
            if not open_[room]:
                del open_[room]
            fit = min(room // length, left)
            used = min(copies, left // fit)
            if used < copies:
                open_.setdefault(room, []).append((filling, copies - used))
            open_.setdefault(room - fit * length, []).append(((*filling, (length, fit)), used))
            left -= fit * used
    return [x for group in open_.values() for x in group]


def fillings(counts: dict[int, int], room: int) -> tuple[list[Filling], int]:
    """Undominated ways to fill ``room``, the least waste first, and the steps that took.

    They are all there are, unless that takes more than ``FILLING_STEPS``.  A filling is
    dominated if a piece at hand fits beside it, or fits where a shorter piece of it
    lies.  Of equal waste, the one with longer pieces comes first.
    """
    lengths = sorted((x for x in counts if x <= room), reverse=True)
    falling, rising = [-x for x in lengths], lengths[::-1]
    found: list[tuple[int, Filling]] = []
    steps = 0

    def dominated(left: int, chosen: Filling) -> bool:
        if not left:
            return False
        used = dict(chosen)

        def at_hand(above: int, upto: int) -> bool:
            for i in range(bisect_right(rising, above), len(rising)):
                if rising[i] > upto:
                    return False
                if counts[rising[i]] > used.get(rising[i], 0):
                    return True
            return False

        return at_hand(0, left) or any(at_hand(x, x + left) for x in used)

    def search(at: int, left: int, chosen: Filling) -> None:
        nonlocal steps
        for i in range(max(at, bisect_left(falling, -left)), len(lengths)):
            length = lengths[i]
            for k in range(min(counts[length], left // length), 0, -1):
                steps += 1
                if steps > FILLING_STEPS:
                    return
                search(i + 1, left - k * length, (*chosen, (length, k)))
        if not dominated(left, chosen):
            found.append((left, chosen))

    search(0, room, ())
    found.sort(key=lambda f: f[0])
    return [chosen for _, chosen in found] or [()], steps


def bin_completion(counts: dict[int, int], capacity: int) -> Packing:
    """As few sequences as found: branch and bound over the fillings around the longest piece.

    A branch takes the longest piece left and an undominated filling of its room, at
    first as many copies of both as there are pieces for, then one.  Branches are
    tried depth first, the least waste first, and cut when the sequences so far and the
    least number that the rest needs reach the incumbent, at first the best-fit packing.
    The search ends when the incumbent reaches the least number for all, or after
    ``SEARCH_STEPS``, but not before its first way down, of which every step uses up a
    length.  Equal lengths are counted, not listed, so the work follows the
    capacity and not the number of documents.
    """
    left, tokens = dict(counts), sum(k * n for k, n in counts.items())
    bound = -(-tokens // capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    # What is packed now, and for each of it the options that are left to try.
    packing: Packing = []
    open_options: list[list[tuple[Filling, int]]] = []
    used = steps = 0
    first = True
    while fewest > bound:
        if not left and used < fewest:
            best, fewest = list(packing), used
        options: list[tuple[Filling, int]] = []
        first = first and bool(left) and used - (-tokens // capacity) < fewest
        if left and used - (-tokens // capacity) < fewest and (first or steps < SEARCH_STEPS):
            longest = max(left)
            rest = _without(left, ((longest, 1),), 1)
            ways, taken = fillings(rest, capacity - longest)
            steps += len(rest) + taken
            for chosen in ways:
                filling = {longest: 1}
                for length, k in chosen:
                    filling[length] = filling.get(length, 0) + k
                whole = tuple(sorted(filling.items(), reverse=True))
                copies = min(left[length] // k for length, k in whole)
                options += [(whole, copies)] + ([(whole, 1)] if copies > 1 else [])
            options.reverse()
        # Back to the last branch that has another option.
        while not options and packing:
            filling, copies = packing.pop()
            for length, k in filling:
                left[length] = left.get(length, 0) + k * copies
            used, tokens = used - copies, tokens + copies * _sum(filling)
            options = open_options.pop()
        if not options:
            break
        filling, copies = options.pop()
        left = _without(left, filling, copies)
        used, tokens = used + copies, tokens - copies * _sum(filling)
        packing.append((filling, copies))
        open_options.append(options)
    return best


def _sum(filling: Filling) -> int:
    return sum(length * k for length, k in filling)


def _without(counts: dict[int, int], filling: Filling, copies: int) -> dict[int, int]:
    out = dict(counts)
    for length, k in filling:
        out[length] -= k * copies
        if not out[length]:
            del out[length]
    return out


def pack(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (doc_id, piece, length, ...).

    The driver sees one count per length, at most ``capacity`` rows, and plans over
    counts.  The pieces are numbered within their length, in parts, so that no length
    is sorted by one task, and a piece's number tells its place.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, base, taken = [], 0, dict.fromkeys(counts, 0)
    for filling, copies in bin_completion(counts, capacity):
        offset = 0
        for length, k in filling:
            slots.append((length, taken[length], taken[length] + k * copies, k, base, offset))
            taken[length] += k * copies
            offset += length * k
        base += copies
    slot_table = spark.createDataFrame(
        slots or [(0, 0, 0, 1, 0, 0)], "length long, __from long, __to long, __each long, __base long, __offset long"
    )
    part = F.expr(f"pmod(xxhash64(doc_id, piece), {NUMBERING_PARTS})")
    parted = pieces.withColumn("__part", part)
    sizes = parted.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__size"))
    running = F.sum("__size").over(W.partitionBy("length").orderBy("__part"))
    before = sizes.select("length", "__part", (running - F.col("__size")).alias("__before"))
    order = W.partitionBy("length", "__part").orderBy("doc_id", "piece")
    numbered = parted.withColumn("__rn", F.row_number().over(order)).join(before, ["length", "__part"])
    numbered = numbered.withColumn("__at", F.col("__before") + F.col("__rn") - 1)
    # At most one row per filling and length: its size follows the capacity alone.
    placed = numbered.join(
        F.broadcast(slot_table.withColumnRenamed("length", "__length")),
        F.expr("length = __length AND __at >= __from AND __at < __to"),
    )
    return placed.select(
        *[c for c in pieces.columns],
        F.expr("__base + (__at - __from) DIV __each").alias("sequence_id"),
        F.expr("__offset + pmod(__at - __from, __each) * length").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    library_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ids = ids_column(ranks_path, library_path, end_id)(F.col(text).cast("string"))
    pieces = token_pieces(docs, ids, doc_id=doc_id, capacity=capacity)
    return pack(materialise(pieces, "pieces"), capacity=capacity)
