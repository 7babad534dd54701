"""Suffix dedup: bytes covered by long strings that also start in an earlier document.

Every string of ``length`` bytes belongs to its anchor, the position of the least
hash of a short gram inside it, the leftmost of equal ones.  Equal strings have equal
anchors at equal distances, so strings can be sorted anchor by anchor.

1. Texts are cut where a gram's hash says so, and a cut with the ``length`` - 1 bytes
   after it is looked up by its hash (128 bits): copies of longer passages are covered
   here at once, all but the ends of a passage.
2. A string reaches far to the left or to the right of its anchor, so two equal ones
   share the two grams from the anchor on, or the two that end with the anchor's.  Hashes
   of these sides are shuffled; anchors whose sides stand in a single document drop out.
   Documents send the text around each anchor that is left and not yet covered, the
   bytes of all strings that belong to it, to the gram's shard.
3. A shard sorts suffixes by induction.  The suffixes at the anchors are the sample
   and are sorted directly, with the common prefixes of neighbours.  From level d, the
   suffixes d bytes before their anchors in order, level d + 1 is induced: the tuples
   (byte before, rank) are put in order, and a common prefix is one more than the least
   one between the two ranks.  Intervals with a common prefix of ``length`` hold equal
   strings; all but those of the smallest document id are covered.
4. Covered runs go back to their documents.

Shards of any size pass through Spark's sort, whose runs are on disk, as a stream;
memory holds a block of whole grams.  A gram with more occurrences than a block may
hold sends its strings on, each under its own hash, and is dealt with by step 3b, which
needs no memory but one string for each hash.  What a step found is written, and the step's shuffle files go, so
disk holds the shuffles of one step; inside a step a lost executor costs the stages it held.

Contract of edge cases: a null text is empty; a document id names one text, repeated
rows of it are alike and do not cover each other; rows without an id take no part and
keep all bytes; texts are judged whole; of equal ids none is smaller; an empty table
gives an empty result; other columns pass unchanged, columns named like the output are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import discard
from .bytewise import Hashes, Texts, blobs, mix, small_slices, tidy
from .session import settled

#: Bytes of the grams that anchors are chosen by.
GRAM = 16
#: Mean bytes between the cuts of step 1, a power of two.
CUT_BYTES = 128
#: Positions whose grams are hashed at once.
HASH_BLOCK = 1 << 14
#: Occurrences in a block, and of one gram that are still sorted together.
BLOCK_ROWS, GRAM_ROWS = 60_000, 200_000
_ROUTE = np.uint64(0xA5A5A5A5DEADBEEF)
_U = np.uint64
#: Grams travel by 48 bits: another gram under the same ones costs work, as bytes are compared.
_SHORT = _U((1 << 48) - 1)

_CUTS = "key long, rest long, doc long, first long, last long"
_ANCHORS = "key long, doc long, anchor long"
_SHARED = "doc long, anchor int"
_CONTEXTS = "key long, doc long, at long, first long, last long, bytes binary"
_ROUTED = "key long, doc long, first long, last long, bytes binary"
_SPANS = "doc long, first long, last long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on.

    Taken from the bytes themselves, as two words.  Two grams under one hash cost work
    only: what is covered is decided by whole bytes.
    """
    n = len(data) - GRAM + 1
    words = np.ndarray((n + 8,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(_U)
    words += _U(0x2545F4914F6CDD1D)
    words *= _U(0xBF58476D1CE4E5B9)
    words ^= words >> _U(32)
    words *= _U(0x94D049BB133111EB)
    out = words[:n] ^ (words[:n] >> _U(29))
    out *= _U(0x9E3779B97F4A7C15)
    out += words[8:]
    out ^= out >> _U(30)
    out *= _U(0xD6E8FEB86659FD93)
    out ^= out >> _U(32)
    return out


def blocks_of(n: int) -> Iterator[tuple[int, int]]:
    """Runs of positions that stay in a core's cache with what is computed for them."""
    for begin in range(0, n, HASH_BLOCK):
        yield begin, min(n, begin + HASH_BLOCK)


class Anchored:
    """Runs of string starts with one anchor: rows, anchor positions, first and last starts, gram hashes."""

    def __init__(self, texts: Texts, length: int):
        n = len(texts.data) - length + 1
        none = np.zeros(0, np.int64)
        self.row = self.at = self.first = self.last = none
        self.key = np.zeros(0, _U)
        if n < 1:
            return
        opens = texts.edges()[0]
        begins, anchors, keys = [], [], []
        for begin, end in blocks_of(n):
            # One start more on the left tells whether the first one here goes on with its anchor.
            low = max(begin - 1, 0)
            grams = gram_hashes(texts.data[low : end + length - 1])
            ordered = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
            anchor = (sliding_least(ordered, length - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(end - low, bool)
            new[1:] = anchor[1:] != anchor[:-1]
            new[opens[np.searchsorted(opens, low) : np.searchsorted(opens, end)] - low] = True
            new[: begin - low] = False
            at = np.flatnonzero(new)
            begins.append(at + low)
            anchors.append(anchor[at] + low)
            keys.append(grams[anchor[at]])
        first, at, key = np.concatenate(begins), np.concatenate(anchors), np.concatenate(keys)
        row = texts.row_of(first)
        # Strings end in their row.
        last = np.minimum(np.append(first[1:], n) - 1, texts.bounds[row + 1] - length)
        use = first <= last
        self.row, self.at, self.first, self.last = row[use], at[use], first[use], last[use]
        self.key = key[use] & _SHORT


def side_keys(texts: Texts, found: Anchored, length: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the right and the left side of anchors: which of them have strings that reach far there, and the sides' hashes.

    Strings up to ``half`` bytes before their anchor reach to the right, the others to the
    left; equal strings lie alike, so they share the side they reach to.
    """
    half = (length - GRAM) // 2
    out = []
    for far, step in ((found.at - found.last <= half, min(GRAM, length - half - GRAM)), (found.at - found.first > half, -min(GRAM, half + 1))):
        use = np.flatnonzero(far)
        words = np.ndarray((max(len(texts.data) - 7, 0),), "<u8", np.ascontiguousarray(texts.data), strides=(1,))
        beside = found.at[use] + step
        key = mix(words[beside] ^ mix(words[beside + 8] + found.key[use] * _U(0x9E3779B97F4A7C15)) ^ _U(step & 0xFF))
        out.append((use, key & _SHORT))
    return tuple(out)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == _U else values, pa.int64())


def _pack_batch(texts: pa.Array) -> pa.Array:
    """Texts for the shuffle: compressed one by one they take two thirds of what Spark's own blocks do."""
    packer = zstandard.ZstdCompressor(level=3)
    return pa.array([packer.compress(x.as_buffer()) if x.is_valid else None for x in texts], pa.binary())


def _unpack(packed: pa.Array) -> pa.Array:
    unpacker = zstandard.ZstdDecompressor()
    return pa.array([unpacker.decompress(x.as_buffer()) if x.is_valid else None for x in packed], pa.binary())


def _docs_and_texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Texts, int]]:
    """Ids and texts of the rows with an id, in small slices, and where each slice starts in the batch."""
    at = 0
    for part in small_slices(batch.column(1)):
        ids = batch.column(0).slice(at, len(part))
        yield ids.to_numpy(zero_copy_only=False), Texts(part), at
        at += len(part)


def find_cuts(length: int):
    """(doc, text) to the hash of each cut with the bytes after it, and its first and last string starts.

    Repetitions in later documents of a slice are covered at once and come out under
    spread keys without the rest of the hash.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, _ in _docs_and_texts(batch):
                n = len(texts.data)
                if n < length:
                    continue
                cuts = [
                    np.flatnonzero((gram_hashes(texts.data[a : b + GRAM - 1]) & _U(CUT_BYTES - 1)) == 0) + a
                    for a, b in blocks_of(n - GRAM + 1)
                ]
                begin = np.union1d(np.concatenate(cuts), texts.edges()[0])
                row = texts.row_of(begin)
                stop = np.minimum(np.append(begin[1:], n), texts.bounds[row + 1])
                end = np.minimum(stop + length - 1, texts.bounds[row + 1])
                use = end - begin >= length
                begin, end, row = begin[use], end[use], row[use]
                raw = texts.data.tobytes()
                digest = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())])
                key, rest = np.frombuffer(digest, np.int64).reshape(-1, 2).T
                doc, base = ids[row].astype(np.int64), texts.bounds[row]
                order = np.lexsort((doc, rest, key))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (rest[order][1:] != rest[order][:-1])
                least = np.empty(len(order), np.int64)
                least[order] = np.repeat(doc[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
                again = doc > least
                first, last = begin - base, end - length - base
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(again, mix(begin.astype(_U) ^ mix(doc.view(_U))).view(np.int64), key)),
                     pa.array(rest, mask=again), pa.array(doc), pa.array(first), pa.array(last)],
                    names=["key", "rest", "doc", "first", "last"],
                )

    return run


@tidy
def repeated_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key, rest and doc: the cuts that a smaller document has too."""
    held = owner = None
    for batch in batches:
        again = batch.filter(batch.column(1).is_null())
        if len(again):
            yield again.select([2, 3, 4])
        batch = batch.filter(batch.column(1).is_valid())
        if not len(batch):
            continue
        key, rest, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
        first = doc[new]
        if held == (key[0], rest[0]):
            first[0] = owner
        owners = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(key))))
        held, owner = (key[-1], rest[-1]), owners[-1]
        found = batch.filter(pa.array(doc > owners))
        if len(found):
            yield found.select([2, 3, 4])


def find_anchors(length: int):
    """(doc, text) to one row for each side of a document's anchors, under the side's hash.

    Of the documents of a slice that share a side only the first one travels under it,
    so a common side is sent once for each slice; that the others share theirs is known
    already, and they travel under spread keys.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, _ in _docs_and_texts(batch):
                found = Anchored(texts, length)
                if not len(found.key):
                    continue
                (right, key), (left, more) = side_keys(texts, found, length)
                key, doc = np.concatenate([key, more]), ids[found.row[np.concatenate([right, left])]].astype(np.int64)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new_key = np.ones(len(key), bool)
                new_key[1:] = key[1:] != key[:-1]
                new = new_key.copy()
                new[1:] |= doc[1:] != doc[:-1]
                key, doc, new_key = key[new], doc[new], new_key[new]
                begin = np.flatnonzero(new_key)
                sizes = np.diff(np.append(begin, len(key)))
                known = np.repeat(sizes > 1, sizes)
                # In the order of documents, rows next to each other are alike and take less room.
                lead = begin[np.argsort(doc[begin], kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [_longs(key[lead]), _longs(doc[lead]), pa.nulls(len(begin), pa.int64())],
                    names=["key", "doc", "anchor"],
                )
                if known.any():
                    route = mix(key[known] ^ mix(doc[known].view(_U) ^ _ROUTE))
                    yield pa.RecordBatch.from_arrays(
                        [_longs(route), _longs(doc[known]), _longs(key[known])], names=["key", "doc", "anchor"]
                    )

    return run


def _low(keys: np.ndarray) -> pa.Array:
    """The low half of sides' hashes: enough to tell a document's own anchors apart, and a wrong one only costs work."""
    return pa.array((keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32))


@tidy
def keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key and doc: the sides of anchors that stand in two documents."""
    held_key = held_doc = None
    held_out = False
    for batch in batches:
        known = batch.filter(batch.column(2).is_valid())
        if len(known):
            yield pa.RecordBatch.from_arrays([known.column(1), _low(known.column(2).to_numpy())], names=["doc", "anchor"])
        rows = batch.filter(batch.column(2).is_null())
        if not len(rows):
            continue
        key, doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if held_key is not None:
            # The last row of the batch before may share its key with the first rows here.
            key, doc = np.append(held_key, key), np.append(held_doc, doc)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        ends = np.append(begin[1:], len(key)) - 1
        shared = (doc[begin] != doc[ends])[group]
        shared[: ends[0] + 1] |= held_out
        out = shared.copy()
        if held_key is not None and held_out:
            out[0] = False
        # The last group may go on: what it shares is told, its last row is kept back.
        held_key, held_doc, held_out = key[-1], doc[-1], bool(shared[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), _low(key[out])], names=["doc", "anchor"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a list column without nulls."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), values


def cut_contexts(length: int):
    """(doc, packed text, shared anchors, covered cuts) to the text around anchors: the bytes from the first string's start on.

    ``at`` and ``last`` count from ``first``.

    A slice's repetitions of one context in later documents are covered at once and do
    not travel; their runs come out without bytes, ``last`` their end.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpacked = pa.RecordBatch.from_arrays([batch.column(0), _unpack(batch.column(1))], names=["doc", "text"])
            for ids, texts, at in _docs_and_texts(unpacked):
                anchors, firsts, lasts = (batch.column(i).slice(at, texts.rows) for i in (2, 3, 4))
                owner, wanted = _flat(anchors)
                if not len(wanted):
                    continue
                found = Anchored(texts, length)
                shared, use = (owner.astype(_U) << _U(32)) | wanted.view(np.uint32).astype(_U), np.zeros(len(found.key), bool)
                for side, key in side_keys(texts, found, length):
                    use[side] |= np.isin((found.row[side].astype(_U) << _U(32)) | (key & _U(0xFFFFFFFF)), shared)
                # Strings that start in covered cuts are done.
                done = np.zeros(len(texts.data) + 1, np.int64)
                for spans, shift, sign in ((firsts, 0, 1), (lasts, 1, -1)):
                    row, value = _flat(spans)
                    np.add.at(done, np.minimum(texts.bounds[row] + value + shift, len(texts.data)), sign)
                open_ = np.concatenate([[0], np.cumsum(np.cumsum(done[:-1]) <= 0)])
                use &= open_[found.last + 1] > open_[found.first]
                if not use.any():
                    continue
                row, where, first, last, key = (x[use] for x in (found.row, found.at, found.first, found.last, found.key))
                doc, base = ids[row].astype(np.int64), texts.bounds[row]
                end = np.minimum(np.maximum(where + length, last + length), texts.bounds[row + 1])
                same = Hashes(texts.data).of(first, end) ^ mix((where - first).astype(_U) * _U(97) + (last - first).astype(_U))
                order = np.lexsort((doc, same))
                new = np.ones(len(order), bool)
                new[1:] = same[order][1:] != same[order][:-1]
                least = np.empty(len(order), np.int64)
                least[order] = np.repeat(doc[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
                again = doc > least
                if again.any():
                    spread = mix(doc[again].view(_U) ^ mix(first[again].astype(_U)))
                    yield pa.RecordBatch.from_arrays(
                        [_longs(spread), _longs(doc[again]), pa.nulls(int(again.sum()), pa.int64()),
                         _longs((first - base)[again]), _longs((last - base + length)[again]),
                         pa.nulls(int(again.sum()), pa.binary())],
                        names=["key", "doc", "at", "first", "last", "bytes"],
                    )
                rest = ~again
                size = (end - first)[rest]
                bounds = np.concatenate([[0], np.cumsum(size)])
                source = np.repeat(first[rest] - bounds[:-1], size) + np.arange(bounds[-1])
                yield pa.RecordBatch.from_arrays(
                    [_longs(key[rest]), _longs(doc[rest]), _longs((where - first)[rest]), _longs((first - base)[rest]),
                     _longs((last - first)[rest]), blobs(texts.data[source], bounds)],
                    names=["key", "doc", "at", "first", "last", "bytes"],
                )

    return run


class _RangeLeast:
    """Least value of any range of an array."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        span = 1
        while span * 2 <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def over(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of positions begin..end, both included."""
        power = np.frexp((end - begin + 1).astype(np.float64))[1] - 1
        out = np.empty(len(begin), self.tables[0].dtype)
        for k in np.unique(power):
            use = power == k
            table = self.tables[k]
            out[use] = np.minimum(table[begin[use]], table[end[use] - (1 << int(k)) + 1])
        return out


def equal_strings(key, doc, at, first, last, data, bounds, length) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence numbers and starts of the strings that an earlier document has too, by induced sorting.

    ``data[bounds[i]:bounds[i + 1]]`` are the bytes of occurrence i from ``first`` on.
    """
    n = len(key)
    left = at - first
    # The sample: up to ``length`` bytes from each anchor on, zeros past the end of a text.
    source = (bounds[:-1] + left)[:, None] + np.arange(length)
    inside = source < bounds[1:, None]
    right = np.where(inside, data[np.minimum(source, len(data) - 1)], 0).astype(np.uint8)
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = right
    words = padded.view(">u8").astype(_U)
    order = np.lexsort([*words.T[::-1], key])
    group = np.cumsum(np.append(True, key[order][1:] != key[order][:-1]))  # in sorted order
    differ = right[order][1:] != right[order][:-1]
    lcp = np.zeros(n, np.int16)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    lcp[1:][group[1:] != group[:-1]] = -1
    found_rows, found_starts = [], []
    level = 0
    far = np.int64(np.iinfo(np.int64).max)
    while len(order):
        start = at[order] - level
        is_string = (start >= first[order]) & (start <= last[order])
        alone = lcp < length
        begin = np.flatnonzero(np.append(True, alone[1:]))
        least = np.minimum.reduceat(np.where(is_string, doc[order], far), begin)
        interval = np.cumsum(np.append(True, alone[1:])) - 1
        covered = is_string & (doc[order] > least[interval])
        found_rows.append(order[covered])
        found_starts.append(start[covered])
        # Induce the next level: sort (byte before, rank), within the gram.
        on = np.flatnonzero(left[order] > level)
        if not len(on):
            break
        level += 1
        before = data[(bounds[:-1] + left)[order[on]] - level].astype(np.int64)
        by = np.argsort(group[on] * 256 + before, kind="stable")
        rank = on[by]
        new_group, new_before = group[rank], before[by]
        alike = (new_group[1:] == new_group[:-1]) & (new_before[1:] == new_before[:-1])
        new_lcp = np.full(len(rank), -1, np.int16)
        pairs = np.flatnonzero(alike) + 1
        if len(pairs):
            new_lcp[pairs] = _RangeLeast(lcp).over(rank[pairs - 1] + 1, rank[pairs]) + 1
        order, group, lcp = order[rank], new_group, new_lcp
    return np.concatenate(found_rows) if found_rows else np.zeros(0, np.int64), (
        np.concatenate(found_starts) if found_starts else np.zeros(0, np.int64)
    )


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of covered strings to (doc, first, end) of the byte runs they cover together."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], start[end] + length


def _span_batch(doc, first, end) -> pa.RecordBatch:
    n = len(doc)
    route = mix(doc.astype(np.int64).view(_U))
    return pa.RecordBatch.from_arrays(
        [_longs(route), _longs(doc), _longs(first), _longs(end), pa.nulls(n, pa.binary())],
        names=["key", "doc", "first", "last", "bytes"],
    )


def sort_shard(length: int):
    """Sorted by key: contexts to covered runs; grams too common for a block send their strings on."""

    def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, at, first, last = (table.column(i).to_numpy() for i in range(5))
        texts = Texts(table.column(5).combine_chunks())
        rows, starts = equal_strings(key, doc, first + at, first, first + last, texts.data, texts.bounds, length)
        if len(rows):
            yield _span_batch(*_runs(doc[rows], starts, length))

    def send_on(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches(max_chunksize=5000):
            doc, first, last = (batch.column(i).to_numpy() for i in (1, 3, 4))
            texts = Texts(batch.column(5))
            count = last + 1
            stop = np.cumsum(count)
            k = np.arange(stop[-1]) - np.repeat(stop - count, count)
            begin = np.repeat(texts.bounds[:-1], count) + k
            key = Hashes(texts.data).of(begin, begin + length)
            source = (begin[:, None] + np.arange(length)).ravel()
            start = np.repeat(first, count) + k
            yield pa.RecordBatch.from_arrays(
                [_longs(key), _longs(np.repeat(doc, count)), _longs(start), _longs(start + length),
                 blobs(texts.data[source], np.arange(stop[-1] + 1) * length)],
                names=["key", "doc", "first", "last", "bytes"],
            )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows, crowded = 0, None
        for batch in batches:
            done = batch.filter(batch.column(5).is_null())
            if len(done):
                yield _span_batch(*(done.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4)))
            batch = batch.filter(batch.column(5).is_valid())
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            if crowded is not None:
                more = int(np.searchsorted(key, crowded, side="right"))
                if more:
                    yield from send_on(pa.Table.from_batches([batch.slice(0, more)]))
                    batch, key = batch.slice(more), key[more:]
                if not len(batch):
                    continue
                crowded = None
            waiting.append(batch)
            rows += len(batch)
            if rows < BLOCK_ROWS:
                continue
            # All but the last gram, which may go on, make a block.
            table = pa.Table.from_batches(waiting)
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield from finish(table.slice(0, cut))
            tail = table.slice(cut)
            if len(tail) > GRAM_ROWS:
                crowded = keys[-1]
                yield from send_on(tail)
                waiting, rows = [], 0
            else:
                waiting, rows = tail.to_batches(), len(tail)
        if rows:
            yield from finish(pa.Table.from_batches(waiting))

    return run


def match_strings(length: int):
    """Sorted by key and doc: single strings to covered runs; what is a run already passes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, owners = None, {}
        for batch in batches:
            done = batch.filter(batch.column(4).is_null())
            if len(done):
                yield done.select([1, 2, 3])
            rows = batch.filter(batch.column(4).is_valid())
            doc, start = [], []
            for key, d, s, string in zip(*(rows.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != held_key:
                    held_key, owners = key, {}
                if owners.setdefault(string, d) < d:
                    doc.append(d)
                    start.append(s)
            if doc:
                d, f, e = _runs(np.array(doc, np.int64), np.array(start, np.int64), length)
                yield pa.RecordBatch.from_arrays([_longs(d), _longs(f), _longs(e)], names=["doc", "first", "last"])

    return run


_DEDUPED = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_column():
    """A column function: (packed text, runs as two lists) to counts and the bytes that are left, null for a null text."""

    @tidy
    def remove(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, firsts, lasts in batches:
            counts, kept, at = [], [], 0
            for part in small_slices(_unpack(text)):
                texts = Texts(part)
                lists = [x.slice(at, len(part)) for x in (firsts, lasts)]
                at += len(part)
                change = np.zeros(len(texts.data) + 1, np.int64)
                for spans, sign in zip(lists, (1, -1)):
                    row, values = _flat(spans)
                    np.add.at(change, np.minimum(texts.bounds[row] + values, texts.bounds[row + 1]), sign)
                gone = np.cumsum(change)[:-1] > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edge = texts.edges()[0]
                opens[edge] = gone[edge]
                removed = texts.per_row(gone)
                sizes = np.diff(texts.bounds)
                counts.append((sizes, removed, texts.per_row(opens)))
                kept.append(blobs(texts.data[~gone], np.concatenate([[0], np.cumsum(sizes - removed)])))
            columns = [np.concatenate([c[i] for c in counts]) if counts else np.zeros(0, np.int64) for i in range(3)]
            left = pa.concat_arrays(kept) if kept else pa.array([], pa.binary())
            left = pc.if_else(text.is_valid(), left, pa.scalar(None, pa.binary()))
            yield pa.StructArray.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], left],
                names=["n_bytes", "n_removed", "n_spans", "kept"],
            )

    return F.arrow_udf(remove, _DEDUPED).asNondeterministic()


def _lists(rows: DataFrame, prefix: str) -> DataFrame:
    """(doc, first, last) to one row for each document."""
    return rows.groupBy("doc").agg(F.collect_list("first").alias(f"{prefix}first"), F.collect_list("last").alias(f"{prefix}last"))


def suffix_dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50, into: str = "deduped"
) -> DataFrame:
    """Add ``into``: n_bytes, n_removed, n_spans and the bytes ``kept``, null where the text is null.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller id; all strings are judged on the input.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    named = base.filter("doc IS NOT NULL")
    cuts = named.mapInArrow(find_cuts(length), _CUTS).repartition("key").sortWithinPartitions("key", "rest", "doc")
    cuts = settled(_lists(cuts.mapInArrow(repeated_cuts, _SPANS), "__cut_"), "cuts")
    anchors = named.mapInArrow(find_anchors(length), _ANCHORS)
    shared = anchors.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(keep_shared, _SHARED)
    shared = settled(shared.groupBy("doc").agg(F.collect_list("anchor").alias("__anchors")), "anchors")

    packed = docs.withColumn("__packed", F.arrow_udf(_pack_batch, "binary")(F.col(text).cast("string")))
    none, few = "CAST(array() AS ARRAY<BIGINT>)", "CAST(array() AS ARRAY<INT>)"

    def beside(left: DataFrame, rows: DataFrame) -> DataFrame:
        right = rows.withColumnRenamed("doc", "__doc")
        return left.join(right, left[doc_id].cast("long") == right["__doc"], "left").drop("__doc")

    wanted = beside(packed.select(doc_id, "__packed"), shared.join(cuts, "doc", "left")).select(
        F.col(doc_id).cast("long"), F.col("__packed"), F.expr(f"coalesce(__anchors, {few})"),
        F.expr(f"coalesce(__cut_first, {none})"), F.expr(f"coalesce(__cut_last, {none})"),
    )
    contexts = wanted.mapInArrow(cut_contexts(length), _CONTEXTS)
    runs = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(sort_shard(length), _ROUTED)
    runs = runs.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(match_strings(length), _SPANS)
    found = settled(_lists(runs, "__").join(cuts, "doc", "full"), "runs")
    discard(shared, cuts)
    ends = f"transform(coalesce(__cut_last, {none}), x -> x + {length})"
    out = remove_column()(
        F.col("__packed"),
        F.expr(f"concat(coalesce(__first, {none}), coalesce(__cut_first, {none}))"),
        F.expr(f"concat(coalesce(__last, {none}), {ends})"),
    )
    return beside(packed, found).withColumn(into, out).drop("__packed", "__first", "__last", "__cut_first", "__cut_last")


def valid_text(column: str) -> Column:
    """The text of UTF-8 bytes, without bytes that are no whole character."""

    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in batch.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(F.col(column))
