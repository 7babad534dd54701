"""Byte-level BPE: encoding with offsets, and decoding.

Contract of edge cases: a null or empty text has no tokens; any bytes decode to
exactly what was encoded; control strings of a vocabulary are ordinary text.
Rows are handled one by one, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import Texts, blobs, distinct_slices, small_slices, tidy
from .pretokens import piece_bounds

#: Pieces whose ids a worker remembers, twice: a full memory becomes the older one, whose
#: pieces are taken over when they come again.
CACHE_PIECES = 200_000
#: Pieces of at most so many bytes are merged side by side, longer ones by a heap.
BATCH_BYTES = 48
#: Places for pieces of up to ``WORD_BYTES`` bytes whose ids are looked up all at once.
PIECE_SLOTS, WORD_BYTES = 1 << 20, 15

ENCODED = "ids binary, ends binary"
_loaded: dict[str, "Vocabulary"] = {}


class PairTable:
    """Which pairs of ids join into which id, as an open hash table in arrays."""

    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, rank: dict[bytes, int]):
        lefts, rights, joined = [], [], []
        for whole, r in rank.items():
            for cut in range(1, len(whole)):
                a, b = rank.get(whole[:cut]), rank.get(whole[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    joined.append(r)
        self.none = np.int32(len(rank) + 1)  # larger than every id: no such pair
        self.bytes = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        key = (np.array(lefts, np.uint64) << np.uint64(32)) | np.array(rights, np.uint64)
        self.bits = np.uint64(64 - max(4, int(4 * len(key)).bit_length()))
        size = 1 << int(np.uint64(64) - self.bits)
        self.keys = np.full(size + 64, 1 << 63, np.uint64)
        self.ids = np.full(size + 64, self.none, np.int32)
        left, value, slot = key, np.array(joined, np.int32), self._slot(key)
        while len(left):
            free = self.keys[slot] == np.uint64(1 << 63)
            _, winner = np.unique(np.where(free, slot, -1), return_index=True)
            winner = winner[free[winner]]
            self.keys[slot[winner]], self.ids[slot[winner]] = left[winner], value[winner]
            rest = np.ones(len(left), bool)
            rest[winner] = False
            left, value, slot = left[rest], value[rest], slot[rest] + 1
        # A key that is not in the table ends its search at a free place.

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * self._FACTOR) >> self.bits).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ids[slot], self.none)
        open_ = np.flatnonzero((there != key) & (there != np.uint64(1 << 63)))
        while len(open_):
            slot[open_] += 1
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.ids[slot[open_[hit]]]
            open_ = open_[~hit & (there != np.uint64(1 << 63))]
        return out

    def merge(self, raw: np.ndarray) -> list[bytes]:
        """Packed ids of pieces of one length (rows of bytes): each round joins every row's pair of lowest rank, the left one first."""
        n, width = raw.shape
        done: list[bytes] = [b""] * n
        row = np.arange(n)
        ids = self.bytes[raw]
        cost = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        # After k rounds a row that is still open has width - k parts.
        while len(row):
            at = cost.argmin(axis=1) if cost.shape[1] else np.zeros(len(row), np.int64)
            here = np.arange(len(row))
            low = cost[here, at] if cost.shape[1] else np.full(len(row), self.none)
            if (still := low < self.none).sum() < len(row):
                packed, size = ids[~still].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, r in enumerate(row[~still].tolist()):
                    done[r] = packed[k * size : k * size + size]
                row, ids, cost, at, low = row[still], ids[still], cost[still], at[still], low[still]
                here = here[: len(row)]
            if not len(row):
                break
            parts = ids.shape[1]
            ids[here, at] = low
            keep = np.arange(parts - 1) + (np.arange(parts - 1) > at[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            cost = np.take_along_axis(cost, keep[:, : parts - 2] if parts > 2 else keep[:, :0], 1)
            right, left = np.flatnonzero(at < parts - 2), np.flatnonzero(at > 0)
            cost[right, at[right]] = self.find(ids[right, at[right]], ids[right, at[right] + 1])
            cost[left, at[left] - 1] = self.find(ids[left, at[left] - 1], ids[left, at[left]])
        return done


class PieceTable:
    """Where the ids of short pieces lie in ``pool``, by the pieces' own bytes, as an open hash table in arrays.

    A table that is half full is forgotten when the next slice begins.
    """

    _MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self):
        self.bits = PIECE_SLOTS.bit_length() - 1
        self.low, self.high = np.zeros(PIECE_SLOTS, np.uint64), np.zeros(PIECE_SLOTS, np.uint64)
        self.first, self.count = np.zeros(PIECE_SLOTS, np.int32), np.zeros(PIECE_SLOTS, np.uint8)
        self.pool, self.used, self.filled = np.zeros(PIECE_SLOTS, np.uint32), 0, 0

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece as two words: its bytes, then its length, so that a place without a piece is zero."""
        load = np.ndarray((len(data) + 9,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        low = load[starts] & self._MASKS[np.minimum(lengths, 8)]
        high = load[np.minimum(starts + 8, len(data))] & self._MASKS[np.clip(lengths - 8, 0, 7)]
        return low, high | (np.minimum(lengths, WORD_BYTES + 1).astype(np.uint64) << np.uint64(56))

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = low * np.uint64(0xBF58476D1CE4E5B9) + high * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each piece, or -1."""
        slot = self._slot(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, slot, -1)
        on = np.flatnonzero(~hit & (there != 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) % len(self.high)
            there = self.high[slot]
            hit = (there == high[on]) & (self.low[slot] == low[on])
            out[on[hit]] = slot[hit]
            left = ~hit & (there != 0)
            on, slot = on[left], slot[left]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Different pieces that are not in the table."""
        self.filled += len(low)
        slot = self._slot(low, high)
        while len(low):
            free = np.flatnonzero(self.high[slot] == 0)
            taken, which = np.unique(slot[free], return_index=True)
            new = free[which]
            self.low[taken], self.high[taken] = low[new], high[new]
            self.first[taken], self.count[taken] = first[new], count[new]
            rest = np.ones(len(low), bool)
            rest[new] = False
            low, high, first, count = low[rest], high[rest], first[rest], count[rest]
            slot = (slot[rest] + 1) % len(self.high)

    def places(self, data: np.ndarray, bounds: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and where each piece between the bounds has its own and how many; ``encode`` gives new ones."""
        if 2 * self.filled > len(self.high):
            self.__init__()
        lengths = np.diff(bounds)
        low, high = self.words(data, bounds[:-1], lengths)
        slot = self.find(low, high)
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            pieces, sample, number = distinct_slices(data, bounds[new], bounds[new + 1])
            ids = encode(pieces)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            at = new[sample]
            stay = np.flatnonzero(lengths[at] <= WORD_BYTES)[: len(self.high) * 3 // 4 - self.filled]
            # What stays comes first; what lies behind it is written over by the next slice.
            goes = np.ones(len(ids), bool)
            goes[stay] = False
            order = np.concatenate([stay, np.flatnonzero(goes)])
            begin = np.empty(len(ids), np.int64)
            begin[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
            end = self.used + int(sizes.sum())
            if end > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * end - self.used, np.uint32)])
            self.pool[self.used : end] = np.frombuffer(b"".join([ids[i] for i in order.tolist()]), "<u4")
            first[new], count[new] = begin[number], sizes[number]
            self.add(low[at[stay]], high[at[stay]], begin[stay], sizes[stay])
            self.used += int(sizes[stay].sum())
        return self.pool, first, count


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 strings and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        strings = [b""] * size
        for s, r in self.rank.items():
            strings[r] = s
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(strings), np.uint8)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.whole = {s: r.to_bytes(4, "little") for s, r in self.rank.items()}
        self.pairs = PairTable(self.rank)
        self.table = PieceTable()

    @staticmethod
    def at(path: str) -> "Vocabulary":
        """One per worker and file: reading takes longer than encoding a batch."""
        if path not in _loaded:
            _loaded[path] = Vocabulary(path)
        return _loaded[path]

    def forget(self) -> None:
        """Drop what texts have taught: a worker that waits for its next task keeps the file's ranks alone."""
        self.known, self.older, self.table = {}, {}, PieceTable()

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece (little-endian uint32)."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, older, whole = self.known, self.older, self.whole
        out = [known.get(piece) for piece in pieces]
        new = [i for i, ids in enumerate(out) if ids is None]
        by_length: dict[int, list[int]] = {}
        for i in new:
            piece = pieces[i]
            if (one := whole.get(piece)) is not None or (one := older.get(piece)) is not None:
                out[i] = one
            elif len(piece) <= BATCH_BYTES:
                by_length.setdefault(len(piece), []).append(i)
            else:
                out[i] = self.merge_long(piece)
        for length, group in by_length.items():
            raw = np.frombuffer(b"".join([pieces[i] for i in group]), np.uint8).reshape(-1, length)
            for i, ids in zip(group, self.pairs.merge(raw)):
                out[i] = ids
        known.update((pieces[i], out[i]) for i in new if len(pieces[i]) <= BATCH_BYTES)
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Join the adjacent pair of lowest rank, the left one first, until none is left; n log n."""

        n, rank = len(piece), self.rank.get
        ends = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= n or not alive[j] or ends[j] != end:
                continue  # one side has grown since
            alive[j] = False
            ends[i] = end
            if end < n:
                left[end] = i
                if (r := rank(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := left[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : ends[i]]])
            i = ends[i]
        return np.array(out, "<u4").tobytes()


def flatten_ids(texts: Texts, encode, spare: int = 0, table: PieceTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other (uint32), and row bounds; ``spare`` places stay free after each row.

    ``table`` remembers what ``encode`` gave for short pieces of earlier slices.
    """
    if not len(texts.data):
        return np.zeros(spare * texts.rows, np.uint32), np.arange(texts.rows + 1, dtype=np.int64) * spare
    bounds = piece_bounds(texts)
    flat, first, n = (table or PieceTable()).places(texts.data, bounds, encode)
    ends = np.cumsum(n)
    taken = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
    before = np.concatenate([[0], ends])
    rows = before[np.searchsorted(bounds, texts.bounds)]
    if not spare:
        return flat[taken], rows
    shifted = rows + spare * np.arange(texts.rows + 1)
    out = np.zeros(shifted[-1], np.uint32)
    lengths = np.diff(rows)
    out[np.repeat(shifted[:-1] - rows[:-1], lengths) + np.arange(rows[-1])] = flat[taken]
    return out, shifted


def encode_column(path: str):
    """A column function: text to packed ids and packed byte ends of the tokens, both little-endian uint32."""

    @tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary.at(path)
        try:
            for batch in batches:
                ids, ends = [], []
                for part in small_slices(batch):
                    texts = Texts(part)
                    flat, rows = flatten_ids(texts, vocabulary.ids_of, table=vocabulary.table)
                    # Every byte is in exactly one token, so ends within a row are running lengths less the row's start.
                    stops = np.cumsum(vocabulary.lengths[flat])
                    stops -= np.repeat(texts.bounds[:-1], np.diff(rows))
                    ids.append(blobs(flat.view(np.uint8), rows * 4))
                    ends.append(blobs(stops.astype("<u4").view(np.uint8), rows * 4))
                yield pa.StructArray.from_arrays(
                    [pa.concat_arrays(ids) if ids else pa.array([], pa.binary()), pa.concat_arrays(ends) if ends else pa.array([], pa.binary())],
                    names=["ids", "ends"],
                )
        finally:
            vocabulary.forget()

    return F.arrow_udf(encode, ENCODED).asNondeterministic()


def decode_column(path: str):
    """A column function: packed ids and their packed byte ends to the bytes of the text.

    The ends say where each token's bytes go, so all tokens are placed at once.
    """

    @tidy
    def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary.at(path)
        for ids_batch, ends_batch in batches:
            out = []
            at = 0
            for part in small_slices(ids_batch):
                texts, stops = Texts(part), Texts(ends_batch.slice(at, len(part)))
                at += len(part)
                ids = texts.data.view("<u4") if len(texts.data) else np.zeros(0, np.uint32)
                ends = stops.data.view("<u4").astype(np.int64) if len(stops.data) else np.zeros(0, np.int64)
                per_row = np.diff(texts.bounds) // 4
                filled = np.flatnonzero(per_row)
                sizes = np.zeros(texts.rows, np.int64)
                sizes[filled] = ends[texts.bounds[1:][filled] // 4 - 1]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                lengths = vocabulary.lengths[ids]
                begin = ends - lengths + np.repeat(bounds[:-1], per_row)
                inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                data = np.empty(int(bounds[-1]), np.uint8)
                data[np.repeat(begin, lengths) + inside] = vocabulary.joined[np.repeat(vocabulary.starts[ids], lengths) + inside]
                out.append(blobs(data, bounds))
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return F.arrow_udf(decode, "binary").asNondeterministic()


def bpe_encode(docs: DataFrame, path: str, text: str | Column = "text", into: str = "bpe") -> DataFrame:
    """Add ``into``: a struct of ``ids`` and ``ends``, the tokens' ids and where each ends in the text's bytes.

    A narrow step.  Null texts have no tokens.
    """
    column = F.col(text) if isinstance(text, str) else text
    return docs.withColumn(into, encode_column(path)(column.cast("string")))


def bpe_decode(docs: DataFrame, path: str, encoded: str = "bpe", into: str = "decoded") -> DataFrame:
    """Add ``into``: the bytes that the tokens of ``encoded`` stand for."""
    return docs.withColumn(into, decode_column(path)(F.col(f"{encoded}.ids"), F.col(f"{encoded}.ends")))
