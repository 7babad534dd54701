"""SentencePiece BPE: encoding with spans in the original bytes, and decoding.

A text is normalised first: at every place the longest key of the model's compiled
character map that starts there is replaced, all places are looked up side by side, and
what each byte of the result came from is kept.  Spaces then become the models' visible
space (here: one byte, as no piece holds a plain one), pairs are merged by score, and the
alignment projects every piece back to the bytes of the text as it was given.

Contract of edge cases: a null or empty text has no ids and decodes to the empty text;
texts are whole; control pieces in a text are ordinary characters; a character without a
piece becomes byte pieces, of which the last one has its span and the others an empty
one at its start, or else the unknown piece.  Rows are handled one by one, so ties and
repeated rows need no rule.  Models other than BPE, and pieces that users defined or
that are unused, are an error.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, PairTable
from .bytewise import Texts, blobs, distinct_slices, small_slices, tidy
from .pretokens import code_points

ENCODED = "ids array<int>, starts array<int>, ends array<int>"
SPACE = 32
_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: What the library writes for the unknown piece.
_UNKNOWN_TEXT = " ⁇ "
#: Bytes of text handled at once, and words whose pieces a worker remembers, twice; four workers share an executor.
SLICE, CACHE_WORDS = 1 << 19, 100_000
_loaded: dict[str, "PieceModel"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """Keys and their replacements, as a double-array trie over bytes followed by texts that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0]
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = np.frombuffer(blob[4 + size :], np.uint8)
        zeros = np.flatnonzero(self.texts == 0)
        self.until = zeros[np.searchsorted(zeros, np.arange(len(self.texts)))] if len(self.texts) else zeros

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key at each place (0: none), and where its replacement starts."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        node = np.full(len(at), self._offset(self.units[:1])[0], np.int64)
        step = 0
        while len(live):
            live_on = at[live] + step < stop[live]
            live, node = live[live_on], node[live_on]
            byte = data[at[live] + step].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.units)
            live, node, byte = live[inside], node[inside], byte[inside]
            unit = self.units[node]
            goes = (unit & ((1 << 31) | 0xFF)) == byte
            live, node, unit = live[goes], node[goes], unit[goes]
            node = node ^ self._offset(unit)
            leaf = (unit >> 8) & 1 == 1
            step += 1
            length[live[leaf]] = step
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def replaced(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New bytes, the place in ``data`` that each came from, new bounds, and the places that did not become one space."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(at[1:], len(data))
        stop = bounds[np.searchsorted(bounds, at, side="right")]
        length, value = self.longest(data, at, stop)
        wide = np.flatnonzero(at + length > ends)
        taken = np.ones(len(at), bool)
        reach = 0
        for i in wide.tolist():  # only keys of several characters can overlap
            if taken[i]:
                reach = int(at[i] + length[i])
                taken[i + 1 : np.searchsorted(at, reach)] = False
        at, ends, length, value = at[taken], ends[taken], length[taken], value[taken]
        mapped = length > 0
        source = np.concatenate([data, self.texts])
        first = np.where(mapped, len(data) + value, at)
        size = np.where(mapped, self.until[value] - value, ends - at) if len(self.until) else ends - at
        total = np.cumsum(size)
        inside = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size)
        rows = np.concatenate([[0], total])[np.searchsorted(at, bounds)]
        one_space = (size == 1) & (source[np.minimum(first, len(source) - 1)] == SPACE)
        return source[np.repeat(first, size) + inside], np.repeat(at, size), rows, at[~one_space]


class PieceModel:
    """A model file's pieces, their scores and the rules of its normaliser."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        rules = dict(_fields(next((v for k, v in model if k == 3), b"")))
        self.names, scores, self.kinds = [], [], []
        for k, v in model:
            if k == 1:
                piece = dict(_fields(v))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
        if trainer.get(3, 1) != 2 or set(self.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or trainer.get(24, 0):
            raise ValueError("only BPE models of normal, byte and control pieces are read")
        if not rules.get(5, 1):
            raise ValueError("models that do not escape spaces are not read")
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte_ids = None
        if trainer.get(35, 0):
            self.byte_ids = [self.names.index(f"<0x{b:02X}>") for b in range(256)]

        self.scores, self.merging = scores, False
        strings = []
        for name, kind in zip(self.names, self.kinds):
            if kind == _BYTE:
                strings.append(bytes([int(name[3:5], 16)]))
            else:
                strings.append({_CONTROL: "", _UNKNOWN: _UNKNOWN_TEXT}.get(kind, name.replace(_MARK, " ")).encode())
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(strings), np.uint8)
        self.is_byte = np.array([k == _BYTE for k in self.kinds])
        self.opens_with_space = np.array([k == _NORMAL and s[:1] == b" " for k, s in zip(self.kinds, strings)])
        self.is_control = np.array([k == _CONTROL for k in self.kinds])

    def prepare(self) -> None:
        """The tables of merging, which a worker that only decodes does without."""
        if self.merging:
            return
        self.merging, scores = True, self.scores
        # Pieces in the order in which pairs are merged; equal scores share their cost.
        normal = sorted((i for i, k in enumerate(self.kinds) if k == _NORMAL), key=lambda i: (-scores[i], i))
        self.rank = {self.names[i].replace(_MARK, " ").encode(): r for r, i in enumerate(normal)}
        if " ".encode() not in self.rank:
            raise ValueError("the model has no piece for the space")
        n = len(normal)
        self.ids = np.array(normal, np.int64)
        self.sizes = np.array([len(self.names[i].replace(_MARK, " ").encode()) for i in normal], np.int64)
        steps = np.array([scores[i] for i in normal])
        cost = np.cumsum(np.concatenate([[0], steps[1:] < steps[:-1]])) if n else np.zeros(0, np.int64)
        every = dict(self.rank)
        for b in range(256):  # the pair table starts from bytes; these stand for bytes that are no piece
            every.setdefault(bytes([b]), len(every))
        self.pairs = PairTable(every)
        self.none = int(self.pairs.none)
        self.cost = np.full(self.none + 1, np.iinfo(np.int32).max, np.int32)
        self.cost[:n] = cost
        # Characters without a piece have numbers of their own beyond all pieces.
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(self.none + 1)
        for s, r in self.rank.items():
            if len(text := s.decode()) == 1:
                self.of_char[ord(text)] = r
        # Two characters that stand together in no piece are never joined, so words are cut between them.
        texts = [s.decode() for s in self.rank]
        signs = {c: i + 1 for i, c in enumerate(sorted({c for t in texts for c in t}))}
        self.sign = np.zeros(0x110000, np.int32)
        self.sign[[ord(c) for c in signs]] = list(signs.values())
        self.width = len(signs) + 1
        together = np.zeros((self.width, self.width), bool)
        together[0, 0] = True  # several without a piece can become one unknown piece
        for t in texts:
            for a, b in zip(t, t[1:]):
                together[signs[a], signs[b]] = True
        self.together = np.packbits(together.ravel())
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def at(path: str) -> "PieceModel":
        """One per worker and file."""
        if path not in _loaded:
            _loaded[path] = PieceModel(path)
        return _loaded[path]

    def normalised(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with plain spaces, their bounds, and the place in its row that each byte, then each row's end, came from."""
        data, bounds = texts.data, texts.bounds
        begin, stops = bounds[:-1].copy(), bounds[1:].copy()
        had = np.diff(bounds) > 0
        origin = np.arange(len(data))
        if self.map is not None:
            data, origin, bounds, heads = self.map.replaced(data, bounds)
        elif self.squeeze:
            heads = np.flatnonzero(data != SPACE)
        row = np.repeat(np.arange(texts.rows), np.diff(bounds))
        if self.squeeze:
            # Leading spaces go before the prefix is added; a row of nothing else has no text.
            ink = np.append(heads, len(texts.data))[np.searchsorted(heads, begin)]
            had &= ink < stops
            begin = np.where(had, ink, begin)
            space = data == SPACE
            opens = np.zeros(len(data), bool)
            opens[bounds[:-1][np.diff(bounds) > 0]] = True
            after = np.zeros(len(data), bool)
            after[1:] = space[:-1]
            keep = ~(space & (opens | after))
            data, origin, row = data[keep], origin[keep], row[keep]
            last = np.ones(len(data), bool)
            last[:-1] = row[1:] != row[:-1]
            tail = last & (data == SPACE)
            stops[row[tail]] = origin[tail]
            data, origin, row = data[~tail], origin[~tail], row[~tail]
            # Without other text the prefix would be a trailing space as well.
            had &= np.bincount(row, minlength=texts.rows) > 0
            stops = np.where(had, stops, begin)
        # The visible space is a space like any other.
        if (data == 0xE2).any():
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            if mark.any():
                data = np.where(mark, np.uint8(SPACE), data)
                gone = np.zeros(len(data), bool)
                gone[1:] |= mark[:-1]
                gone[2:] |= mark[:-2]
                data, origin, row = data[~gone], origin[~gone], row[~gone]
        sizes = np.bincount(row, minlength=texts.rows)
        if self.prefix and had.any():
            place = np.cumsum(sizes) - sizes
            opened = np.flatnonzero(had)
            data = np.insert(data, place[opened], SPACE)
            origin = np.insert(origin, place[opened], begin[opened])
            sizes[opened] += 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        # One more entry a row: where its end came from.
        align = np.insert(origin, bounds[1:], stops)
        row = np.repeat(np.arange(texts.rows), sizes + 1)
        return data, bounds, align - texts.bounds[:-1][row]

    def pieces_of(self, words: list[bytes], ranks: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Packed (id, bytes) pairs of each word, whose characters' numbers are ranks[first : first + count]."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = [known.get(w) for w in words]
        new = [i for i, found in enumerate(out) if found is None]
        by_length: dict[int, list[int]] = {}
        for i in new:
            if (one := older.get(words[i])) is not None:
                out[i] = one
            elif count[i] <= BATCH_BYTES:
                by_length.setdefault(int(count[i]), []).append(i)
            else:
                out[i] = self._packed(self._merge_long(ranks[first[i] : first[i] + count[i]].tolist()))
        for length, group in by_length.items():
            rows = ranks[first[group][:, None] + np.arange(length)].astype(np.int64)
            for i, packed in zip(group, self._merge(rows)):
                out[i] = packed
        known.update((words[i], out[i]) for i in new if len(words[i]) <= 4 * BATCH_BYTES)
        return out

    def _merge(self, ids: np.ndarray) -> list[bytes]:
        """Packed pairs of rows of character numbers: each round joins every row's pair of least cost, the left one first."""
        done: list[bytes] = [b""] * len(ids)
        row = np.arange(len(ids))
        joined = self._find(ids[:, :-1], ids[:, 1:])
        while len(row):
            cost = self.cost[joined]
            at = cost.argmin(axis=1) if cost.shape[1] else np.zeros(len(row), np.int64)
            here = np.arange(len(row))
            low = joined[here, at] if cost.shape[1] else np.full(len(row), self.none)
            still = low < self.none
            if not still.all():
                for r, packed in zip(row[~still].tolist(), self._packed_rows(ids[~still])):
                    done[r] = packed
            row, ids, joined, at, low = row[still], ids[still], joined[still], at[still], low[still]
            if not len(row):
                break
            here, parts = here[: len(row)], ids.shape[1]
            ids[here, at] = low
            keep = np.arange(parts - 1) + (np.arange(parts - 1) > at[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            joined = np.take_along_axis(joined, keep[:, : parts - 2], 1)
            right, left = np.flatnonzero(at < parts - 2), np.flatnonzero(at > 0)
            joined[right, at[right]] = self._find(ids[right, at[right]], ids[right, at[right] + 1])
            joined[left, at[left] - 1] = self._find(ids[left, at[left] - 1], ids[left, at[left]])
        return done

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.find(a.ravel(), b.ravel()).astype(np.int64).reshape(a.shape)

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        """The same for one long word, by a heap; n log n."""
        n = len(ids)
        text: list[bytes | None] = [None] * n
        by_rank = list(self.rank)
        for i, r in enumerate(ids):
            text[i] = by_rank[r] if r < len(by_rank) else None
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and text[i] is not None and text[j] is not None:
                whole = text[i] + text[j]
                if (r := self.rank.get(whole)) is not None:
                    heapq.heappush(heap, (int(self.cost[r]), i, r, whole))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, r, whole = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or text[j] is None or len(text[i]) + len(text[j]) != len(whole):
                continue  # one side has grown since
            ids[i], text[i], alive[j], after[i] = r, whole, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([r for i, r in enumerate(ids) if alive[i]], np.int64)

    def _packed_rows(self, rows: np.ndarray) -> list[bytes]:
        if (rows >= self.none).any():
            return [self._packed(parts) for parts in rows]
        raw = np.stack([self.ids[rows], self.sizes[rows]], 2).astype("<u4").tobytes()
        size = 8 * rows.shape[1]
        return [raw[k : k + size] for k in range(0, len(raw), size)]

    def _packed(self, parts: np.ndarray) -> bytes:
        """(id, bytes) pairs of numbers; characters without a piece go as bytes, or as one unknown piece."""
        pairs: list[list[int]] = []
        for r in parts.tolist():
            if r < self.none:
                pairs.append([int(self.ids[r]), int(self.sizes[r])])
                continue
            raw = chr(r - self.none - 1).encode()
            if self.byte_ids is not None:
                pairs += [[self.byte_ids[b], 0] for b in raw]
                pairs[-1][1] = len(raw)
            elif pairs and pairs[-1][0] == self.unknown:
                pairs[-1][1] += len(raw)
            else:
                pairs.append([self.unknown, len(raw)])
        return np.array(pairs, "<u4").tobytes()

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, where each starts and ends in its row's bytes, and row bounds."""
        self.prepare()
        data, bounds, align = self.normalised(texts)
        if not len(data):
            none = np.zeros(0, np.int32)
            return none, none, none, np.zeros(texts.rows + 1, np.int64)
        at, value = code_points(data)
        opens = np.zeros(len(at), bool)
        opens[np.searchsorted(at, bounds[:-1][np.diff(bounds) > 0])] = True
        sign = self.sign[value]
        pair = sign[:-1] * np.int64(self.width) + sign[1:]
        opens[1:] |= (self.together[pair >> 3] >> (7 - (pair & 7)).astype(np.uint8)) & 1 == 0
        starts = at[opens]
        ends = np.append(starts[1:], len(data))
        words, sample, number = distinct_slices(data, starts, ends)
        first = np.searchsorted(at, starts[sample])
        packed = self.pieces_of(words, self.of_char[value], first, np.searchsorted(at, ends[sample]) - first)
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
        flat = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
        begin = np.cumsum(counts) - counts
        n = counts[number]
        upto = np.cumsum(n)
        taken = flat[np.repeat(begin[number] - (upto - n), n) + np.arange(upto[-1])]
        rows = np.concatenate([[0], upto])[np.searchsorted(starts, bounds)]
        stop = np.cumsum(taken[:, 1], dtype=np.int64)
        start = stop - taken[:, 1]
        row = np.repeat(np.arange(texts.rows), np.diff(rows))
        # An empty byte piece lies at its character's start, so both of its ends do.
        return (
            taken[:, 0].astype(np.int32),
            align[start + row].astype(np.int32),
            align[stop + row].astype(np.int32),
            rows,
        )

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' texts and their bounds."""
        lengths = self.lengths[ids]
        first = self.starts[ids]
        if self.prefix or self.squeeze:
            # The space in front of the first piece that is no control piece is not part of the text.
            shown = np.flatnonzero(~self.is_control[ids])
            lead = np.searchsorted(shown, rows[:-1])
            lead = shown[lead[(lead < len(shown))]] if len(shown) else shown
            lead = np.unique(lead)
            lead = lead[self.opens_with_space[ids[lead]]]
            lengths = lengths.copy()
            first = first.copy()
            lengths[lead] -= 1
            first[lead] += 1
        total = np.cumsum(lengths)
        inside = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - lengths, lengths)
        data = self.joined[np.repeat(first, lengths) + inside]
        bounds = np.concatenate([[0], total])[rows]
        if not self.is_byte[ids].any():
            return data, bounds
        # Byte pieces need not make characters.
        out, raw = [], data.tobytes()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            out.append(_valid(raw[a:b]))
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _valid(raw: bytes) -> bytes:
    """UTF-8, with the replacement character for every byte that is not part of a character."""
    done = []
    while True:
        try:
            raw.decode()
        except UnicodeDecodeError as bad:
            done.append(raw[: bad.start] + "�".encode())
            raw = raw[bad.start + 1 :]
            continue
        return b"".join(done) + raw


def _lists(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values, pa.int32()))


def encode_column(path: str):
    """A column function: text to a struct of ids and of the byte positions where each piece starts and ends."""

    @tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = PieceModel.at(path)
        for batch in batches:
            parts = []
            for part in small_slices(batch, SLICE):
                *columns, rows = model.encode(Texts(part))
                parts.append(pa.StructArray.from_arrays([_lists(c, rows) for c in columns], names=["ids", "starts", "ends"]))
            empty = pa.StructArray.from_arrays([pa.array([], pa.list_(pa.int32()))] * 3, names=["ids", "starts", "ends"])
            yield pa.concat_arrays(parts) if parts else empty

    return F.arrow_udf(encode, ENCODED).asNondeterministic()


def decode_column(path: str):
    """A column function: ids to the text they stand for."""

    @tidy
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = PieceModel.at(path)
        for batch in batches:
            if isinstance(batch, pa.ChunkedArray):
                batch = batch.combine_chunks()
            batch = batch.fill_null([]) if batch.null_count else batch
            offsets = np.asarray(batch.offsets).astype(np.int64)
            ids = np.asarray(batch.values)[offsets[0] : offsets[-1]]
            data, bounds = model.decode(ids, offsets - offsets[0])
            yield blobs(data, bounds, pa.string())

    return F.arrow_udf(decode, "string").asNondeterministic()


def piece_encode(docs: DataFrame, path: str, text: str | Column = "text", into: str = "pieces") -> DataFrame:
    """Add ``into``: a struct of ``ids``, ``starts`` and ``ends`` (positions in the text's bytes).  A narrow step."""
    column = F.col(text) if isinstance(text, str) else text
    return docs.withColumn(into, encode_column(path)(column.cast("string")))


def piece_decode(docs: DataFrame, path: str, ids: str = "pieces.ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the text of a column of ids; null for none."""
    return docs.withColumn(into, decode_column(path)(F.col(ids)))
