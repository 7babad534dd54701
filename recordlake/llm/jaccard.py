"""Documents linked by the Jaccard similarity of their word shingles, without missing a link.

1. Texts become sets of shingle hashes (64 bits).  Texts of one set are a class; its
   smallest id stands for it.
2. Candidates.  Two sets that link differ in at most D shingles, where D follows from
   their sizes.  Shingles are dealt into K > D parts, of which K - D at least are the
   same in both.  So a document that shares fewer of its parts, by hash, with others has
   no link; and of the others each may leave out all but one of the K - D parts it must
   share, the last ones by hash, and still meets every partner in a part.  Sizes fall
   into bands with a number of parts each; a set also uses the next band's parts if a
   partner may be there.  Empty parts do not count, unless so many are empty that no
   other part has to agree.
3. Documents that meet, directly or through others, form a cluster; links never leave it.
   Parts of many documents tie clusters together that hold no common link, the more the
   larger the table.  So in a cluster of more than one block shingles are put in the order
   of how many of its documents have them: of two sets that link, the first common shingle
   is among the rarest of both, those that do not fit into the overlap they need.  Members
   that share one of these meet anew, and the others have no link.
4. T-occurrence search inside clusters, in blocks of bounded size.  A set's needed
   overlap T is at least 85 % of its size.  Its longest inverted lists are set aside,
   the short ones merged, and documents that occur often enough there are probed in the
   long lists by binary search (DivideSkip).  Whoever is found joins the component and
   is searched in turn among those not yet found.
5. Blocks of one cluster are joined by their components' first documents, and if
   several components are left, all documents outside the largest are searched in every
   block of sizes that can link; blocks hold sets of one class of sizes.

Contract of edge cases: a null text, or one without words, has no shingles and is its
own component; under four words the whole sequence is one shingle; a null id has a null
component; a document id names one text, repeated rows of it get the same values; texts
are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import discard
from .bytewise import Hashes, Texts, lower_ascii, mix, small_slices, tidy
from .components import components
from .session import passing_shuffles, settled

#: Shingles in a block of the T-occurrence search.
BLOCK_SHINGLES = 600_000
#: A block's number: its class of set sizes above, its place among the class's blocks in so many lower bits.
CLASS_BITS = 40
#: Documents from which on shingles count as equally common: rows of one shingle that are held until they are counted.
COMMON = 1 << 12
_U = np.uint64
#: Parts travel by 48 bits: another part under the same ones costs work only, as sets are compared.
_SPARE = _U(16)
_ODD = _U(0x9E3779B97F4A7C15)
#: Growth of size bands, and parts beyond the least number of them.
_GROWTH, _SLACK = 1.5, 0.35


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after the other, and row bounds."""
    data = lower_ascii(texts.data)
    starts, ends = texts.words()
    bounds = np.searchsorted(starts, texts.bounds)
    words = Hashes(data).of(starts, ends) if len(starts) else np.zeros(0, _U)
    n = np.diff(bounds)
    whole = np.maximum(len(words) - size + 1, 0)
    value = words[:whole]
    for k in range(1, size):
        value = mix(value * _ODD + words[k : k + whole])
    row = np.repeat(np.arange(texts.rows), n)
    at = np.arange(whole)
    full = at + size <= bounds[1:][row[:whole]]
    value, row = value[full], row[:whole][full]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        few = []
        for r in short.tolist():
            v = _U(n[r])
            for w in words[bounds[r] : bounds[r + 1]]:
                v = mix(np.array([v], _U) * _ODD + w)[0]
            few.append(v)
        value, row = np.concatenate([value, np.array(few, _U)]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(texts.rows + 1))


class Bands:
    """Size bands and the numbers of parts that sets of each are dealt into."""

    def __init__(self, percent: int):
        self.percent = percent
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * _GROWTH) + 1))
        self.lows = np.array(lows, np.int64)
        highs = np.append(self.lows[1:] - 1, 1 << 41)
        # |x ^ y| <= (100 - p) / 100 * |x u y| and 2 |x u y| = |x| + |y| + |x ^ y|.
        self.differ = ((2 * highs) * (100 - percent)) // (100 + percent)
        self.parts = self.differ + 1 + np.ceil(_SLACK * self.differ).astype(np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def largest_partner(self, sizes: np.ndarray) -> np.ndarray:
        return sizes * 100 // self.percent


def part_hashes(value: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tag, hash) of each set's parts; a tag is the band and how many parts the set must share at least."""
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes)
    own = bands.of(sizes[rows])
    next_too = bands.largest_partner(sizes[rows]) >= bands.lows[own + 1]
    set_row = np.concatenate([rows, rows[next_too]])
    band = np.concatenate([own, own[next_too] + 1])
    if not len(set_row):
        return set_row, set_row, np.zeros(0, _U)
    parts = bands.parts[band]
    first = np.cumsum(parts) - parts
    size = sizes[set_row]
    source = np.repeat(bounds[set_row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    shingle = value[source]
    part = np.repeat(first, size) + (mix(shingle ^ _U(0x5851F42D4C957F2D)) % np.repeat(parts, size).astype(_U)).astype(np.int64)
    total = int(parts.sum())
    count = np.bincount(part, minlength=total)
    order = np.argsort(part, kind="stable")
    filled = np.flatnonzero(count)
    sums = np.zeros(total, _U)
    sums[filled] = np.add.reduceat(mix(shingle[order] + _ODD), (np.cumsum(count) - count)[filled])
    of_set = np.repeat(np.arange(len(set_row)), parts)
    empty = count == 0
    must = parts - bands.differ[band] - np.bincount(of_set[empty], minlength=len(set_row))
    # Where empty parts alone may agree, they are sent too, and any one of the parts will do.
    use = ~empty | (must < 1)[of_set]
    number = np.arange(total) - first[of_set]
    key = mix(sums ^ mix(band[of_set].astype(_U) * _U(1 << 40) + number.astype(_U) + (count.astype(_U) << _U(20)) * _ODD))
    tag = (band << 40) + np.maximum(must, 1)
    return set_row[of_set[use]], tag[of_set[use]], key[use] >> _SPARE


def _ids_and_texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Texts]]:
    at = 0
    for part in small_slices(batch.column(1)):
        yield batch.column(0).slice(at, len(part)), Texts(part)
        at += len(part)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == _U else values, pa.int64())


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, _U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def set_summaries(size: int):
    """(doc, text) to doc, n_shingles and two hashes of the whole set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _ids_and_texts(batch):
                value, bounds = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [ids, _longs(np.diff(bounds)), _longs(_sums(mix(value), bounds)), _longs(_sums(mix(value ^ _ODD), bounds))],
                    names=["doc", "n_shingles", "h1", "h2"],
                )

    return run


def find_parts(size: int, percent: int):
    """(doc, text) to (key, doc, tag, null) for each part of a document.

    Of a slice's documents that share a part, one row without a tag travels for all, so
    a common part is sent once for each slice; that they share it is known already, and
    they travel as (spread key, doc, tag, part).
    """
    bands = Bands(percent)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _ids_and_texts(batch):
                row, tag, key = part_hashes(*shingle_sets(texts, size), bands)
                doc = ids.to_numpy(zero_copy_only=False)[row].astype(np.int64)
                order = np.lexsort((doc, key))
                new = np.ones(len(key), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                begin = np.flatnonzero(new)
                several = np.diff(np.append(begin, len(key))) > 1
                lead, shared = order[begin], np.repeat(several, np.diff(np.append(begin, len(key))))
                by_doc = np.argsort(doc[lead], kind="stable")  # alike rows together take less room
                lead, several = lead[by_doc], several[by_doc]
                yield pa.RecordBatch.from_arrays(
                    [_longs(key[lead]), _longs(doc[lead]), _longs(np.where(several, -1, tag[lead])), pa.nulls(len(lead), pa.int64())],
                    names=["key", "doc", "tag", "part"],
                )
                if shared.any():
                    known = order[shared]
                    yield pa.RecordBatch.from_arrays(
                        [_longs(mix(key[known] ^ mix(doc[known].view(_U))) >> _SPARE), _longs(doc[known]), _longs(tag[known]), _longs(key[known])],
                        names=["key", "doc", "tag", "part"],
                    )

    return run


@tidy
def shared_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key: (doc, tag, part) of the parts that several documents, or slices, have."""
    held: tuple | None = None  # key, doc, tag of the last row, and whether its part is shared
    for batch in batches:
        known = batch.filter(batch.column(3).is_valid())
        if len(known):
            yield known.select([1, 2, 3])
        rows = batch.filter(batch.column(3).is_null())
        if not len(rows):
            continue
        key, doc, tag = (rows.column(i).to_numpy() for i in range(3))
        told = False
        if held is not None:
            key, doc, tag = np.append(held[0], key), np.append(held[1], doc), np.append(held[2], tag)
            told = held[3]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        shared = np.repeat(size > 1, size)
        if told:
            shared[: size[0]] = True
        out = shared & (tag >= 0)
        if held is not None and told:
            out[0] = False
        held = (key[-1], doc[-1], tag[-1], bool(shared[-1]))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(tag[out]), pa.array(key[out])], names=["doc", "tag", "part"])


@tidy
def meet_in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc) to (part, first doc, null) once for a batch, and its meetings as (spread key, first doc, doc)."""
    for batch in batches:
        if not len(batch):
            continue
        key, doc = (batch.column(i).to_numpy() for i in range(2))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        least = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(key))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[new]), pa.array(doc[new]), pa.nulls(int(new.sum()), pa.int64())], names=["key", "doc", "other"]
        )
        met = doc != least
        if met.any():
            pair = np.unique(np.stack([least[met], doc[met]], axis=1), axis=0)
            first, other = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
            yield pa.RecordBatch.from_arrays([_longs(mix(other.view(_U))), _longs(first), _longs(other)], names=["key", "doc", "other"])


@tidy
def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key and doc: each document with the first one of its key, once for each batch."""
    held_key = held_doc = None
    for batch in batches:
        out = [np.zeros((0, 2), np.int64)]
        other = batch.filter(batch.column(2).is_valid())
        if len(other):
            out.append(np.stack([other.column(1).to_numpy(), other.column(2).to_numpy()], axis=1))
        rows = batch.filter(batch.column(2).is_null())
        if len(rows):
            key, doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = doc[new]
            if held_key is not None and key[0] == held_key:
                first[0] = held_doc
            least = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(key))))
            held_key, held_doc = key[-1], least[-1]
            out.append(np.stack([least, doc], axis=1)[least != doc])
        pairs = np.unique(np.concatenate(out), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"]
            )


def member_sets(size: int):
    """(doc, text, cluster) to its set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in _ids_and_texts(batch):
                value, bounds = shingle_sets(texts, size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _longs(value))
                cluster = batch.column(2).slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([ids, cluster, lists], names=["doc", "cluster", "shingles"])

    return run


@tidy
def cluster_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, cluster, shingles) to (key, doc) for each shingle, the key telling clusters apart."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
            value = part.column(2).flatten().to_numpy(zero_copy_only=False).view(_U)
            cluster = mix(part.column(1).to_numpy().view(_U))
            yield pa.RecordBatch.from_arrays(
                [_longs(mix(value ^ np.repeat(cluster, sizes))), _longs(np.repeat(part.column(0).to_numpy(), sizes))], names=["key", "doc"]
            )


@tidy
def common_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key: (doc, often, key) of the shingles that several documents have; ``often`` ends at ``COMMON``."""

    def told(key: np.ndarray, doc: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        use = often > 1
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(often[use], pa.int32()), pa.array(key[use])], names=["doc", "often", "key"])

    key = doc = np.zeros(0, np.int64)
    crowded = None
    for batch in batches:
        if not len(batch):
            continue
        key, doc = np.append(key, batch.column(0).to_numpy()), np.append(doc, batch.column(1).to_numpy())
        # All but the last shingle, which may go on.
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield from told(key[:cut], doc[:cut], _often(key[:cut], crowded))
        key, doc = key[cut:], doc[cut:]
        if len(key) >= COMMON or key[0] == crowded:
            yield from told(key, doc, np.full(len(key), COMMON))
            crowded, key, doc = key[0], key[:0], doc[:0]
    if len(key):
        yield from told(key, doc, _often(key, crowded))


def _often(key: np.ndarray, crowded: int | None) -> np.ndarray:
    """For each of sorted keys how many there are, ``COMMON`` at most."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    many = np.where(key[begin] == crowded, COMMON, np.minimum(size, COMMON)) if crowded is not None else np.minimum(size, COMMON)
    return np.repeat(many, size)


class Index:
    """Inverted lists over some sets: T-occurrence search by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        sizes = np.array([len(sets[m]) for m in members], np.int64)
        token = np.concatenate([sets[m] for m in members]) if len(members) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(token, kind="stable")  # members stay in order inside a list
        self.place = place[order]
        self.tokens, self.first = np.unique(token[order], return_index=True)
        self.stop = np.append(self.first[1:], len(token))
        self.sizes = sizes

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Places of the members whose overlap with the query reaches what the similarity needs."""
        at = np.searchsorted(self.tokens, query)
        inside = at < len(self.tokens)
        at = at[inside][self.tokens[at[inside]] == query[inside]]
        least = -(-percent * len(query) // 100)
        if len(at) < least:
            return np.zeros(0, np.int64)
        length = self.stop[at] - self.first[at]
        by = np.argsort(length, kind="stable")
        # The longer a list, the dearer its merge: up to least - 1 of the longest are probed instead.
        long_ = min(least - 1, int(0.8 * least))
        short, probed = at[by[: len(by) - long_]], at[by[len(by) - long_ :]]
        n = self.stop[short] - self.first[short]
        postings = self.place[np.repeat(self.first[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        count = np.bincount(postings, minlength=len(self.sizes))
        found = np.flatnonzero(count >= least - long_)
        overlap = count[found]
        for k, list_ in enumerate(probed.tolist()):
            if not len(found):
                break
            members = self.place[self.first[list_] : self.stop[list_]]
            slot = np.searchsorted(members, found)
            overlap = overlap + ((slot < len(members)) & (members[np.minimum(slot, len(members) - 1)] == found))
            if k % 16 == 15:
                able = overlap + (len(probed) - 1 - k) >= least
                found, overlap = found[able], overlap[able]
        union = len(query) + self.sizes[found] - overlap
        return found[100 * overlap >= percent * union]


def block_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first one that links reach."""
    n = len(sets)
    label = np.full(n, -1, np.int64)
    index = Index(sets, np.arange(n))
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            hits = index.members[index.linked(sets[queue.pop()], percent)]
            hits = hits[label[hits] < 0]
            label[hits] = seed
            queue.extend(hits.tolist())
            left = int((label[index.members] < 0).sum())
            if left * 2 < len(index.members):
                index = Index(sets, index.members[label[index.members] < 0])
                if not left:
                    break
    return label


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[pa.Table]:
    """Runs of equal key columns of a sorted stream, whole."""
    waiting: list[pa.RecordBatch] = []
    held = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy() for i in keys]
        new = np.zeros(len(batch), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = held is not None and tuple(c[0] for c in columns) != held
        at = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > at:
                waiting.append(batch.slice(at, cut - at))
            if waiting:
                yield pa.Table.from_batches(waiting)
            waiting, at = [], cut
        waiting.append(batch.slice(at))
        held = tuple(c[-1] for c in columns)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    joined = column.combine_chunks()
    offsets, values = joined.offsets.to_numpy(), joined.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def search_blocks(percent: int):
    """Sorted by (cluster, block): doc, cluster, block, shingles to (doc, cluster, label), the label an id of the block."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, (1, 2)):
            doc = table.column(0).to_numpy()
            label = doc[block_components(_lists(table.column(3)), percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(table.column(1).to_numpy()), pa.array(label)], names=["doc", "cluster", "label"]
            )

    return run


def search_across(percent: int):
    """Sorted by (cluster, block): doc, cluster, block, shingles, label, query to links (a, b) between labels."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, (1, 2)):
            sets, label, query = _lists(table.column(3)), table.column(4).to_numpy(), table.column(5).to_numpy(zero_copy_only=False)
            index = Index(sets, np.flatnonzero(~query))
            pairs = set()
            for q in np.flatnonzero(query).tolist():
                hits = label[index.members[index.linked(sets[q], percent)]]
                pairs.update((min(x, label[q]), max(x, label[q])) for x in np.unique(hits).tolist() if x != label[q])
            if pairs:
                a, b = zip(*sorted(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def jaccard_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach, for every row.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets.
    Steps are written, and what nothing reads any more goes.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    summaries = base.mapInArrow(set_summaries(size), "doc long, n_shingles long, h1 long, h2 long")
    summaries = settled(summaries, "sets")
    kinds = summaries.filter("n_shingles > 0 AND doc IS NOT NULL").groupBy("n_shingles", "h1", "h2")
    first = kinds.agg(F.min("doc").alias("first"))

    parts = base.filter("doc IS NOT NULL").mapInArrow(find_parts(size, percent), "key long, doc long, tag long, part long")
    shared = parts.repartition("key").sortWithinPartitions("key").mapInArrow(shared_parts, "doc long, tag long, part long")
    must = F.expr("CAST(pmod(tag, 1L << 40) AS INT)")
    own = shared.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("part")).alias("parts")).withColumn("must", must)
    own = settled(own.filter("size(parts) >= must").select("doc", F.expr("slice(parts, 1, size(parts) - must + 1)").alias("parts")), "parts")
    clusters = _met(own.select(F.explode("parts").alias("part"), "doc"))
    discard(own)

    # One document of each set, with the clusters that hold several sets.
    alone = summaries.join(first, ["n_shingles", "h1", "h2"]).filter("doc = first").select("doc", "n_shingles").distinct()
    clustered = settled(alone.join(clusters.toDF("doc", "cluster"), "doc"), "members")
    several = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("__docs")).filter("__docs > 1").drop("__docs")
    members = clustered.join(several, "cluster")
    # Members grow with the table, so they are never sent whole to every executor.
    sets = base.join(members.select("doc", "cluster").hint("merge"), "doc")
    sets = settled(sets.mapInArrow(member_sets(size), "doc long, cluster long, shingles array<long>"), "member-sets")
    wide = _sizes(members).filter("__blocks > 1").select("cluster")
    with passing_shuffles(docs.sparkSession):
        fits = wide.isEmpty()
    if fits:
        sets = sets.withColumn("block", F.lit(0).cast("long"))
    else:
        finer = _met_again(sets.join(wide, "cluster"), members, percent)
        members = members.join(wide, "cluster", "left_anti").unionByName(members.drop("cluster").join(finer, "doc"))
        whole, placed = sets, _placed(members, percent)
        sets = whole.drop("cluster").join(placed.hint("merge"), "doc").select("doc", "cluster", "shingles", "block")
        sets = settled(sets, "member-sets")
        discard(whole)
    sets = sets.select("doc", "cluster", "block", "shingles")
    searched = sets.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "doc")
    found = settled(searched.mapInArrow(search_blocks(percent), "doc long, cluster long, label long"), "found")

    labels = _join_blocks(sets, found, percent)
    final = labels.groupBy("label").agg(F.min("doc").alias("component_id"))
    by_doc = settled(labels.join(final, "label").select(F.col("doc").alias("first"), "component_id").distinct(), "components")
    discard(clustered, sets, found)
    rows = summaries.join(first, ["n_shingles", "h1", "h2"], "left").join(by_doc, "first", "left")
    return rows.select(
        F.col("doc").alias("doc_id"), "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "first", "doc")).alias("component_id")
    )


def _met(rows: DataFrame) -> DataFrame:
    """(key, doc) to the clusters of documents that have keys in common."""
    met = rows.mapInArrow(meet_in_batches, "key long, doc long, other long")
    return components(met.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(meetings, "a long, b long"))


def _met_again(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(doc, cluster) of the members of large clusters that meet by their rarest shingles, in clusters of their own."""
    keys = sets.select("doc", "cluster", "shingles").mapInArrow(cluster_shingles, "key long, doc long")
    common = keys.repartition("key").sortWithinPartitions("key").mapInArrow(common_shingles, "doc long, often int, key long")
    lists = common.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("often", "key"))).alias("common"))
    # A set's rarest shingles are those it has alone; they and the first common ones are as many as an overlap may lack, and one.
    lists = lists.join(members.select("doc", "n_shingles"), "doc")
    rarest = lists.withColumn("__n", F.expr(f"CAST(size(common) - ({percent} * n_shingles + 99) DIV 100 + 1 AS INT)")).filter("__n > 0")
    rarest = settled(rarest.select("doc", F.expr("slice(common.key, 1, __n)").alias("keys")), "rarest")
    clusters = settled(_met(rarest.select(F.explode("keys").alias("key"), "doc")).toDF("doc", "cluster"), "finer")
    discard(rarest)
    return clusters


def _sizes(members: DataFrame) -> DataFrame:
    """Clusters with the number of blocks that their sets fill."""
    amounts = members.groupBy("cluster").agg(F.sum("n_shingles").alias("__all"))
    return amounts.select("cluster", F.expr(f"1 + __all DIV {BLOCK_SHINGLES}").alias("__blocks"))


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """(doc, cluster, block) of the members of clusters."""
    # Sets link only if their sizes differ by less than a class, so large clusters are cut by class first.
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    of_size = F.expr(f"IF(__blocks > 1, CAST(floor(ln(n_shingles) / {step!r}D) AS BIGINT), 0L)")
    classed = members.join(_sizes(members), "cluster").withColumn("__class", of_size)
    per_class = classed.groupBy("cluster", "__class").agg(F.expr(f"1 + sum(n_shingles) DIV {BLOCK_SHINGLES}").alias("__in"))
    return classed.join(per_class, ["cluster", "__class"]).select(
        "doc", "cluster", F.expr(f"shiftleft(__class, {CLASS_BITS}) + pmod(xxhash64(doc), __in)").alias("block")
    )


def _join_blocks(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(doc, label) with one label for each component of a cluster, also across its blocks."""
    several = sets.groupBy("cluster").agg(F.countDistinct("block").alias("n")).filter("n > 1").select("cluster")
    wide = settled(found.join(several, "cluster"), "wide")
    plain = found.select("doc", "label")
    if wide.isEmpty():
        return plain
    # The first documents of all components of a cluster, searched as blocks of their own.
    pivots = wide.groupBy("cluster", "label").agg(F.min("doc").alias("doc"))
    of_class = F.shiftright("block", CLASS_BITS)
    chosen = sets.join(pivots, ["cluster", "doc"]).withColumn("__class", of_class)
    amount = chosen.groupBy("cluster", "__class").agg(F.sum(F.size("shingles")).alias("__all"))
    amount = amount.withColumn("__in", F.expr(f"1 + __all DIV {BLOCK_SHINGLES}"))
    chosen = chosen.join(amount, ["cluster", "__class"])
    chosen = chosen.withColumn("block", F.expr(f"shiftleft(__class, {CLASS_BITS}) + pmod(xxhash64(doc), __in)"))
    chosen = chosen.select("doc", "cluster", "block", "shingles", "label")
    grouped = chosen.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "doc")
    merged = grouped.select("doc", "cluster", "block", "shingles").mapInArrow(
        search_blocks(percent), "doc long, cluster long, label long"
    )
    links = merged.withColumnRenamed("label", "other").join(pivots.select("doc", "label"), "doc")
    links = links.join(pivots.select(F.col("doc").alias("other"), F.col("label").alias("other_label")), "other")
    labels = _relabel(wide, components(links.select(F.col("label").alias("a"), F.col("other_label").alias("b"))))
    labels = settled(labels, "labels")

    # Whatever is outside a cluster's largest component is searched in all its blocks of sizes that can link.
    counts = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("__n"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("__n", "label")).alias("__main"), F.count(F.lit(1)).alias("__labels"))
    main = main.filter("__labels > 1")
    open_ = sets.join(labels.select("doc", "label"), "doc").join(main, "cluster")
    blocks = open_.select("cluster", F.col("block").alias("__to")).distinct()
    columns = ["doc", "cluster", "block", "shingles", "label"]
    near = F.abs(F.shiftright("block", CLASS_BITS) - F.shiftright("__to", CLASS_BITS)) <= 1
    asked = open_.filter("label <> __main").join(blocks, "cluster").filter(near).withColumn("block", F.col("__to"))
    both = open_.select(*columns, F.lit(False).alias("query")).unionByName(asked.select(*columns, F.lit(True).alias("query")))
    ordered = both.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "query", "doc")
    more = ordered.mapInArrow(search_across(percent), "a long, b long")
    labels = _relabel(labels, components(more))
    rest = found.join(several, "cluster", "left_anti").select("doc", "label")
    return rest.unionByName(labels.select("doc", "label"))


def _relabel(rows: DataFrame, merged: DataFrame) -> DataFrame:
    renamed = rows.join(merged.toDF("label", "__new"), "label", "left")
    return renamed.select("doc", "cluster", F.coalesce("__new", "label").alias("label"))
