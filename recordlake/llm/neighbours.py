"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it.

Equal vectors are one node, the smallest id its name, so a vector that is repeated any
number of times is searched once and its copies cannot crowd a neighbourhood.

1. First graph: for a few random sets of hyperplanes, nodes are sorted by their side of
   each and the distance to one more; runs of neighbours in that order are compared.
2. NN-descent rounds: each node sends its vector to the nodes it is near to, and to its
   own neighbours (joins of neighbours with neighbours); there all that have met are
   compared, unless both were there the round before, and whoever is nearer than a
   node's worst neighbour becomes one.
3. Search: a query starts at its own node and takes the neighbours of its best nodes,
   round by round.  The distances of the pool that is left are taken exactly.

Graph, search and scores work on the original numbers, as floats if they are floats and
else as doubles, so no two different vectors look alike and large ones leave the others'
distances as they are.  Matrix products only choose; a distance that is kept is summed
from differences, so every task finds the same one for a pair.  A node has ``degree`` neighbours and meets at most ``meet`` new and half as
many known others in a round, drawn by hash, as NN-descent works with bounded lists;
every node is in the graph and every one can be found.  Recall is measured against brute
force in the tests.

Contract of edge cases: vectors that are null, zero, or hold null or non-finite numbers,
or whose length is not the most frequent one, and rows without an id, take no part;
repeated rows of one id are one candidate; ties go to the smaller id; with fewer
candidates than asked all are returned; an empty table gives an empty result; columns
other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import materialise

#: Nodes compared with one another in the first graph.
LEAF = 200
_NODE = "id long, vector binary"


def valid_vectors(dimension: int, kind: type):
    """(id, list) to (id, packed numbers, hash), without rows that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, hashes = [], [], []
            whole = batch.filter(batch.column(0).is_valid())
            column = whole.column(1)
            sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) if len(whole) else np.zeros(0)
            whole = whole.take(pa.array(np.flatnonzero(sizes == dimension)))
            if not len(whole):
                continue
            column = whole.column(1)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            for i, v in zip(whole.column(0).to_numpy(zero_copy_only=False)[good].tolist(), values[good].astype(kind)):
                raw = v.tobytes()
                ids.append(i)
                vectors.append(raw)
                hashes.append(xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(hashes, pa.binary())],
                names=["id", "vector", "hash"],
            )

    return run


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Packed vectors as rows, as doubles."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1).astype(np.float64)


def place(tree: int, planes: int, kind: type):
    """(id, vector) with the sides of random hyperplanes, as a number, and a distance to sort by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(1), kind)
            directions = np.random.default_rng(1000 + tree).standard_normal((v.shape[1], planes + 1))
            side = v @ directions
            cell = ((side[:, :planes] > 0) << np.arange(planes)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(side[:, planes])],
                names=["id", "vector", "cell", "side"],
            )

    return run


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _from_differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def compare_leaves(degree: int, kind: type):
    """Sorted nodes to edges (u, v, d) with the nearest in each run of ``LEAF``; d is the squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if n < 2:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), kind)
            for part in np.array_split(np.arange(n), max(1, n // LEAF)):
                # Near the origin, products keep the small differences of near copies.
                middle = v[part] - np.median(v[part], axis=0)
                near = _square_distances(middle, middle)
                np.fill_diagonal(near, np.inf)
                k = min(degree, len(part) - 1)
                best = np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(part) - 1 else np.argsort(near, axis=1)[:, :k]
                u, w = np.repeat(part, k), part[best].ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[u]), pa.array(ids[w]), pa.array(_from_differences(v[u], v[w]))],
                    names=["u", "v", "d"],
                )

    return run


def compare_meetings(degree: int, kind: type):
    """Sorted by centre: (centre, id, worst, new, vector) to edges (u, v, d) not farther than u's worst neighbour."""

    def nearer(centre, ids, worst, new, v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = v - v[np.argmax(ids == centre)]
        squares = (own * own).sum(axis=1)
        near = _square_distances(own, own)
        np.fill_diagonal(near, np.inf)
        rounding = 1e-12 * (squares[:, None] + squares[None, :])
        near[(near > worst[:, None] * (1 + 1e-9) + rounding) | ~(new[:, None] | new[None, :])] = np.inf
        k = min(degree, len(ids) - 1)
        best = np.argpartition(near, k - 1, axis=1)[:, :k]
        u, at = np.nonzero(np.isfinite(np.take_along_axis(near, best, 1)))
        w = best[u, at]
        d = _from_differences(v[u], v[w])
        use = d <= worst[u]
        return ids[u[use]], ids[w[use]], d[use]

    def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(batch):
            return
        centre, ids, worst, new = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        v = _matrix(batch.column(4), kind)
        cuts = np.flatnonzero(centre[1:] != centre[:-1]) + 1
        out = [nearer(centre[a], ids[a:b], worst[a:b], new[a:b], v[a:b]) for a, b in zip([0, *cuts], [*cuts, len(centre)]) if b - a > 1]
        if out:
            u, w, d = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(d)], names=["u", "v", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None and len(held):
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not len(batch):
                continue
            centre = batch.column(0).to_numpy()
            cut = int(np.searchsorted(centre, centre[-1]))
            held = batch.slice(cut)
            yield from told(batch.slice(0, cut))
        if held is not None:
            yield from told(held)

    return run


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """(u, near): the ``degree`` nearest of each u as sorted (d, v); lists are cut before they grow."""
    near = F.slice(F.array_sort(F.collect_set(F.struct("d", "v"))), 1, degree)
    return edges.groupBy("u").agg(near.alias("near"))


def neighbour_graph(
    nodes: DataFrame, *, kind: type, degree: int, meet: int, trees: int, rounds: int
) -> DataFrame:
    """(u, near) for written nodes (id, vector): each with its nearest nodes found, as sorted (d, v)."""
    edges = None
    # Few nodes lie in few partitions, so that each has others to be compared with.
    parts = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // (4 * LEAF)))
    for tree in range(trees):
        placed = nodes.mapInArrow(place(tree, 10, kind), _NODE + ", cell long, side double")
        ordered = placed.repartitionByRange(parts, "cell", "side").sortWithinPartitions("cell", "side")
        found = ordered.select("id", "vector").mapInArrow(compare_leaves(degree, kind), "u long, v long, d double")
        edges = found if edges is None else edges.unionByName(found)
    found = nodes.select(F.col("id").alias("u")).join(_nearest(edges, degree), "u", "left")
    near = F.expr("coalesce(near, CAST(array() AS ARRAY<STRUCT<d: DOUBLE, v: BIGINT>>))")
    graph = materialise(found.select("u", near.alias("near"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("old")), "graph")
    for number in range(rounds):
        edges = graph.select("u", "old", F.explode("near").alias("e")).select(
            "u", "e.v", "e.d", (~F.array_contains("old", F.col("e.v"))).alias("new")
        )
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "new")
        met = edges.select("u", "v", "new").unionByName(back).groupBy("u", "v").agg(F.max("new").alias("new"))
        draw = W.partitionBy("u", "new").orderBy(F.xxhash64("v", F.lit(number)))
        met = met.withColumn("__n", F.row_number().over(draw)).filter(f"__n <= IF(new, {meet}, {meet // 2})")
        met = met.withColumn("__any", F.max("new").over(W.partitionBy("u"))).filter("__any")
        met = met.select(F.col("u").alias("centre"), F.col("v").alias("id"), "new")
        met = met.unionByName(graph.select(F.col("u").alias("centre"), F.col("u").alias("id"), F.lit(False).alias("new")))
        full = F.size("near") >= degree
        worst = F.when(full, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))
        known = nodes.join(graph.select(F.col("u").alias("id"), worst.alias("worst")), "id")
        sent = met.join(known, "id").select("centre", "id", "worst", "new", "vector")
        sent = sent.repartition("centre").sortWithinPartitions("centre", "id")
        better = sent.mapInArrow(compare_meetings(degree, kind), "u long, v long, d double")
        merged = _nearest(edges.select("u", "v", "d").unionByName(better), degree)
        before = graph.select("u", F.expr("transform(near, e -> e.v)").alias("old"))
        merged = before.join(merged, "u", "left").select("u", near.alias("near"), "old")
        graph = materialise(merged, "graph")
    return graph.select("u", "near")


def _distance(kind: type, a: str, b: str) -> Column:
    """The Euclidean distance of two columns of packed numbers."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        return pa.array(np.sqrt(((_matrix(x, kind) - _matrix(y, kind)) ** 2).sum(axis=1)))

    return F.arrow_udf(run, "double")(F.col(a), F.col(b))


def greedy_search(
    starts: DataFrame, graph: DataFrame, nodes: DataFrame, *, kind: type, pool: int, breadth: int, rounds: int
) -> DataFrame:
    """(query, v): for (query, at, vector) the ``pool`` nearest nodes seen.

    Each round opens a query's ``breadth`` best nodes that are not open yet and meets
    their neighbours.  A query that has no better node to open stays as it is.
    """
    queries = materialise(starts.select("query", F.col("vector").alias("asked")).dropDuplicates(["query"]), "queries")
    near = F.expr("transform(near, e -> e.v)")
    graph = graph.select("u", near.alias("near"))
    seen = starts.select("query", F.col("at").alias("v"), F.lit(0.0).alias("d"), F.lit(False).alias("open"))
    seen = materialise(seen, "seen")
    best = W.partitionBy("query").orderBy("d", "v")
    for _ in range(rounds):
        turn = F.sum(F.when(F.col("open"), 0).otherwise(1)).over(best.rowsBetween(W.unboundedPreceding, 0))
        opened = seen.withColumn("now", (~F.col("open")) & (turn <= breadth))
        steps = opened.filter("now").select("query", F.col("v").alias("u")).join(graph, "u")
        steps = steps.select("query", F.explode("near").alias("v")).distinct()
        fresh = steps.join(seen.select("query", "v"), ["query", "v"], "left_anti").join(queries, "query")
        fresh = fresh.join(nodes.withColumnRenamed("id", "v"), "v")
        fresh = fresh.select("query", "v", _distance(kind, "asked", "vector").alias("d"), F.lit(False).alias("open"))
        known = opened.select("query", "v", "d", (F.col("open") | F.col("now")).alias("open"))
        kept = known.unionByName(fresh).withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= pool)
        seen = materialise(kept.drop("__n"), "seen")
    return seen.select("query", "v")


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    degree: int = 24,
    meet: int = 36,
    trees: int = 6,
    rounds: int = 6,
    pool: int = 400,
    breadth: int = 100,
    search_rounds: int = 6,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's ``k`` nearest other rows found, by Euclidean distance."""
    # Floats are packed as they are, all other numbers as doubles.
    kind = np.float32 if vectors.schema[vector].dataType.elementType.typeName() == "float" else np.float64
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("__query"))
    common = rows.filter("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    top = common.orderBy(F.desc("c"), "n").first()
    dimension = int(top["n"]) if top else 1
    valid = rows.select("id", "v").mapInArrow(valid_vectors(dimension, kind), "id long, vector binary, hash binary")
    valid = materialise(valid, "vectors")
    named = valid.groupBy("hash").agg(F.min("id").alias("id"), F.first("vector").alias("vector"))
    nodes = materialise(named, "nodes")
    copies = valid.select("id", "hash").join(nodes.select(F.col("id").alias("node"), "hash"), "hash").select("node", "id")
    copies = materialise(copies.distinct(), "copies")

    plain = nodes.select("id", "vector")
    graph = neighbour_graph(plain, kind=kind, degree=degree, meet=meet, trees=trees, rounds=rounds)
    asked = rows.filter("__query AND id IS NOT NULL").select(F.col("id").alias("query")).distinct()
    asked = materialise(asked.join(copies.withColumnRenamed("id", "query"), "query").withColumnRenamed("node", "at"), "asked")
    starts = asked.join(plain.withColumnRenamed("id", "at"), "at")
    found = greedy_search(starts, graph, plain, kind=kind, pool=pool, breadth=breadth, rounds=search_rounds)

    exact = nodes.select(F.col("id").alias("v"), "vector")
    own = asked.join(exact.withColumnRenamed("v", "at"), "at").select("query", F.col("vector").alias("own"))
    scored = found.join(exact, "v").join(own, "query").select("query", "v", _distance(kind, "own", "vector").alias("d"))
    # The first k + 1 copies of a node are enough for any query, also for one of them.
    order = W.partitionBy("node").orderBy("id")
    some = copies.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k + 1).drop("__n")
    each = scored.withColumnRenamed("v", "node").join(some, "node").filter("id <> query")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("d", "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))
