"""Merkle manifest of a table: digest-to-children records, and proofs by descent from the root.

Rows are leaves.  Those of a group, in their order, are cut into runs of 16, each run's
digests together become a parent, and so on until one node is left, the group's subroot;
subroots in the order of their groups are joined to the root in the same way.  A record
is named by what it holds (digest -> children), so equal subtrees are one record.

A request is the place of a leaf.  All requests go down together: those that share the
upper digits (base 16) of their places are one entry, which looks its digest up, takes
the child that the next digit names and keeps the others as a segment of the path.  The
segments come from the root down and are reversed for the proof.

Contract of edge cases: rows of a null group are a group of their own, which is the
first; a null order value comes first; rows with equal order values follow the order of
their digests, and repeated rows are leaves of their own; a single row is its group's
subroot, a single group's subroot the root; an empty table has neither root nor proofs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import materialise, wide_row_number

#: Children of a node, as bits of a place.
BITS = 4
WIDTH = 1 << BITS

_EMPTY_PATH = "CAST(array() AS ARRAY<STRUCT<`left`: BINARY, `right`: BINARY>>)"


def digest_of(sql: str) -> str:
    """SQL of the 32 bytes of SHA-256 of a text or of bytes."""
    return f"unhex(sha2({sql}, 256))"


def digest_of_digests(sql: str) -> str:
    """SQL of the digest of digests that stand one after the other in a binary value, read as lowercase hex text."""
    return digest_of(f"lower(hex({sql}))")


def row_digest(fields: list[str]) -> Column:
    """The digest of a row: each field as ``-`` if null, else as its number of bytes, ``:`` and its value."""
    parts = []
    for sql in fields:
        value = f"CAST({sql} AS STRING)"
        parts.append(f"IF({sql} IS NULL, '-', concat(CAST(octet_length({value}) AS STRING), ':', {value}))")
    return F.expr(digest_of(f"concat({', '.join(parts)})"))


@dataclass(frozen=True)
class Manifest:
    """``leaves`` have row (all columns of the rows), leaf, key, place, n; ``groups`` key, n, digest, their own place
    and ``all``, the one key of the tree over them.

    ``below[h - 1]`` and ``above[h - 1]`` hold the records of height h, inside the groups
    and over them: key, place, n, digest, children (binary, 32 bytes each).
    """

    leaves: DataFrame
    groups: DataFrame
    below: list[DataFrame]
    above: list[DataFrame]
    root: bytes | None


def _levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Records by height, and the last node of each key, of key, place (from 0), n (nodes of the key) and digest."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    tops = nodes.filter("n = 1").select("key", "n", "digest")
    level, levels, reach = nodes, [], 1
    while reach < largest:
        runs = (
            level.filter(F.col("n") > reach)
            .groupBy("key", F.shiftright("place", BITS).alias("place"))
            .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
            .select("key", "place", "n", F.col("run.digest").alias("children"))
        )
        joined = "aggregate(children, CAST('' AS BINARY), (all, one) -> concat(all, one))"
        level = materialise(runs.withColumn("digest", F.expr(digest_of_digests(joined))), f"{name}-{len(levels) + 1}")
        levels.append(level)
        reach *= WIDTH
        tops = tops.unionByName(level.filter(F.col("n") <= reach).select("key", "n", "digest"))
    return levels, tops


def merkle_manifest(rows: DataFrame, *, group: str, order: str, digest: str) -> Manifest:
    """The manifest of ``rows``, whose column ``digest`` has the leaves (32 bytes).

    Rows are dealt by range of group and order, so a group of any size is spread; every
    level has a sixteenth of the nodes of the one below.  This writes when it is called.
    """
    # A null group sorts before the empty one, and keys can be joined.
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    keyed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        key.alias("key"),
        F.col(order).alias("order"),
        F.col(digest).alias("leaf"),
        F.monotonically_increasing_id().alias("tie"),
    )
    numbered = wide_row_number(keyed, ["key"], ["order", "leaf", "tie"], "place", total="n")
    leaves = numbered.select("row", "leaf", "key", (F.col("place") - 1).alias("place"), "n")
    below, tops = _levels(leaves.select("key", "place", "n", F.col("leaf").alias("digest")), "merkle-below")
    tops = materialise(tops.withColumn("all", F.lit("")), "merkle-groups")
    ordered = wide_row_number(tops, ["all"], ["key"], "place", total="n_groups")
    groups = ordered.select("all", "key", "n", "digest", (F.col("place") - 1).alias("place"), "n_groups")
    over = groups.select(F.col("all").alias("key"), "place", F.col("n_groups").alias("n"), "digest")
    above, roots = _levels(over, "merkle-above")
    root = roots.select("digest").first()
    return Manifest(leaves, groups, below, above, bytes(root[0]) if root else None)


def descend(starts: DataFrame, levels: list[DataFrame], requests: DataFrame) -> DataFrame:
    """Requests (key, place, n, ...) with ``top``, the digest their key starts from, and ``path``, top segment first.

    ``starts`` has key, n, digest and path.  Entries are as many as the runs that hold
    requests, so the paths of a run are carried once for all its leaves.
    """
    lone = requests.filter("n = 1").join(
        starts.filter("n = 1").select("key", F.col("digest").alias("top"), "path"), "key"
    )
    asked = []
    for height in range(1, len(levels) + 1):
        wanted = (requests if height == 1 else asked[-1]).filter(F.col("n") > WIDTH ** (height - 1))
        asked.append(wanted.select("key", "n", F.shiftright("place", BITS).alias("place")).distinct())
    segment = (
        "struct(aggregate(slice(children, 1, digit), CAST('' AS BINARY), (all, one) -> concat(all, one)) AS `left`, "
        f"aggregate(slice(children, digit + 2, {WIDTH}), CAST('' AS BINARY), (all, one) -> concat(all, one)) AS `right`)"
    )
    entries = None
    for height in range(len(levels), 0, -1):
        begin = starts.filter((F.col("n") > WIDTH ** (height - 1)) & (F.col("n") <= WIDTH**height)).select(
            "key", F.lit(0).cast("long").alias("place"), "digest", F.col("digest").alias("top"), "path"
        )
        entries = begin if entries is None else entries.unionByName(begin)
        store = levels[height - 1].groupBy("digest").agg(F.first("children").alias("children"))
        opened = entries.join(store, "digest").select("key", F.col("place").alias("above"), "top", "path", "children")
        below = requests.filter("n > 1") if height == 1 else asked[height - 2].filter(F.col("n") > WIDTH ** (height - 1))
        below = below.withColumn("above", F.shiftright("place", BITS))
        chosen = below.join(opened, ["key", "above"]).withColumn("digit", F.expr(f"CAST(place & {WIDTH - 1} AS INT)"))
        entries = chosen.withColumn("path", F.expr(f"concat(path, array({segment}))"))
        if height > 1:
            entries = entries.select("key", "place", F.expr("children[digit]").alias("digest"), "top", "path")
    if entries is None:
        return lone
    return entries.select(*lone.columns).unionByName(lone)


def merkle_proofs(manifest: Manifest) -> DataFrame:
    """row, leaf, subroot, root and path of all leaves: left and right siblings of every level, the leaf's own first."""
    top = manifest.groups.groupBy(F.col("all").alias("key")).agg(F.max("n_groups").alias("n"))
    top = top.select("key", "n", F.lit(manifest.root).cast("binary").alias("digest"), F.expr(_EMPTY_PATH).alias("path"))
    places = manifest.groups.select(
        F.col("all").alias("key"), "place", F.col("n_groups").alias("n"), F.col("key").alias("group"), F.col("n").alias("size"), "digest"
    )
    over = descend(top, manifest.above, places)
    starts = materialise(over.select(F.col("group").alias("key"), F.col("size").alias("n"), "digest", "path"), "merkle-starts")
    found = descend(starts, manifest.below, manifest.leaves)
    root = F.lit(manifest.root).cast("binary").alias("root")
    return found.select("row", "leaf", F.col("top").alias("subroot"), root, F.reverse("path").alias("path"))


def proof_bytes(path: str = "path") -> str:
    """SQL of all siblings' digests, from the leaf's run to the root's, left to right."""
    return f"aggregate({path}, CAST('' AS BINARY), (all, one) -> concat(all, one.`left`, one.`right`))"


def folded(leaf: str, path: str = "path") -> str:
    """SQL of the root that a leaf and the siblings of its path make."""
    return f"aggregate({path}, {leaf}, (own, one) -> {digest_of_digests('concat(one.`left`, own, one.`right`)')})"


def to_hex(sql: str) -> Column:
    return F.expr(f"lower(hex({sql}))")
