"""Conversation prefix trie, and totals of its subtrees by parallel tree contraction.

A node is a distinct sequence of first turns.  It is found without walking the trie:
a turn at position i has a digest of (i, role, text), and the sums of a conversation's
first d digests, in four lanes of 32 bits, name its node of depth d.

Contraction alternates two steps until the tree is gone, each a few joins over the
nodes that are left.  Rake: leaves hand their sums to their parents and are done.
Compress: in a chain of nodes with one child each, all but the first are taken out;
each of them remembers the sum of the part of the chain from itself on and the node
below the chain, whose total it still lacks.  Chains are seen where they follow one
conversation: every node is marked with its member of the smallest hash, a mark that
changes only about log(n) times down a chain, whatever the ids.  Then the rounds are
gone through backwards, and what was taken out gets its total from the node it waited
for.

Contract of edge cases: a null role or text is empty; rows without a conversation id
belong to no conversation and are left out; turns with one number follow the order of
the digests of role and text, and repeated rows are turns of their own; an empty table
has no nodes.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import materialise, wide_row_number

#: Turns of one conversation that are summed in one place; longer ones go on block by block.
BLOCK = 4096
LANES = 4
_LANES = [f"p{k}" for k in range(LANES)]
_WORDS = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), said (digest of role and text) and words of every turn.

    Texts do not pass the shuffle.  A conversation of any length is spread by range.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    said = "unhex(sha2(concat(CAST(octet_length(role) AS STRING), ':', role, text), 256))"
    turns = rows.select(
        "conv_id", "turn", F.expr(said).alias("said"), F.expr(f"CAST({_WORDS} AS BIGINT)").alias("words"),
        F.monotonically_increasing_id().alias("tie"),
    )
    out = wide_row_number(turns, ["conv_id"], ["turn", "said", "tie"], "pos", total="n")
    return out.select("conv_id", (F.col("pos") - 1).alias("pos"), "n", "said", "words")


def with_shared_heads(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after every conversation's first h turns were replaced by its family's.

    A family are ``family`` neighbouring ids, its first id lends the turns, and h is
    the unsigned crc32 of the decimal id modulo ``heads``.  Conversations are conv_id
    and n, which may be 0.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    every = turns.filter("pos = 0").select("conv_id", F.col("n").alias("had"))
    lenders = every.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("had").alias("lent"))
    plan = (
        every.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
        .withColumn("h", h)
        .join(lenders, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0))))
    )
    plan = materialise(plan, "trie-plan")
    lent = (
        turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads))
        .select(F.col("conv_id").alias("base"), "pos", "said", "words")
        .join(plan.select("conv_id", "base", "h"), "base")
        .filter("pos < h")
        .select("conv_id", "pos", "said", "words")
    )
    # Only conversations whose lender is too short move their own turns.
    moved = plan.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("by"))
    own = (
        turns.filter(F.col("pos") >= h)
        .join(moved, "conv_id", "left")
        .select("conv_id", (F.col("pos") - F.coalesce("by", F.lit(0))).alias("pos"), "said", "words")
    )
    length = F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))
    return lent.unionByName(own), plan.select("conv_id", length.alias("n"))


def _node_key(depth: str, lanes: list[str]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes)))


def prefix_nodes(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, key and parent_key of the node, words of the turn: a row for every turn, written."""
    hexed = F.sha2(F.concat_ws(":", "pos", F.hex("said")), 256)
    lanes = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"d{k}") for k in range(LANES)]
    rows = turns.withColumn("h", hexed).select("conv_id", "pos", "words", F.expr(f"pos DIV {block}").alias("block"), *lanes)
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    sums = [F.sum(f"d{k}").over(inside).alias(p) for k, p in enumerate(_LANES)]
    rows = rows.select("conv_id", "pos", "words", "block", *[f"d{k}" for k in range(LANES)], *sums)
    if (conversations.agg(F.max("n")).first()[0] or 0) > block:
        rows = materialise(rows, "trie-blocks")
        before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        totals = rows.groupBy("conv_id", "block").agg(*[F.sum(f"d{k}").alias(f"t{k}") for k in range(LANES)])
        starts = totals.select("conv_id", "block", *[F.sum(f"t{k}").over(before).alias(f"s{k}") for k in range(LANES)])
        rows = rows.join(starts.filter("block > 0"), ["conv_id", "block"], "left")
        rows = rows.withColumns({p: F.col(p) + F.coalesce(f"s{k}", F.lit(0)) for k, p in enumerate(_LANES)})
    above = [(F.col(p) - F.col(f"d{k}")).alias(f"u{k}") for k, p in enumerate(_LANES)]
    rows = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("pos").alias("up"), "words", *_LANES, *above)
    return materialise(
        rows.select(
            "conv_id", "depth", "words",
            _node_key("depth", _LANES).alias("key"),
            _node_key("up", [f"u{k}" for k in range(LANES)]).alias("parent_key"),
        ),
        "trie-turns",
    )


def root_key() -> bytes:
    return hashlib.md5(",".join(["0"] * (LANES + 1)).encode()).digest()


def joined_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256 of (key, conv_id): SHA-256 of the decimal ids, ascending and joined by commas.

    Ids of one key are joined in pieces of 4 096 neighbouring numbers first; the pieces
    of a key then pass one digest as a stream, as SHA-256 has no other way.
    """
    pieces = (
        members.groupBy("key", F.shiftright("conv_id", 12).alias("piece"))
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select("key", "piece", F.expr("array_join(transform(ids, i -> CAST(i AS STRING)), ',')").alias("part"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == now:
                    state.update(b"," + part.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    digests.append(state.hexdigest())
                now, state = key, hashlib.sha256(part.encode())
            if keys:
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    together = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "part")
    return together.mapInArrow(digest, "key binary, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """id and the totals of ``values`` over each node's subtree, itself included.

    ``tree`` has id, parent (null for roots), depth, mark, n_children and the values; a
    mark is shared by nodes of one path only.  Every round takes out all leaves and
    whole stretches of chains, so a tree of n nodes takes about log(n) rounds.
    """
    state = materialise(tree.select("id", "parent", "depth", "mark", F.col("n_children").alias("kids"), *values), "trie-state")
    done, waiting = [], []
    reach = block
    while state.limit(1).count():
        # Rake: leaves are done; their parents get their sums.
        is_leaf = F.col("kids") == 0
        done.append(state.filter(is_leaf).select("id", *values))
        given = (
            state.filter("parent IS NOT NULL")
            .groupBy(F.col("parent").alias("id"))
            .agg(
                F.count_if(~is_leaf).alias("kids"),
                F.min(F.when(~is_leaf, F.col("id"))).alias("only"),
                *[F.sum(F.when(is_leaf, F.col(v)).otherwise(0)).alias(f"more_{v}") for v in values],
            )
        )
        rest = (
            state.filter(~is_leaf)
            .drop("kids")
            .join(given, "id")
            .withColumns({v: F.col(v) + F.col(f"more_{v}") for v in values})
            .withColumn("stretch", F.expr(f"depth DIV {reach}"))
        )
        # Compress: a node joins the run of the node above it if both are on one path and that one has no other child.
        path = W.partitionBy("mark", "stretch").orderBy("depth")
        linked = (
            (F.col("kids") <= 1)
            & (F.lag("kids").over(path) == 1)
            & F.lag("parent").over(path).isNotNull()
            & (F.lag("id").over(path) == F.col("parent"))
        )
        rest = rest.withColumn("follows", F.coalesce(linked, F.lit(False)))
        rest = rest.withColumn("run", F.count_if(~F.col("follows")).over(path.rowsBetween(W.unboundedPreceding, 0)))
        # Backwards, so that every frame only grows.
        onward = W.partitionBy("mark", "stretch", "run").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
        rest = rest.select(
            "id", "parent", "depth", "mark", "follows",
            F.first("kids").over(onward).alias("kids"),
            F.first("only").over(onward).alias("only"),
            *[F.sum(v).over(onward).alias(v) for v in values],
        )
        rest = materialise(rest, "trie-round")
        # What lies below a run hangs on the run's first node from now on.
        below = rest.filter("NOT follows AND only IS NOT NULL AND kids = 1").select(
            F.col("only").alias("id"), F.col("id").alias("moved_to")
        )
        waiting.append(rest.filter("follows").select("id", F.expr("IF(kids = 0, NULL, only)").alias("below"), *values))
        kept = rest.filter("NOT follows").drop("only", "follows")
        state = materialise(
            kept.join(below, "id", "left").withColumn("parent", F.coalesce("moved_to", "parent")).drop("moved_to"), "trie-state"
        )
        reach = min(reach * block, 1 << 62)
    # Re-expand, last round first: what was taken out in a round waits for a node that was left after it.
    known = None
    for leaves, taken in zip(reversed(done), reversed(waiting)):
        if known is not None:
            lacking = known.select(F.col("id").alias("below"), *[F.col(v).alias(f"more_{v}") for v in values])
            found = taken.join(lacking, "below", "left").select(
                "id", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
            )
            taken = materialise(found, "trie-totals")
        else:
            taken = taken.select("id", *values)
        known = leaves.unionByName(taken) if known is None else known.unionByName(leaves).unionByName(taken)
    return known if known is not None else tree.select("id", *values)


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, pos, said, words) of ``conversations`` (conv_id, n).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256; n is 0 for conversations without turns, which are
    members of the root only.
    """
    rows = prefix_nodes(turns, conversations, block)
    root = conversations.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("mark")
    ).filter("n_convs > 0")
    root = root.select(
        F.lit(root_key()).alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), "mark",
    )
    nodes = rows.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.min(F.xxhash64("conv_id")).alias("mark"),
    )
    nodes = materialise(nodes.unionByName(root), "trie-nodes")
    children = nodes.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = (
        nodes.join(children, "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .join(parents, "parent_key", "left")
    )
    nodes = materialise(nodes, "trie-family")
    totals = subtree_totals(
        nodes.select(
            F.col("key").alias("id"), F.col("parent_key").alias("parent"), "depth", "mark", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        ["n_leaves", "saved_tokens"],
        block,
    )
    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    turnless = conversations.filter("n = 0").select("conv_id", F.lit(root_key()).alias("key"))
    ends = joined_digests(last.unionByName(turnless))
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, nodes["key"] == totals["id"])
        .drop("id")
        .join(ends, "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
