"""The trie of conversation prefixes as node tables with minimal perfect hashes.

Every prefix of a conversation has a digest; distinct digests are the nodes. Nodes are dealt to shards so that a subtree
lies in one shard. A shard gives each of its digests a slot by a minimal perfect hash, verified by the digest stored
there, scatters counts into flat arrays, and adds them up through an array of parent slots, deepest nodes first.

Subtrees are cut where they become too large for a shard: a node belongs to level 0 if at most ``HEAVY`` conversations
pass through it, to level 1 up to the square of that, and so on. Levels are worked upwards, and what the tops of lower
levels hold is added, grouped by parent, to the nodes above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, smaller_batches
from .keyed import PerfectHash, _mix

#: Conversations through the top of a level-0 subtree; nodes that a shard holds beside its last subtree.
HEAVY, SHARD_NODES = 4096, 200_000
#: Conversation ids in one piece of a node's list, so that no task holds a list whole.
PIECE = 500_000

_PATH = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "a", "b", "parent_a", "parent_b", "words")] + [("last", pa.bool_())]
)
_NODE = (
    "a long, b long, parent_a long, parent_b long, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, top boolean"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): turns numbered from 0 by turn (null first), equal ones by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return rows.select("conv_id", (place - 1).cast("long").alias("at"), "role", "text")


def with_shared_starts(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, part, at, role, text): conversations that begin with turns of the first one of their ``every``.

    Conversation c starts with the first h turns of conversation c - c % every (fewer if it has fewer), followed by its
    own turns after its first h; h is the unsigned crc32 of the decimal c modulo ``most``. ``part`` -1 is a row without
    turn that every conversation has.
    """
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = ordered_turns(conversations)
    firsts = ordered_turns(conversations.where(c.cast("long") % every == 0)).where(F.col("at") < most - 1)
    firsts = firsts.withColumnRenamed("conv_id", "base")
    ids = conversations.select(c.cast("long").alias("conv_id")).where("conv_id is not null").distinct()
    borrowed = ids.withColumn("base", c - c % every).join(firsts, "base").where(F.col("at") < h)
    return (
        ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"))
        .union(borrowed.select("conv_id", F.lit(0), "at", "role", "text"))
        .union(own.where(F.col("at") >= h).select("conv_id", F.lit(1), "at", "role", "text"))
    )


def paths(turns: DataFrame) -> DataFrame:
    """A row per conversation and prefix, the empty one first: digests of it and its parent, words of its last text.

    A conversation's turns pass through one task in order, streamed; digests follow from the digest before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, at, held = None, 0, bytes(16), None
        for batch in smaller_batches(batches):
            out = []
            columns = (batch[c].to_pylist() for c in ("conv_id", "part", "role", "text"))
            for c, part, role, text in zip(*columns, strict=True):
                if held:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, depth, at = c, 0, bytes(16)
                parent = at
                if part >= 0:
                    head = role.encode("utf-8", "replace")
                    raw = text.encode("utf-8", "replace")
                    at = hashlib.blake2b(at + len(head).to_bytes(8, "little") + head + raw, digest_size=16).digest()
                    depth += 1
                    held = (conv, depth, at, parent, len(raw.split()))
                else:
                    held = (conv, depth, at, parent, 0)
            yield _path_rows(out)
        if held:
            yield _path_rows([(*held, True)])

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    fields = ", ".join(f"{c.name} {'boolean' if c.name == 'last' else 'long'}" for c in _PATH)
    return rows.select("conv_id", "part", "role", "text").mapInArrow(run, fields)


def _path_rows(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, at, parent, words, last = zip(*rows) if rows else [()] * 6
    digest = np.frombuffer(b"".join(at), "<i8").reshape(-1, 2)
    above = np.frombuffer(b"".join(parent), "<i8").reshape(-1, 2)
    long = lambda v: pa.array(v, pa.int64())
    columns = [long(conv), long(depth), *(pa.array(x[:, i].copy()) for x in (digest, above) for i in (0, 1)), long(words)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(last, pa.bool_())], schema=_PATH)


class NodeTable:
    """Slots of distinct 128-bit digests: a minimal perfect hash, and the digest in each slot to verify a hit."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.seed = 0
        while len(np.unique(self._keys(a, b))) < len(a):
            self.seed += 1  # two digests fold to one key; another seed parts them
            if self.seed > 64:
                raise ValueError("digests of a shard must be distinct")
        self.hash = PerfectHash.build(self._keys(a, b))
        self.own = self.hash.slots(self._keys(a, b))
        self.digest = np.empty((len(a), 2), "i8")
        self.digest[self.own] = np.column_stack([a, b])

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix(a.view("u8"), self.seed) ^ b.view("u8")

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        slot = self.hash.slots(self._keys(a, b))
        there = np.flatnonzero(slot >= 0)
        wrong = (self.digest[slot[there]] != np.column_stack([a[there], b[there]])).any(axis=1)
        slot[there[wrong]] = -1
        return slot


def _shard(rows: pa.Table) -> pa.Table:
    """One shard's nodes with sums over their subtrees; ``top`` marks nodes whose parent is in another shard."""
    c = {name: rows[name].to_numpy() for name in rows.column_names}
    table = NodeTable(c["a"], c["b"])
    size = len(c["a"])

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(size, "i8")
        out[table.own] = values
        return out

    parent = scattered(np.where(c["depth"] > 0, table.slots(c["parent_a"], c["parent_b"]), -1))
    depth, least, convs = scattered(c["depth"]), scattered(c["conv_id"]), scattered(c["n_convs"])
    inside = np.flatnonzero(parent >= 0)
    children = scattered(c["children"])
    np.add.at(children, parent[inside], 1)
    leaves = scattered(c["leaves"]) + (children == 0)
    saved = scattered(c["saved"]) + (convs - 1) * scattered(c["words"])
    order = inside[np.argsort(-depth[inside], kind="stable")]
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    for nodes in np.split(order, ends):
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    at = table.own
    above = pa.array(least[parent[at]], mask=parent[at] < 0)
    plain = lambda v: pa.array(v[at])
    columns = {k: rows[k].combine_chunks() for k in ("a", "b", "parent_a", "parent_b", "conv_id", "depth")}
    columns |= {"parent_conv_id": above, "n_convs": plain(convs), "n_children": plain(children)}
    columns |= {"n_leaves": plain(leaves), "saved_tokens": plain(saved), "top": pa.array((parent[at] < 0) & (depth[at] > 0))}
    return pa.table(columns)


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends(a, b, conv_id) to (a, b, ends_sha256): SHA-256 of each node's ids in ascending order, comma-joined.

    Ids are sorted by range, so that a node with a third of them spreads over tasks; each task joins its own ids into
    pieces, and only a digest's running over its node's pieces is left to one task.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held = None, None, []
        out: list[tuple] = []
        for batch in batches:
            for a, b, c in zip(*(batch[x].to_pylist() for x in ("a", "b", "conv_id")), strict=True):
                if node is not None and ((a, b) != node or len(held) >= PIECE):
                    out.append((*node, first, ",".join(held).encode()))
                    held = []
                if not held:
                    node, first = (a, b), c
                held.append(str(c))
            if out:
                yield _batch(out, ("a", "b", "first", "ids"))
                out = []
        if held:
            yield _batch([(*node, first, ",".join(held).encode())], ("a", "b", "first", "ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch[x].to_pylist() for x in ("a", "b", "ids")), strict=True):
                if (a, b) != node:
                    if node is not None:
                        out.append((*node, running.hexdigest()))
                    node, running = (a, b), hashlib.sha256(ids)
                else:
                    running.update(b",")
                    running.update(ids)
            if out:
                yield _batch(out, ("a", "b", "ends_sha256"))
        if node is not None:
            yield _batch([(*node, running.hexdigest())], ("a", "b", "ends_sha256"))

    spread = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    joined = materialize(spread.mapInArrow(pieces, "a long, b long, first long, ids binary"), "trie-ends")
    by_node = joined.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return by_node.select("a", "b", "ids").mapInArrow(digests, "a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=list(names))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per distinct prefix of conversations ``turns(conv_id, part, at, role, text)``, ordered by part and at.

    ``part`` below 0 is no turn and only says that there is such a conversation; every conversation needs such a row.
    Turns are equal if role and text are. Result: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 and the digest ``a, b``. No conversations give no rows, not even the root.

    A prefix that a third of all conversations share costs a row per task: counts are added up before they are
    shuffled. Nodes heavier than a shard are worked in levels of their own, at most 1 / ``HEAVY`` of the rows each.
    """
    spark = turns.sparkSession
    walked = materialize(paths(turns), "trie-paths")
    counted = walked.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    heavy = materialize(counted, "trie-heavy")
    total = walked.where("depth = 0").count()
    bounds = [HEAVY]
    while bounds[-1] < total:
        bounds.append(bounds[-1] * HEAVY)
    level = F.lit(0)
    for i, bound in enumerate(bounds[:-1]):
        level = F.when(F.col("n") > bound, i + 1).otherwise(level)
    placed = walked.join(heavy, ["a", "b"], "left").withColumn("level", level)
    # Fewer conversations pass through a prefix the longer it is, so a level is a stretch of the conversation's path.
    along = Window.partitionBy("conv_id", "level").orderBy("depth")
    placed = placed.withColumn("shard_key", F.xxhash64(F.first("a").over(along), F.first("b").over(along)))
    nodes = placed.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        *[F.max(c).alias(c) for c in ("depth", "parent_a", "parent_b", "words", "level", "shard_key")],
    )
    nodes = materialize(nodes, "trie-nodes")
    sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a few levels

    done: DataFrame | None = None
    for i in sorted(sizes):
        part = nodes.where(F.col("level") == i).drop("level")
        if done is None:
            part = part.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            below = done.where("top").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b"))
            below = below.agg(
                F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
            )
            part = part.join(below, ["a", "b"], "left").na.fill(0, ["children", "leaves", "saved"])
        shards = -(-sizes[i] // SHARD_NODES)
        worked = part.groupBy(F.pmod("shard_key", F.lit(shards)).alias("shard")).applyInArrow(_shard, _NODE)
        worked = materialize(worked, f"trie-level-{i}")
        done = worked if done is None else done.union(worked)
    if done is None:
        return spark.createDataFrame([], _NODE).withColumn("ends_sha256", F.lit("")).drop("parent_a", "parent_b", "top")

    # Parents in another shard are heavy nodes, of which there are few.
    names = nodes.where("level > 0").select(
        F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("above")
    )
    done = done.join(materialize(names, "trie-parents"), ["parent_a", "parent_b"], "left")
    parent = F.when(F.col("top"), F.col("above")).otherwise(F.col("parent_conv_id"))
    ends = ends_digests(walked.where("last").select("a", "b", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return done.join(ends, ["a", "b"], "left").select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        "a",
        "b",
    )
