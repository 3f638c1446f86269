"""A trie of conversation prefixes in flat arrays, found by minimal perfect hashing.

Every prefix of a conversation is a node. Its digest is the xor of hashes of (depth, turn), so the digests along a
conversation are running totals. Conversations are dealt to shards, long ones in segments. A shard enumerates its
distinct digests, gives each a slot of a minimal perfect hash table, and scatters its counts into arrays by slot, so a
prefix that many conversations share leaves a shard as one row. The merged table knows each node's smallest member, which
owns it. In a second pass each node's own values go to the one shard of its owner and are added up towards the root
through the parents' slots, deepest level first; what the shards have for the same node is added together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skywharf.session import cut_lineage

#: Turns of a conversation that one shard holds; later ones are further segments.
SEGMENT = 1000
#: Rows of a shard at most (small tables have a shard for each shuffle partition), and rows of the given table that are numbered as one.
SHARD_ROWS, CELL = 20_000, 1024
#: Ids that one row of a member list holds.
LISTED = 4096
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class NodeTable:
    """Minimal perfect hash of distinct digests (pairs of 64-bit numbers): each has one of as many slots as there are digests.

    Each level hashes the digests left into a bitmap; those alone in their bit take it, the others go on to the next
    level. A slot keeps its digest, so every answer is verified against it.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.levels, taken, left = [], 0, np.arange(len(first))
        self.first, self.second = np.empty_like(first), np.empty_like(second)
        while len(left):
            seed, size = len(self.levels), 2 * len(left)
            at = self._place(first[left], second[left], seed, size)
            alone = np.bincount(at, minlength=size) == 1
            slot = taken + np.cumsum(alone) - 1
            self.levels.append((size, alone, slot))
            own = alone[at]
            self.first[slot[at[own]]], self.second[slot[at[own]]] = first[left[own]], second[left[own]]
            taken, left = taken + int(alone.sum()), left[~own]

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, seed: int, size: int) -> np.ndarray:
        x = first.astype(np.uint64) * _ODD[0] + second.astype(np.uint64) + np.uint64(int(_ODD[2]) * seed % (1 << 64))
        for odd in _ODD[1:]:
            x ^= x >> np.uint64(31)
            x *= odd
        return ((x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where the table does not hold it."""
        out, open_ = np.full(len(first), -1, dtype=np.int64), np.arange(len(first))
        for seed, (size, alone, slot) in enumerate(self.levels):
            at = self._place(first[open_], second[open_], seed, size)
            own = alone[at]
            out[open_[own]] = slot[at[own]]
            open_ = open_[~own]
        found = np.flatnonzero(out >= 0)
        wrong = found[(self.first[out[found]] != first[found]) | (self.second[out[found]] != second[found])]
        out[wrong] = -1
        return out


def distinct(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of the first of equal digests."""
    return np.flatnonzero(~pd.MultiIndex.from_arrays([first, second]).duplicated())


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, k (1-based place), n (turns of the conversation), h1, h2 (hashes of role and text), chars of every turn.

    Turns are ordered by ``turn``, null first, turns of one number by their hashes. A null role or text counts as empty.
    Rows without a conv_id belong to no conversation and go. Repeated rows are turns of their own; other columns are
    ignored; an empty table gives an empty result. A conversation is numbered in cells of CELL turn numbers, whose counts
    are added up, so a long one is not one task's.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(text, role, F.lit(1)).alias("h2"), F.length(text).cast("long").alias("chars"),
        F.coalesce(F.floor(F.col("turn") / CELL).cast("long"), F.lit(-(1 << 62))).alias("cell"),
    )
    by = Window.partitionBy("conv_id")
    cells = rows.groupBy("conv_id", "cell").agg(F.count("*").alias("many")).select(
        "conv_id", "cell", F.sum("many").over(by).alias("n"), (F.sum("many").over(by.orderBy("cell")) - F.col("many")).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("conv_id", "cell").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2"))
    return rows.withColumn("local", local).join(cells, ["conv_id", "cell"]).select("conv_id", (F.col("local") + F.col("before")).alias("k"), "n", "h1", "h2", "chars")


def grafted(turns: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings: (conv_id, depth, h1, h2, chars) of their turns, and (conv_id, size) of all.

    Conversation c begins with the first h turns of conversation c - c % ``every`` (all if it has fewer, none if there is
    none), h the unsigned CRC-32 of c in decimal modulo ``most`` + 1; its own turns after the first h follow.
    """
    turns = cut_lineage(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    all_ = turns.where("k = 1").select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = turns.where((F.col("k") <= most) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "k", "n", "h1", "h2", "chars")
    lengths = bases.where("k = 1").select("base", F.col("n").alias("base_n"))
    sized = cut_lineage(all_.join(lengths, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))))
    borrowed = sized.join(bases.drop("n"), "base").where("k <= h").select("conv_id", F.col("k").alias("depth"), "h1", "h2", "chars")
    own = turns.where(F.col("k") > h).join(sized.select("conv_id", "lent", "h"), "conv_id").select("conv_id", (F.col("k") - F.col("h") + F.col("lent")).alias("depth"), "h1", "h2", "chars")
    return borrowed.unionByName(own), sized.select("conv_id", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("lent")).alias("size"))


def paths_of(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, segment, digest (d1, d2), parent's digest (p1, p2), chars and last (it ends there) of every prefix but the empty one."""
    step = {"e1": F.xxhash64("depth", "h1", "h2"), "e2": F.xxhash64("h2", "h1", "depth"), "segment": F.floor((F.col("depth") - 1) / SEGMENT)}
    rows = turns.withColumns(step)
    by = Window.partitionBy("conv_id", "segment").orderBy("depth")
    rows = rows.withColumns({"r1": F.bit_xor("e1").over(by), "r2": F.bit_xor("e2").over(by)})
    # Only conversations of several segments have totals before a segment.
    whole = rows.groupBy("conv_id", "segment").agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    running = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "segment", F.bit_xor("s1").over(running).alias("b1"), F.bit_xor("s2").over(running).alias("b2")).where("segment > 0")
    joined = rows.join(before, ["conv_id", "segment"], "left").join(conversations, "conv_id")
    d1, d2 = (F.col(f"r{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2))
    return joined.select(
        "conv_id", "depth", "segment", d1.alias("d1"), d2.alias("d2"), d1.bitwiseXOR(F.col("e1")).alias("p1"), d2.bitwiseXOR(F.col("e2")).alias("p2"), "chars",
        (F.col("depth") == F.col("size")).alias("last"),
    )


def local_nodes(rows: pa.Table) -> pa.Table:
    """Distinct nodes of a shard's paths, with members, ends and smallest member, in the order of their slots."""
    d1, d2, conv, last = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("d1", "d2", "conv_id", "last"))
    first = distinct(d1, d2)
    table = NodeTable(d1[first], d2[first])
    slot = table.slots(d1, d2)
    place = np.empty(len(first), dtype=np.int64)
    place[slot[first]] = first
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    columns = {x: rows.column(x).to_numpy()[place] for x in ("shard", "depth", "segment", "d1", "d2", "p1", "p2", "chars")}
    columns |= {"members": np.bincount(slot, minlength=len(first)), "ends": np.bincount(slot, weights=last, minlength=len(first)).astype(np.int64), "least": least}
    return pa.table({k: pa.array(v) for k, v in columns.items()})


def subtree_sums(nodes: pa.Table, given: pa.Table) -> pa.Table:
    """d1, d2 and the sums of ``leaves`` and ``saved`` given for the nodes of a shard, over each node's subtree within its segment."""
    d1, d2, p1, p2, depth = (nodes.column(x).to_numpy() for x in ("d1", "d2", "p1", "p2", "depth"))
    table = NodeTable(d1, d2)
    # A segment ends here even if the shard holds the one before it too: that one is given what follows.
    slot, parent = table.slots(d1, d2), np.where(nodes.column("top").to_numpy(zero_copy_only=False), -1, table.slots(p1, p2))
    at = table.slots(given.column("d1").to_numpy(), given.column("d2").to_numpy())
    if (at < 0).any():
        raise ValueError("a node was given to a shard that does not hold it")
    sums = np.zeros((2, len(d1)), dtype=np.int64)
    for row, name in zip(sums, ("leaves", "saved")):
        np.add.at(row, at, given.column(name).to_numpy())
    by = np.argsort(-depth, kind="stable")
    for level in np.split(by, np.flatnonzero(np.diff(depth[by])) + 1):
        level = level[parent[level] >= 0]
        for row in sums:
            np.add.at(row, parent[level], row[slot[level]])
    return pa.table({"d1": pa.array(d1), "d2": pa.array(d2), "leaves": pa.array(sums[0][slot]), "saved": pa.array(sums[1][slot])})


def member_digests(ends: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256 of the decimal ids, ascending and joined by commas, that end at each digest (d1, d2, conv_id).

    Ids are dealt by ranges, so a node of very many is spread over partitions, whose texts of LISTED ids each are then
    hashed one after another: a task holds one of them at a time.
    """

    def listed(batches):
        node, ids = None, []
        for batch in batches:
            for d1, d2, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if node != (d1, d2) or len(ids) == LISTED:
                    if ids:
                        yield *node, ids[0], ",".join(map(str, ids))
                    node, ids = (d1, d2), []
                ids.append(conv)
        if ids:
            yield *node, ids[0], ",".join(map(str, ids))

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            for d1, d2, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if node != (d1, d2):
                    if node:
                        yield *node, state.hexdigest()
                    node, state = (d1, d2), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if node:
            yield *node, state.hexdigest()

    def in_batches(make, names, types, most):
        def run(batches):
            rows = []
            for row in make(batches):
                rows.append(row)
                if len(rows) == most:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        return run

    long = pa.int64()
    pieces = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(
        in_batches(listed, ["d1", "d2", "first_id", "ids"], [long, long, long, pa.string()], 100), "d1 long, d2 long, first_id long, ids string"
    )
    return pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first_id").mapInArrow(
        in_batches(hashed, ["d1", "d2", "ends_sha256"], [long, long, pa.string()], 1000), "d1 long, d2 long, ends_sha256 string"
    )


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of ``turns`` (conv_id, depth from 1, h1, h2, chars) of ``conversations`` (conv_id, size).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (see the
    README), and digest (two longs) of each node. The root has no parent; every conversation, also one without turns, is
    a member of it. Without conversations there is no node. Ids are whole numbers without null.
    """
    conversations = cut_lineage(conversations)
    paths = paths_of(turns, conversations)
    paths = cut_lineage(paths)
    many = paths.count()
    shards = max(many // SHARD_ROWS + 1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def shard(owner: str):
        return F.pmod(F.xxhash64(F.col(owner), F.col("segment")), F.lit(shards)).cast("int").alias("shard")

    local = cut_lineage(paths.withColumn("shard", shard("conv_id")).groupBy("shard").applyInArrow(
        local_nodes, "shard int, depth long, segment long, d1 long, d2 long, p1 long, p2 long, chars long, members long, ends long, least long"
    ))
    node = ["depth", "segment", "d1", "d2", "p1", "p2", "chars"]
    nodes = cut_lineage(local.groupBy(*node).agg(F.sum("members").alias("n_convs"), F.sum("ends").alias("ends"), F.min("least").alias("conv_id")))
    leaf, own = F.when(F.col("ends") == F.col("n_convs"), 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    given = nodes.select(shard("conv_id"), "d1", "d2", leaf.alias("leaves"), own.alias("saved"))
    # What the owner's later segments hold counts for the last node of each earlier one. Few conversations have any.
    totals = nodes.groupBy("conv_id", "segment").agg(F.sum(leaf).alias("leaves"), F.sum(own).alias("saved"))
    reach = totals.groupBy("conv_id").agg(F.max("segment").alias("top")).where("top > 0")
    later = paths.where((F.col("depth") % SEGMENT == 0) & ~F.col("last")).join(reach, "conv_id").select("conv_id", "segment", "d1", "d2")
    spread = later.unionByName(totals.join(reach.select("conv_id"), "conv_id", "left_semi").where("segment > 0").select("conv_id", "segment", "leaves", "saved"), allowMissingColumns=True)
    following = Window.partitionBy("conv_id").orderBy(F.col("segment").desc()).rangeBetween(Window.unboundedPreceding, -1)
    carried = spread.withColumns({x: F.sum(x).over(following) for x in ("leaves", "saved")}).where("d1 IS NOT NULL AND leaves IS NOT NULL")
    given = given.unionByName(carried.select(shard("conv_id"), "d1", "d2", "leaves", "saved"))
    held = ["shard", "depth", "d1", "d2", "p1", "p2", "top"]
    sums = local.withColumn("top", (F.col("depth") - 1) % SEGMENT == 0).select(*held).toDF(*held).groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(subtree_sums, "d1 long, d2 long, leaves long, saved long")
    digests = member_digests(paths.where("last").select("d1", "d2", "conv_id"))

    zero = F.lit(0).cast("long")
    parts = nodes.select("d1", "d2", "p1", "p2", "depth", "conv_id", "n_convs")
    parts = parts.unionByName(nodes.where("depth > 1").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children")), allowMissingColumns=True)
    parts = parts.unionByName(sums, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    below = parts.groupBy("d1", "d2").agg(
        *(F.max(x).alias(x) for x in ("p1", "p2", "depth", "conv_id", "n_convs", "ends_sha256")),
        *(F.coalesce(F.sum(x), zero).alias(y) for x, y in (("n_children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens"))),
    )
    below = cut_lineage(below)
    # The root is the parent of all first turns, so they take its id as one value and no join has it as a key.
    top = below.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).first()
    every = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    empty = hashlib.sha256(b"").hexdigest()
    turnless = member_digests(conversations.where("size = 0").select(zero.alias("d1"), zero.alias("d2"), "conv_id")).agg(F.max("ends_sha256")).first()[0]
    root = conversations.sparkSession.createDataFrame(
        [(every["least"], 0, None, every["n"], top["n_children"], top["n_leaves"] or 1, top["saved_tokens"] or 0, turnless or empty, (0, 0))] if every["n"] else [],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest struct<d1: long, d2: long>",
    )
    above = below.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    values = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), F.struct("d1", "d2").alias("digest")]
    firsts = below.where("depth = 1").withColumn("parent_conv_id", F.lit(every["least"]).cast("long")).select(*values)
    return root.unionByName(firsts).unionByName(below.where("depth > 1").join(above, ["p1", "p2"]).select(*values))
