"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to one of ``2 ** bits`` cells of a ring. Every shard owns ``points`` cells; a key goes clockwise to the
next owned cell. A shard takes no more than its load bound, and keys that find it full continue clockwise. The bound
here is exact: loads are at most one row apart. Which keys of a cell overflow depends on counts alone, so the ring is
walked over the counted cells (a table of fixed size) and rows are only ranked within their cell.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = "cell int, first long, last long, shard int, base long"


def ring(shards: int, points: int, bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order; a taken cell moves a node to the next free one."""
    cells = 1 << bits
    if shards * points > cells // 2:
        raise ValueError("the ring needs at least two cells for each virtual node")
    taken: dict[int, int] = {}
    for point in range(points):
        for shard in range(shards):
            digest = hashlib.blake2b(f"{shard}/{point}".encode(), digest_size=8).digest()
            cell = int.from_bytes(digest, "big") >> (64 - bits)
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def walk(counts: dict[int, int], shards: int, points: int, bits: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, last rank, shard, slot of the first) of all counted cells.

    Nodes are visited clockwise; each takes what waits at it while its shard has room, in clockwise order of the
    cells, and passes the rest on. The bounds sum to the number of rows, so a few turns place everything.
    """
    nodes, total = ring(shards, points, bits), sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    slots = [0] * shards
    waiting: dict[int, list[list[int]]] = defaultdict(list)
    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting[at % len(nodes)].append([cell, 1, counts[cell]])
    out = []
    while waiting:
        for node in sorted(waiting):
            queue, shard = waiting.pop(node), nodes[node][1]
            passed = []
            for cell, first, last in queue:
                taken = min(room[shard], last - first + 1)
                if taken:
                    out.append((cell, first, first + taken - 1, shard, slots[shard]))
                    room[shard] -= taken
                    slots[shard] += taken
                if first + taken <= last:
                    passed.append([cell, first + taken, last])
            if passed:
                following = (node + 1) % len(nodes)
                while not room[nodes[following][1]]:
                    following = (following + 1) % len(nodes)
                waiting[following] = passed + waiting.get(following, [])
    return out


def cell_of(position: Column, bits: int) -> Column:
    return F.shiftrightunsigned(position, 64 - bits).cast("int")


def assign(docs: DataFrame, shards: int = 24, points: int = 64, bits: int = 14) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    ``rows`` law: counts of shards are at most one apart; slots are gapless from 0. A null text has size 8 and
    checksum 0. Rows without an id are placed by their text. Repeated rows are placed one by one; which of two equal
    rows gets which slot is open. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), text)).alias("_position"),
    ).withColumn("_cell", cell_of(F.col("_position"), bits))
    # At most 2 ** bits counts, whatever the number of rows.
    counts = {row["_cell"]: row["count"] for row in rows.groupBy("_cell").count().collect()}
    segments = docs.sparkSession.createDataFrame(walk(counts, shards, points, bits), SEGMENTS)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_position", "doc_id", "text_crc32", "size")).cast("long")
    placed = rows.withColumn("_rank", rank).join(
        # Bounded by the parameters: one segment for each cell, and one more for each node that a cell overflows.
        F.broadcast(segments), (F.col("_cell") == F.col("cell")) & F.col("_rank").between(F.col("first"), F.col("last")), "left",
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("_rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
