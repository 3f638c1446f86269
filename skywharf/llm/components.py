"""Connected components of pairs by alternating stars, with one small job a round and no row for all pairs of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.session import cut_lineage

#: Pairs that one file of a round holds at least, while there are that many.
FILE_PAIRS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b, whole numbers).

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones. Minima are
    combined before the shuffle; the rounds grow with the logarithm of the number of nodes. Ends when a round changes
    nothing. Repeated edges and loops do no harm; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, files, pairs = None, None, cut_lineage(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        linked = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # Rounds never add pairs, so the last count sizes the files of the next round.
        pairs = cut_lineage(linked.coalesce(files) if files else linked)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state, files = now, int(now[0] // FILE_PAIRS) + 1
