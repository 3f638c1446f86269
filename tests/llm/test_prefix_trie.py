"""Conversation tries against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from skywharf.llm import catalog, prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            told[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(v, key=lambda x: x[:2])] for c, v in told.items()}
    built, nodes, below = {}, defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below[p])
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def found_trie(conversations):
    rows = prefix_trie.trie(*prefix_trie.grafted(prefix_trie.ordered(conversations))).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=lambda x: x[:2])


def invented(seed, many=260):
    """Few texts, so prefixes are shared; null turns, roles and texts; long, equal and turnless conversations."""
    rnd = random.Random(seed)
    rows = []
    for c in range(0, many, rnd.choice([1, 3])):
        length = rnd.choice([1, 1, 2, 3, 5, 8, 23])
        turns = [None, *range(-1, length)][: length + 1] if rnd.random() < 0.2 else range(length)
        rows += [(c, t, rnd.choice(["user", None, ""]) if k == 0 else "assistant", rnd.choice(["a", "bb 🙂", "", None]) if k < 4 or rnd.random() < 0.1 else "same") for k, t in enumerate(turns)]
    return rows + [(None, 0, "user", "no conversation")] * 2


def test_given_conversations(spark):
    folder = f"{oracle.DATA}/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in catalog.QUERIES["op12_prefix_trie"](spark, folder).collect()), key=lambda x: x[:2])
    assert got == plain_trie(rows)


@pytest.mark.parametrize("segment, shard_rows, listed", [(1000, 200_000, 4096), (3, 40, 2)])
def test_segments_shards_and_lists_change_nothing(spark, monkeypatch, segment, shard_rows, listed):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(prefix_trie, "LISTED", listed)
    rows = invented(segment)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("cell", "k", "n", "h", "shard", "depth", "d1")})
    assert found_trie(frame.repartition(3)) == plain_trie(rows)


def test_cells_of_turn_numbers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL", 2)
    rows = invented(5, 40)
    assert found_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain_trie(rows)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found_trie(empty) == []
    conversations = spark.createDataFrame([(7, 0), (3, 0), (11, 0)], "conv_id long, size long")
    turns = spark.createDataFrame([], "conv_id long, depth long, h1 long, h2 long, chars long")
    assert [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(turns, conversations).collect()] == [(3, 0, None, 3, 0, 1, 0, hashlib.sha256(b"3,7,11").hexdigest())]


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 1000):
        first, second = (rng.integers(-(1 << 63), 1 << 63, size, dtype=np.int64) for _ in range(2))
        first[: size // 2] = first[0] if size else 0
        table = prefix_trie.NodeTable(first, second)
        assert sorted(table.slots(first, second)) == list(range(size))
        assert (table.slots(first, second + 1) == -1).all()


def test_a_shared_opening_leaves_a_shard_as_one_row(spark):
    """A first turn that a third of the conversations share is one row a shard, not one a conversation."""
    import pyarrow as pa

    many = 3000
    rows = pa.table({"shard": pa.array([0] * many, pa.int32()), "conv_id": list(range(many)), "depth": [1] * many, "segment": [0] * many, "d1": [5] * (many // 3) + list(range(10, 10 + many - many // 3)),
                     "d2": [1] * many, "p1": [0] * many, "p2": [0] * many, "chars": [4] * many, "last": [True] * many})
    out = prefix_trie.local_nodes(rows).to_pylist()
    shared = [r for r in out if r["d1"] == 5]
    assert len(out) == many - many // 3 + 1 and shared[0]["members"] == shared[0]["ends"] == many // 3 and shared[0]["least"] == 0
