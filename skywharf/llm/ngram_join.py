"""Jaccard join of word shingles by rare-first prefixes, with length, positional and suffix filters.

1. Documents are dealt into blocks by hash. Blocks send the counts of their distinct shingles to shards, as packed
   arrays; shards answer each block with the document frequencies of those found twice or more.
2. In its block, a document orders its shingles rare first. Two linked documents share a shingle within their
   prefixes; shingles of one document alone cannot, so only the others of a prefix are posted.
3. Equal sets are one class, joined through its representative.
4. A posted shingle's group first tests one hub against its members, then only members that are still in different
   components, and only pairs that the length and positional filters let pass. So a group of copies costs as many
   tests as it has members, and no link between components is lost. Each pair is verified once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.llm.components import components
from skywharf.llm.rows import carried, text_batches
from skywharf.llm.words import LOWER, hash_runs, hash_spaced
from skywharf.session import cut_lineage

SIZE = 5
#: Link from 75 % of the union: shared * 7 >= 3 * (size + size), and sizes differ by a quarter at most.
PERCENT = 75
BLOCK_BYTES = 6_000_000
SHARD_BYTES = 16_000_000
CHUNK = 750_000
#: Frequencies are counted for the upper 48 bits of a shingle's hash: shingles that share them share a frequency.
COUNTED = np.uint64(16)
#: Shingles of a shard that a task counts at once: its Python worker lives beside the heap of the executor.
HELD_GRAMS = 200_000


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and their offsets.

    Texts below SIZE words have their whole sequence as one shingle; texts without words have none.
    """
    parts, sizes, k = [], [], 0
    while k < len(texts):
        chunk, length = [], 0
        while k < len(texts) and (not chunk or length < CHUNK):
            chunk.append(_bytes(texts[k]))
            length += len(chunk[-1])
            k += 1
        hashed, offsets = hash_spaced(chunk)
        runs = hash_runs(hashed, SIZE)
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = np.unique(runs[first : last - SIZE + 1]) if last - first >= SIZE else hash_runs(hashed[first:last], last - first)[: last > first]
            parts.append(own)
            sizes.append(len(own))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64), offsets


def pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers as planes of bytes: the high planes of sorted numbers compress well in a shuffle."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int, first: int = 0, last: int | None = None) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)[:, first:last]
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def prefix_size(n):
    """Shingles of a prefix: a linked document shares one of them at least."""
    return n - (PERCENT * n + 99) // 100 + 1


def block_count(text_bytes: int) -> int:
    return int(text_bytes // BLOCK_BYTES) + 1


def _ask(shards: int):
    bits = np.uint64(48 - (shards.bit_length() - 1))

    def ask(table: pa.Table) -> pa.Table:
        found, _ = shingle_sets(table.column("text").to_pylist())
        found >>= COUNTED
        found.sort()
        starts = np.flatnonzero(np.diff(found, prepend=~found[:1]))
        distinct, counts = found[starts], np.minimum(np.diff(starts, append=len(found)), 65535)
        cuts = np.searchsorted(distinct >> bits, np.arange(shards + 1).astype(np.uint64))
        full = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
        return pa.table({
            "shard": pa.array(full, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int32()),
            "grams": pa.array([pack(distinct[cuts[s] : cuts[s + 1]], 6) for s in full], pa.binary()),
            "counts": pa.array([pack(counts[cuts[s] : cuts[s + 1]], 2) for s in full], pa.binary()),
        })

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """For each block, the grams that occur in two documents or more, with their frequencies.

    The sorted grams of all blocks are opened and counted range by range, HELD_GRAMS or so at once.
    """
    packed, counted = ([x.as_buffer() for x in table.column(k)] for k in ("grams", "counts"))
    least, most = min(int(unpack(x, 6, 0, 1)[0]) for x in packed), max(int(unpack(x, 6, -1)[0]) for x in packed) + 1
    ranges = sum(x.size for x in packed) // (6 * HELD_GRAMS) + 1
    borders = np.array([least + (most - least) * k // ranges for k in range(1, ranges)], dtype=np.uint64)
    cuts = np.array([[0, *np.searchsorted(unpack(x, 6), borders), x.size // 6] for x in packed])
    found: list[list] = [[] for _ in packed]
    for first, last in zip(cuts.T[:-1].tolist(), cuts.T[1:].tolist()):
        grams = np.concatenate([unpack(x, 6, a, b) for x, a, b in zip(packed, first, last)])
        counts = np.concatenate([unpack(x, 2, a, b) for x, a, b in zip(counted, first, last)])
        codes, distinct = pd.factorize(grams)
        frequency = np.bincount(codes, weights=counts, minlength=len(distinct)).astype(np.uint64)
        each = np.minimum(frequency, np.uint64(2**32 - 1))[codes]
        ends = np.cumsum(np.subtract(last, first)).tolist()
        for own, a, b in zip(found, [0, *ends], ends):
            kept = each[a:b] >= 2
            own.append((grams[a:b][kept], each[a:b][kept].astype(np.uint32)))
    columns = [pa.array([pack(np.concatenate([part[k] for part in own]), width) for own in found], pa.binary()) for k, width in ((0, 6), (1, 4))]
    return pa.table([table.column("block"), *columns], ["block", "grams", "counts"])


def _post(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Size, fingerprint and posted shingles of each document of a block; the whole set of those that post any."""
    found, offsets = shingle_sets(table.column("text").to_pylist())
    sizes = np.diff(offsets)
    grams = np.concatenate([np.empty(0, np.uint64), *(unpack(x, 6) for x in answers.column("grams").to_pylist() if x)])
    counts = np.concatenate([np.empty(0, np.uint64), *(unpack(x, 4) for x in answers.column("counts").to_pylist() if x)])
    order = np.argsort(grams)
    grams, counts = np.append(grams[order], np.uint64(2**64 - 1)), np.append(counts[order], np.uint64(1))
    at = np.searchsorted(grams, found >> COUNTED)
    frequency = np.where(grams[at] == found >> COUNTED, counts[at], 1)
    single = np.concatenate([[0], np.cumsum(frequency == 1)])
    tokens, places, sets = [], [], []
    for n, first, last in zip(sizes.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        alone, prefix = int(single[last] - single[first]), prefix_size(n)
        if n and alone < prefix:
            own, often = found[first:last], frequency[first:last]
            shared = np.flatnonzero(often > 1)
            ranked = shared[np.lexsort((own[shared], often[shared]))][: prefix - alone]
            tokens.append(own[ranked].view(np.int64))
            places.append(np.arange(alone, alone + len(ranked), dtype=np.int32))
            sets.append(own.view(np.int64))
        else:
            tokens.append(None)
            places.append(None)
            sets.append(None)
    mixed = found * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (found, mixed)]
    prints = [(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]
    return pa.table([
        table.column("doc_id"), table.column("text_key"), pa.array(sizes, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.array(tokens, pa.list_(pa.int64())),
        pa.array(places, pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.int64())),
    ], ["doc_id", "text_key", "n", "print1", "print2", "tokens", "places", "shingles"])


def posted(docs: DataFrame, text_bytes: int) -> DataFrame:
    """doc_id, text_key, n, print1, print2, tokens, places, shingles of every row of ``docs``."""
    blocks = block_count(text_bytes)
    shards = 1 << max(int(text_bytes // SHARD_BYTES), 1).bit_length()
    key = F.xxhash64("text")
    blocked = docs.select("doc_id", "text", key.alias("text_key"), F.pmod(F.xxhash64("doc_id", key), F.lit(blocks)).cast("int").alias("block"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = blocked.groupBy("block").applyInArrow(_ask(shards), "shard int, block int, grams binary, counts binary")
    answers = asked.groupBy("shard").applyInArrow(_answer, "block int, grams binary, counts binary")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _post, f"doc_id {kind}, text_key long, n long, print1 long, print2 long, tokens array<long>, places array<int>, shingles array<long>"
    )


def _may_link(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Length filter and positional filter of two documents that share a shingle at these places of their orders."""
    longest, shortest = F.greatest(n, m), F.least(n, m)
    rest = F.least(n - place, m - other)
    return (100 * shortest >= PERCENT * longest) & ((100 + PERCENT) * rest >= PERCENT * (n + m))


def _suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Most shingles two sets can share, from their counts in 16 ranges of the hash."""
    pivots = (np.arange(1, 16, dtype=np.int64) << 60) + np.iinfo(np.int64).min
    x, y = (np.diff(np.concatenate([[0], np.searchsorted(s, pivots), [len(s)]])) for s in (a, b))
    return int(np.minimum(x, y).sum())


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link: suffix filter, then the exact intersection, once for each pair."""
    left, right = (sets.select(F.col("_row").alias(x), F.col("shingles").alias(f"{x}_set")) for x in ("a", "b"))

    def check(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keep = []
                for a, b in zip(part.column("a_set"), part.column("b_set")):
                    x, y = np.sort(a.values.to_numpy()), np.sort(b.values.to_numpy())
                    least = -(-PERCENT * (len(x) + len(y)) // (100 + PERCENT))
                    keep.append(_suffix_bound(x, y) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(check, "a long, b long")


def links(postings: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """Pairs that join every linked representative to its component. ``postings``: token, place, n, _row.

    What is written in between takes at most ``files`` files.
    """
    # The hub has the fewest rarer shingles before this one: of a group of copies it is the one nearest to their origin.
    hubs = postings.groupBy("token").agg(F.min(F.struct("place", "_row", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    spoke = postings.join(hubs, "token").where((F.col("_row") != F.col("hub._row")) & _may_link(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place")))
    tested = cut_lineage(spoke.select(F.least("hub._row", "_row").alias("a"), F.greatest("hub._row", "_row").alias("b")).distinct().coalesce(files))
    found = cut_lineage(verify(tested, sets).coalesce(files))
    of = components(found).select(F.col("node").alias("_row"), "component")
    placed = postings.join(of, "_row", "left").withColumn("component", F.coalesce("component", "_row"))
    # The largest partner that the positional filter lets a member have at this shingle.
    placed = placed.withColumn("most", F.floor((100 + PERCENT) * (F.col("n") - F.col("place")) / PERCENT) - F.col("n"))
    spread = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).where("low <> high")
    opened = cut_lineage(placed.join(spread.select("token", "least"), "token").where("most >= least").drop("least", "most").coalesce(files))
    other = opened.select("token", *(F.col(x).alias(f"o_{x}") for x in ("place", "n", "_row", "component")))
    apart = (F.col("_row") < F.col("o__row")) & (F.col("component") != F.col("o_component"))
    crossing = opened.join(other, "token").where(apart & _may_link(F.col("n"), F.col("place"), F.col("o_n"), F.col("o_place")))
    fresh = crossing.select(F.col("_row").alias("a"), F.col("o__row").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    return found.unionByName(verify(fresh, sets))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    The shingles are the distinct runs of five words (A-Z lower-cased, split at ASCII white space); a text with fewer
    words has its whole sequence as one. Rows link from a Jaccard similarity of 0.75; component_id is the smallest
    doc_id that links reach. Null and blank texts have no shingles, link with nothing and are their own component.
    Rows without an id take part; a component of such rows alone has a null id. Repeated rows fall into one component.
    ``kept`` marks the row of the smallest id, told by ``text_key`` from rows of the same id; rows equal in both are
    all marked. Other columns are ignored; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # No more files than blocks: small inputs leave few, large ones as many as there are partitions.
    files = block_count(text_bytes)
    # Written once, so that row numbers stay when a task is repeated.
    rows = cut_lineage(posted(docs, text_bytes).coalesce(files).withColumn("_row", F.monotonically_increasing_id()))
    same = ["n", "print1", "print2"]
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    classes = cut_lineage(rows.where("n > 0").groupBy(*same).agg(F.min("_row").alias("class"), F.min(first).alias("first")).coalesce(files))
    chosen = rows.where("tokens IS NOT NULL").join(classes.select(F.col("class").alias("_row")), "_row", "left_semi")
    postings = chosen.select("_row", "n", F.explode(F.arrays_zip("tokens", "places")).alias("p")).select("_row", "n", F.col("p.tokens").alias("token"), F.col("p.places").alias("place"))
    of = components(links(cut_lineage(postings.coalesce(files)), chosen.select("_row", "shingles"), files))
    named = classes.join(of, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("first").alias("best"))
    labelled = named.join(least, "component").select(*(F.col(x).alias(f"_{x}") for x in same), "best")
    equal = (F.col("n") == F.col("_n")) & (F.col("print1") == F.col("_print1")) & (F.col("print2") == F.col("_print2"))
    joined = rows.select("doc_id", "text_key", *same).join(labelled, equal, "left")
    kept = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.key")))
    return joined.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, and all rows without shingles, with the columns of ``docs``."""
    good = groups(docs).where("kept").groupBy("doc_id", "text_key").agg((F.max("n_shingles") > 0).alias("one"))
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("text_key"))
    rows = carried(docs).join(good, same).select("row", "row_id", "row_key", F.when(F.col("one"), F.lit(0)).otherwise(F.monotonically_increasing_id()).alias("alone"))
    # Rows equal in id and text are copies of each other; those without words stay as they are.
    return rows.dropDuplicates(["row_id", "row_key", "alone"]).select("row.*")
