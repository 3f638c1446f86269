"""Benchmark decontamination by winnowing.

The fingerprint of a text keeps the smallest k-gram hash of every window of consecutive k-grams. Two texts that share
``SPAN`` words share all k-grams of one window at least, so they share a fingerprint: no shared span of that length is
missed. Fingerprints of documents are joined with those of items, and each hit is extended word by word.
Items below SPAN words have no full window; their whole sequence is the fingerprint, looked up at every place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.llm.rows import matching, text_batches
from skywharf.llm.words import ALNUM, bounded, hash_runs, hash_words, spaced_words
from skywharf.session import cut_lineage

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Bits of the filter built from item fingerprints: its size is fixed, so it can go to every task.
FILTER_BITS = 20


def fingerprints(batch: list[list[bytes]], short: tuple[int, ...]) -> list[np.ndarray]:
    """Winnowed k-gram hashes of each text, and hashes of all runs of the ``short`` lengths (as signed longs)."""
    hashed, offsets = hash_words(batch)
    grams = hash_runs(hashed, GRAM)
    runs = {size: hash_runs(hashed, size) for size in short}
    kept = max(len(grams) - WINDOW + 1, 0)
    least = grams[:kept].copy()
    for k in range(1, WINDOW):
        np.minimum(least, grams[k : k + kept], out=least)
    out = []
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        parts = [least[first : max(last - SPAN + 1, first)]]
        parts += [runs[size][first : max(last - size + 1, first)] for size in short]
        out.append(np.unique(np.concatenate(parts)).view(np.int64))
    return out


def item_fingerprints(items: DataFrame) -> DataFrame:
    """_item (its words, spaced), item_id, n, fps of each distinct item with words."""

    def scan(batches):
        for batch in bounded(batches, "text"):
            words = [spaced_words(t, ALNUM) for t in batch.column("text").to_pylist()]
            full = fingerprints(words, ())
            rows = {"item_id": batch.column("item_id"), "words": pa.array([b" ".join(w) for w in words], pa.binary()), "n": pa.array([len(w) for w in words], pa.int32())}
            prints = []
            for w, fps in zip(words, full):
                if 0 < len(w) < SPAN:
                    fps = hash_runs(hash_words([w])[0], len(w)).view(np.int64)
                prints.append(fps)
            yield pa.RecordBatch.from_pydict(rows | {"fps": pa.array(prints, pa.list_(pa.int64()))})

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(scan, f"item_id {kind}, words binary, n int, fps array<long>").where("n > 0")


def scan_documents(docs: DataFrame, short: tuple[int, ...], bits) -> DataFrame:
    """doc_id, text_key, n_words, fps that pass the filter, and the words of documents that have any."""

    def scan(batches):
        passing = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in bounded(batches, "text"):
            words = [spaced_words(t, ALNUM) for t in batch.column("text").to_pylist()]
            prints = [fps[passing[fps.view(np.uint64) >> np.uint64(64 - FILTER_BITS)] > 0] for fps in fingerprints(words, short)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_words": pa.array([len(w) for w in words], pa.int64()),
                "fps": pa.array(prints, pa.list_(pa.int64())), "words": pa.array([b" ".join(w) if len(f) else None for w, f in zip(words, prints)], pa.binary()),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(scan, f"doc_id {kind}, text_key long, n_words long, fps array<long>, words binary")


def _windows(item: bytes) -> tuple[int, frozenset]:
    words = item.split(b" ")
    size = min(SPAN, len(words))
    return size, frozenset(b" ".join(words[k : k + size]) for k in range(len(words) - size + 1))


def extend(text: bytes, items: list[tuple[object, bytes]], known: dict[bytes, tuple[int, frozenset]]) -> tuple[list[tuple[int, int]], list]:
    """Merged (first, end) word spans of ``text`` inside windows of items, and the ids of items that occur.

    ``known`` keeps the windows of items between calls; it is emptied when it holds 1,000 items.
    """
    if len(known) > 1000:
        known.clear()
    words = text.split(b" ")
    runs: dict[int, list[bytes]] = {}
    starts: set[tuple[int, int]] = set()
    found = []
    for item_id, item in items:
        if item not in known:
            known[item] = _windows(item)
        size, windows = known[item]
        if size not in runs:
            runs[size] = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
        hits = [(k, k + size) for k, run in enumerate(runs[size]) if run in windows]
        if hits:
            found.append(item_id)
            starts.update(hits)
    spans: list[tuple[int, int]] = []
    for first, end in sorted(starts):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((first, end))
    return spans, found


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, spans (word places inside item windows), n_hit, item_ids, contaminated of every row of ``docs``.

    ``docs`` (doc_id, text), ``items`` (item_id, text). A window is 13 consecutive words of an item, or the whole item
    if it has fewer. A null text has no words; an item without words is never found; an item without an id marks words
    but is not listed. Repeated rows are judged one by one, repeated items count once. Other columns are ignored. An
    empty table of items leaves every document clean; an empty table of documents gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    prints = cut_lineage(item_fingerprints(items).dropDuplicates(["item_id", "words"]))
    short = tuple(sorted(r["n"] for r in prints.where(F.col("n") < SPAN).select("n").distinct().collect()))  # 12 lengths at most
    exploded = prints.select("item_id", "words", F.explode("fps").alias("fp"))
    places = exploded.select(F.shiftrightunsigned("fp", 64 - FILTER_BITS).cast("int").alias("place")).distinct()
    passing = np.zeros(1 << FILTER_BITS, dtype=np.uint8)
    for row in places.toLocalIterator():  # as many places as the filter has bits, at most
        passing[row["place"]] = 1
    bits = spark.sparkContext.broadcast(passing.tobytes())
    # Written once, so that the row numbers stay when a task is repeated.
    scanned = cut_lineage(scan_documents(docs, short, bits).withColumn("_row", F.monotonically_increasing_id()))
    hits = scanned.where(F.size("fps") > 0).select("_row", F.explode("fps").alias("fp")).join(exploded, "fp")
    candidates = hits.select("_row", "item_id", "words").distinct().groupBy("_row").agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    kind = items.schema["item_id"].dataType.simpleString()

    def verify(batches):
        known: dict[bytes, tuple[int, frozenset]] = {}
        for batch in bounded(batches, "words"):
            rows = [extend(t, [(i["item_id"], i["words"]) for i in found], known) for t, found in zip(batch.column("words").to_pylist(), batch.column("items").to_pylist())]
            spans = [[{"first": a, "end": b} for a, b in s] for s, _ in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                pa.array([[x for x in ids if x is not None] for _, ids in rows], pa.list_(batch.schema.field("items").type.value_type.field("item_id").type)),
            ], ["_row", "spans", "item_ids"])

    verified = scanned.select("_row", "words").join(candidates, "_row").mapInArrow(
        verify, f"_row long, spans array<struct<first: long, end: long>>, item_ids array<{kind}>"
    )
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<first: long, end: long>>"))
    joined = scanned.select("_row", "doc_id", "text_key", "n_words").join(verified, "_row", "left").select(
        "doc_id", "text_key", "n_words", spans.alias("spans"), F.array_distinct(F.coalesce(F.col("item_ids"), F.array().cast(f"array<{kind}>"))).alias("item_ids"),
    ).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"]))
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their own columns; ``text_key`` tells rows of one id apart."""
    return matching(docs, overlaps(docs, items).where("contaminated"), "left_anti")
