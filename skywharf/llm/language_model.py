"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted texts.

Training counts n-grams of all trusted texts, combined in each task before they are shuffled; counts, continuation
counts, discounts and back-off weights are tables sharded by language and n-gram. Scoring splits the documents into
blocks by hash. A block asks the shards once for each of its distinct n-grams, and the answers meet the texts of the
block again, so what moves are the distinct n-grams of blocks and never one row for each character.
Orders up to ORDER are joined as tables. Longer n-grams (the queries use DEPTH characters) grow with the texts: their
counts and the requests of blocks meet in shards by the three characters before the last, which hold every n-gram and
context of four characters or more that a request can back off to. Texts, counts, requests and answers travel as packed
arrays; the counts of a shard with far more n-grams than others are repeated, and the blocks dealt among the copies.
A text is kept while its perplexity is below a threshold from quantiles of held-out trusted texts of its language.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skywharf.llm.packing import expand, pack_grams, pack_rows, pack_whole, squeeze, starts_of, turned, unpack_all, unpack_grams, unpack_rows, unpack_whole
from skywharf.llm.rows import matching, text_batches
from skywharf.llm.words import bounded
from skywharf.session import cut_lineage

ORDER = 3
#: Characters of the n-grams of the queries: the last three are packed in ``g``, those before them in ``u``.
DEPTH = 6
POOLED = "*"
START = 2
#: Of five trusted texts, one sets the thresholds and the others train the model.
HELD_OUT = 5
#: Bytes of text in a block, and of all texts for each shard of the counts.
BLOCK_BYTES = 16_000_000
SHARD_BYTES = 24_000_000
#: N-grams a task holds while it counts or answers: its Python worker lives beside the heap of the executor.
HELD_GRAMS = 500_000
#: Bytes of text whose n-grams are counted at once.
COUNTED_BYTES = 250_000
#: Bytes of a block's texts that are open at once while its n-grams are told apart.
OPENED_BYTES = 4_000_000
#: Numbers that three characters of a text may have: a table of them is small.
NUMBERED = 1 << 20
#: Bytes of text a task holds while it deals documents into blocks.
DEALT_BYTES = 16_000_000
#: Bits of the filter of trusted ids: its size is fixed, so it can go to every task.
FILTER_BITS = 23
#: Characters of average surprise that every text gets on top, so that a short text is not judged by a few characters.
PRIOR = 64
#: Files of tables whose size depends on the alphabet and the languages alone.
TABLE_FILES = 8
#: Histogram steps of a mean surprise of 1 (nat a character).
STEPS = 1000
#: The queries keep a text up to this quantile of the held-out trusted texts of its language.
QUANTILE = 0.99
#: ``shard`` of requests for the last three characters alone.
SHORT = -1


def runs_of(column: pa.ChunkedArray, rows: np.ndarray, most: int = 500_000):
    """(rows, texts) of about ``most`` bytes each, or one text: what a task holds stays small whatever its block."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()[rows]
    group = np.cumsum(sizes, dtype=np.int64) // most
    for part in np.split(rows, np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            yield part, [t or "" for t in column.take(pa.array(part)).to_pylist()]


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (16 bits) of texts end to end, each after ``order`` - 1 start marks; places where n-grams begin; offsets of the texts among these.

    White space runs count as one space and digits as 0; characters above U+FFFF share one code. Every character ends one n-gram.
    """
    clean, marks = [" ".join(t.split()) for t in texts], order - 1
    sizes = np.array([len(t) for t in clean], dtype=np.int64)
    joined = "".join("\x02" * marks + t for t in clean)
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF).astype(np.int64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    # Each text has marks before it, so its n-grams begin so many places further on than those of the text before.
    return codes, np.repeat(marks * np.arange(len(texts)), sizes) + np.arange(offsets[-1]), offsets


def told_apart(texts: list[str], order: int, each: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """Code of each n-gram of texts end to end (null unless ``each``), u and g of each code, and the offsets of the texts.

    ``u`` packs all but the last three characters (16 bits each), ``g`` those. An n-gram is told by the numbers of its first three
    characters and of its last three among those of the texts.
    """
    codes, begins, offsets = characters(texts, order)
    seen = np.flatnonzero(np.bincount(codes))
    base = max(len(seen), 1)
    if base**3 <= NUMBERED:
        digits = np.zeros(1 << 16, dtype=np.int32)
        digits[seen] = np.arange(len(seen))
        digits = digits[codes]
        number = (digits[:-2] * base + digits[1:-1]) * base + digits[2:]
        found = np.flatnonzero(np.bincount(number))
        at = np.zeros(base**3, dtype=np.int64)
        at[found] = np.arange(len(found))
        at = at[number]
        threes = (seen[found // base**2] << 32) | (seen[found // base % base] << 16) | seen[found % base]
    else:
        at, threes = pd.factorize((codes[:-2] << 32) | (codes[1:-1] << 16) | codes[2:])
    which, first, last = numbered(at[begins], at[begins + order - ORDER], len(threes), each)
    return which, threes[first] >> 16 * (2 * ORDER - order), threes[last], offsets


def numbered(first: np.ndarray, last: np.ndarray, many: int, each: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Code of each pair of numbers (the last below ``many``), null unless ``each``, and the pairs of the codes, sorted.

    Numbers of 32 bits take half the memory and time where they are enough.
    """
    key = first * many + last
    if key.max(initial=0) < 1 << 31:
        key = key.astype(np.int32)
    if each:
        codes, found = pd.factorize(key)
        order = np.argsort(found)
        place = np.empty(len(found), dtype=np.int64)
        place[order] = np.arange(len(found))
        codes, found = place[codes], found[order]
    else:
        key.sort()
        codes, found = None, key[np.flatnonzero(np.diff(key, prepend=-1))]
    return codes, *(x.astype(np.int64) for x in np.divmod(found, max(many, 1)))


def distinct(u: np.ndarray, g: np.ndarray, each: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Code of each pair (null unless ``each``), and u and g of each code."""
    (cu, nu), (cg, ng) = pd.factorize(u), pd.factorize(g)
    codes, first, last = numbered(cu, cg, len(ng), each)
    return codes, nu[first], ng[last]


def places(u: np.ndarray, g: np.ndarray, among_u: np.ndarray, among_g: np.ndarray) -> np.ndarray:
    """Place of each pair among distinct pairs, -1 for none."""
    cu, (cg, ng) = pd.factorize(np.append(among_u, u))[0], pd.factorize(np.append(among_g, g))
    key = cu.astype(np.int64) * max(len(ng), 1) + cg
    return pd.Index(key[: len(among_u)]).get_indexer(key[len(among_u) :])


def context(u, g):
    """All characters of packed n-grams but the last, packed in the same way."""
    return u >> 16, (g >> 16) | ((u & 0xFFFF) << 32)


def joined(parts, many: int) -> list[np.ndarray]:
    """Arrays of whole numbers end to end, from parts of ``many`` arrays each."""
    return [np.concatenate([np.empty(0, np.int64), *x]) for x in (list(zip(*parts)) or [[]] * many)]


def contexts(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Order -> u, g of the contexts of its ``levels``; the sum of their counts, and how many n-grams are counted once, twice, more often."""
    out = {}
    for n, (own_u, own_g, c) in found.items():
        of, u, g = distinct(*context(own_u, own_g))
        out[n] = u, g, *(np.bincount(of, x, len(u)).astype(np.int64) for x in (c, c == 1, c == 2, c > 2))
    return out


def answers_to(parts: list[tuple[np.ndarray, np.ndarray]], found: dict[int, tuple[np.ndarray, ...]], around: dict[int, tuple[np.ndarray, ...]]):
    """Packed counts that lists of n-grams, sorted by ``turned``, need: for each order above ORDER those of the n-grams, and those of
    ``contexts`` once for each run of n-grams with that context. What was not counted has 0."""
    codes, u, g = distinct(*(np.concatenate(x) for x in zip(*parts)))
    own = {}
    for n in sorted(found):
        asked = u & ((1 << 16 * (n - ORDER)) - 1)
        at, inside = places(asked, g, *found[n][:2]), places(*context(asked, g), *around[n][:2])
        own[n] = np.append(found[n][2], 0)[at], inside
    sums = {n: [np.append(x, 0) for x in around[n][2:]] for n in own}
    begin = 0
    for part_u, part_g in parts:
        which = codes[begin : begin + len(part_u)]
        begin += len(part_u)
        key = turned(part_u, part_g)
        out = []
        for n, (c, inside) in own.items():
            at = inside[which[starts_of(*key, n - ORDER - 1)]]
            out += [c[which], *(x[at] for x in sums[n])]
        yield pack_whole(*out)


def back_off(u: np.ndarray, g: np.ndarray, told: list[np.ndarray], cuts: dict[int, tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """a and b of n-grams, whose probability is a + b * the probability of their last three characters.

    ``told`` are the counts of ``answers_to``; ``cuts`` the discounts of the orders above ORDER, none without trusted texts.
    """
    a, b = np.zeros(len(u)), np.ones(len(u))
    key = turned(u, g)
    for n, (c, total, *often) in zip(sorted(cuts), (told[k : k + 5] for k in range(0, len(told), 5))):
        starts = starts_of(*key, n - ORDER - 1)
        known, total = total > 0, np.maximum(total, 1)
        weight = np.where(known, sum(d * x for d, x in zip(cuts[n], often)) / total, 1.0)
        weight, total = (np.repeat(x, np.diff(starts, append=len(u))) for x in (weight, total))
        own = np.maximum(c - np.array([0.0, *cuts[n]])[np.minimum(c, 3)], 0.0) / total
        a, b = own + weight * a, weight * b
    return a, b


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id and held (for the thresholds) of documents all of whose labels say good and not toxic."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0")
    return good.select("doc_id", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """lang and packed text of the trusted documents; a fixed-size filter spares most others the shuffle of the exact join.

    Whoever counts the texts opens them: a step of its own would hold a second Python worker beside each that counts.
    So would a broadcast join, with the filter in the same tasks; executors keep such workers, and use all in turn.
    """
    spark = docs.sparkSession
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS).cast("int")
    present = np.zeros(1 << FILTER_BITS, dtype=np.bool_)
    for row in ids.select(place.alias("place")).distinct().toLocalIterator():
        present[row["place"]] = True
    bits = spark.sparkContext.broadcast(np.packbits(present).tobytes())

    def passing(batches):
        own = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)
        for batch in batches:
            found = batch.filter(pa.array(own[batch.column("place").to_numpy()]))
            yield pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("lang"), squeeze(found.column("text"))], ["doc_id", "lang", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    near = docs.where("doc_id IS NOT NULL").select("doc_id", "lang", "text", place.alias("place")).mapInArrow(passing, f"doc_id {kind}, lang string, packed binary")
    return near.join(ids.hint("merge"), "doc_id", "left_semi").select("lang", "packed")


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, u (above ORDER), g, c: n-gram counts of each language and of all languages together."""
    if order > ORDER:

        def opened(batches):
            for batch in batches:
                for lang, grams, counts in zip(*(batch.column(x).to_pylist() for x in ("lang", "grams", "counts"))):
                    u, g = unpack_grams(grams)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "u": u, "g": g, "c": unpack_whole(counts)})

        return shard_counts(texts, order, shard_number(texts)).select("lang", "grams", "counts").mapInArrow(opened, "lang string, u long, g long, c long")

    def count(batches):
        for lang, part in _by_language(batches):
            codes, _, g, _ = told_apart(part, order)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "g": g, "c": np.bincount(codes, minlength=len(g))})

    own = cut_lineage(texts.mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")).coalesce(TABLE_FILES))
    return own.unionByName(own.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "g", "c"))


def _opened(batches):
    """Arrow batches of lang and text, packed or not; few packed texts are open at once."""
    for batch in batches:
        if "packed" not in batch.schema.names:
            yield batch
            continue
        for part in bounded([batch], "packed", COUNTED_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("lang"), expand(part.column("packed"))], ["lang", "text"])


def _by_language(batches):
    """(language key, texts) of pieces of a task's rows."""
    for batch in bounded(_opened(batches), "text", COUNTED_BYTES):
        frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
        for lang, part in frame.groupby(frame["lang"].fillna("").map(lambda x: f"={x}"), sort=False):
            yield lang, [t for t in part["text"] if t]


def text_bytes(texts: DataFrame) -> int:
    """Bytes of texts; not for packed ones."""
    return int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def shard_number(texts: DataFrame) -> int:
    return text_bytes(texts) // SHARD_BYTES + 1


def shard_of(u: np.ndarray, g: np.ndarray, shards: int) -> np.ndarray:
    """Shard of n-grams by the three characters before the last."""
    mixed = turned(u, g)[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of several lists, with the sums of their counts."""
    codes, u, g = distinct(*(np.concatenate(x) for x in zip(*((u, g) for u, g, _ in parts))))
    return u, g, np.bincount(codes, np.concatenate([c for _, _, c in parts]), len(g)).astype(np.int64)


def unpacked(parts: pa.ChunkedArray, most: int):
    """Tables of packed rows, opened until they hold about ``most`` bytes."""
    held, size = [], 0
    for part in parts:
        held.append(unpack_rows([part.as_buffer()]))
        size += held[-1].nbytes
        if size > most:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def by_shard(u: np.ndarray, g: np.ndarray, shards: int):
    """(shard, places) of the n-grams of each shard, sorted by ``turned``."""
    shard = shard_of(u, g, shards)
    order = np.lexsort((*turned(u, g)[::-1], shard))
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield int(shard[part[0]]), part


def shard_counts(texts: DataFrame, order: int, shards: int) -> DataFrame:
    """shard, lang, n, grams, counts: packed n-gram counts, a row for each shard and language and for all together.

    A task adds up what it counts until it holds HELD_GRAMS, so few n-grams are sent twice.
    """

    def send(held):
        for lang, parts in held.items():
            u, g, c = summed(parts)
            for shard, at in by_shard(u, g, shards):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "lang": pa.array([lang], pa.string()),
                    "grams": pa.array([pack_grams(u[at], g[at])], pa.binary()), "counts": pa.array([pack_whole(c[at])], pa.binary()),
                })

    def count(batches):
        held: dict[str, list] = {}
        many = 0
        for lang, part in _by_language(batches):
            codes, u, g, _ = told_apart(part, order)
            held.setdefault(lang, []).append((u, g, np.bincount(codes, minlength=len(g))))
            many += len(g)
            if many > HELD_GRAMS:
                held = {x: [summed(parts)] for x, parts in held.items()}
                many = sum(len(parts[0][1]) for parts in held.values())
                if many > HELD_GRAMS // 2:
                    yield from send(held)
                    held, many = {}, 0
        yield from send(held)

    def merge(table: pa.Table) -> pa.Table:
        held: dict[str, list] = {}
        for lang, grams, counts in zip(*(table.column(x).to_pylist() for x in ("lang", "grams", "counts"))):
            held.setdefault(lang, []).append((*unpack_grams(grams), unpack_whole(counts)))
        sums = {lang: summed(parts) for lang, parts in held.items()}
        sums[POOLED] = summed(list(sums.values()))
        sums = {lang: [x[np.lexsort(turned(*found[:2])[::-1])] for x in found] for lang, found in sums.items()}
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()] * len(sums), pa.int32()), "lang": pa.array(list(sums), pa.string()),
            "n": pa.array([len(g) for _, g, _ in sums.values()], pa.int64()),
            "grams": pa.array([pack_grams(u, g) for u, g, _ in sums.values()], pa.binary()), "counts": pa.array([pack_whole(c) for *_, c in sums.values()], pa.binary()),
        })

    sent = texts.mapInArrow(count, "shard int, lang string, grams binary, counts binary")
    return cut_lineage(sent.groupBy("shard").applyInArrow(merge, "shard int, lang string, n long, grams binary, counts binary"))


def levels(counts: tuple[np.ndarray, np.ndarray, np.ndarray], order: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Order -> (u, g, c) above ORDER; lower orders count the distinct characters seen before."""
    out = {order: counts}
    for n in range(order - 1, ORDER, -1):
        above_u, above_g, _ = out[n + 1]
        seen, own_u, own_g = distinct(above_u & ((1 << 16 * (n - ORDER)) - 1), above_g)
        out[n] = own_u, own_g, np.bincount(seen, minlength=len(own_u))
    return out


def summaries(counts: DataFrame, order: int) -> DataFrame:
    """lang, n, g, n1, n2, n3, n4 of packed counts: how many n-grams of each order above ORDER are seen once to four times
    (g null), and for order ORDER the distinct characters seen before each (n1), to be added up over the shards."""

    def summarise(batches):
        for batch in batches:
            for lang, grams, counted in zip(*(batch.column(x).to_pylist() for x in ("lang", "grams", "counts"))):
                found = levels((*unpack_grams(grams), unpack_whole(counted)), order)
                orders = sorted(found)
                often = np.array([[np.count_nonzero(found[n][2] == k) for k in (1, 2, 3, 4)] for n in orders], dtype=np.int64)
                codes, g = pd.factorize(found[ORDER + 1][1])
                none = np.zeros(len(g), dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * (len(orders) + len(g)), pa.string()), "n": pa.array(orders + [ORDER] * len(g), pa.int32()),
                    "g": pa.concat_arrays([pa.nulls(len(orders), pa.int64()), pa.array(g, pa.int64())]), "n1": np.append(often[:, 0], np.bincount(codes, minlength=len(g))),
                    **{f"n{k}": np.append(often[:, k - 1], none) for k in (2, 3, 4)},
                })

    return counts.select("lang", "grams", "counts").mapInArrow(summarise, "lang string, n int, g long, n1 long, n2 long, n3 long, n4 long").groupBy("lang", "n", "g").agg(
        *(F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4))
    )


def shorter(counts: DataFrame, order: int) -> DataFrame:
    """Counts of the distinct characters seen before the n-grams of an order, from the counts of the order above."""
    return counts.groupBy("lang", _last(F.col("g"), order).alias("g")).agg(F.count("*").alias("c"))


def _last(g: Column, characters: int) -> Column:
    return g.bitwiseAND(F.lit((1 << 16 * characters) - 1))


def discounts(counts: DataFrame, positive: bool = False) -> DataFrame:
    """lang, d1, d2, d3 of one order, from the numbers of n-grams seen once to four times.

    ``positive`` takes k / 2 where these give none above 0: a discount of 0 can leave nothing to n-grams not seen in a
    context, and texts with one get an infinite surprise.
    """
    return from_seen(counts.groupBy("lang").agg(*(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))), positive)


def from_seen(seen: DataFrame, positive: bool) -> DataFrame:
    """``discounts`` from lang, n1, n2, n3, n4; other columns stay."""
    seen = seen.withColumns({f"n{k}": F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4)})
    # Without n-grams seen once or twice there is no share, and the plain sides below apply.
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    raw = {k: F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)}
    sides = {f"d{k}": F.when(usable & (d > 0) if positive else usable, F.greatest(F.lit(0.0), d)).otherwise(k / 2.0) for k, d in raw.items()}
    return seen.withColumns(sides).drop("n1", "n2", "n3", "n4")


def level(counts: DataFrame, order: int, lower: DataFrame | None, positive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Probabilities (lang, g, p) of the n-grams of one order, and back-off weights (lang, h, w) of their contexts.

    ``counts`` has lang, g, c; ``lower`` the probabilities of the order below. Single characters have none and
    interpolate with a uniform share over the characters seen and one for all others.
    """
    discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(discounts(counts, positive), "lang").withColumns({"h": F.shiftright("g", 16), "d": discount})
    contexts = rows.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"), F.count("*").alias("types"))
    share = F.col("freed") / F.col("total")
    weights = contexts.select("lang", "h", "total", (share if lower is not None else share / (F.col("types") + 1)).alias("w"))
    joined = rows.join(weights, ["lang", "h"])
    own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
    if lower is None:
        return joined.select("lang", "g", (own + F.col("w")).alias("p")), weights.select("lang", "h", "w")
    below = lower.select("lang", F.col("g").alias("_low"), F.col("p").alias("_p"))
    full = joined.withColumn("_low", _last(F.col("g"), order - 1)).join(below, ["lang", "_low"])
    return full.select("lang", "g", (own + F.col("w") * F.col("_p")).alias("p")), weights.select("lang", "h", "w")


def fit(texts: DataFrame, order: int = ORDER, shards: int | None = None) -> dict[int, tuple]:
    """Order -> (probabilities, back-off weights). Lower orders count the distinct characters seen before.

    An order above ORDER adds itself -> (packed counts, discounts by language and order, number of shards), for ``long_answers``.
    """
    tables: dict[int, tuple] = {}
    if order > ORDER:
        shards = shards or shard_number(texts)
        packed = shard_counts(texts, order, shards)
        found = cut_lineage(summaries(packed, order).coalesce(TABLE_FILES))
        cuts: dict[str, dict[int, tuple[float, float, float]]] = {}
        # One row for each language and order.
        for row in from_seen(found.where("g IS NULL"), True).toLocalIterator():
            cuts.setdefault(row["lang"], {})[row["n"]] = row["d1"], row["d2"], row["d3"]
        tables[order] = packed, cuts, shards
        counts = {ORDER: found.where("g IS NOT NULL").select("lang", "g", F.col("n1").alias("c"))}
    else:
        counts = {ORDER: count_grams(texts)}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = shorter(counts[n + 1], n)
    lower = None
    for n in range(1, ORDER + 1):
        probabilities, weights = level(counts[n], n, lower, order > ORDER)
        lower = cut_lineage(probabilities.coalesce(TABLE_FILES))
        tables[n] = lower, cut_lineage(weights.coalesce(TABLE_FILES))
    return tables


def copies(counts: DataFrame) -> dict[tuple[int, str], int]:
    """(shard, lang) -> copies of the counts of each shard with over twice the n-grams of the mean; fewer than half of the shards."""
    mean = counts.groupBy("lang").agg(F.avg("n").alias("mean"))
    many = counts.select("shard", "lang", "n").join(F.broadcast(mean), "lang").where("n > 2 * mean")
    return {(r["shard"], r["lang"]): math.ceil(r["n"] / r["mean"]) for r in many.toLocalIterator()}


def long_answers(asked: DataFrame, counts: DataFrame, order: int, split: dict[tuple[int, str], int]) -> DataFrame:
    """block, lang, grams, counts of packed requests (block, lang, shard, model, copy, grams) but those of SHORT; see ``answers_to``."""

    def repeated(batches):
        for batch in batches:
            times = np.array([split.get(x, 1) for x in zip(*(batch.column(x).to_pylist() for x in ("shard", "model")))], dtype=np.int64)
            for copy in range(times.max(initial=0)):
                part = batch.filter(pa.array(times > copy))
                yield part.append_column("copy", pa.array(np.full(part.num_rows, copy), pa.int32()))

    def answer(wanted: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        blocks, langs, grams = ([] if SHORT in wanted.column("shard").to_pylist()[:1] else wanted.column(x).to_pylist() for x in ("block", "lang", "grams"))
        most = HELD_GRAMS
        if grams:
            held = (*unpack_grams(own.column("grams")[0].as_py()), unpack_whole(own.column("counts")[0].as_py())) if own.num_rows else [np.empty(0, np.int64)] * 3
            table = levels(held, order)
            around = contexts(table)
            most = max(most, len(table[order][1]))
        at = 0
        while at < len(grams):
            parts, many, first = [], 0, at
            while at < len(grams) and (not parts or many < most):
                parts.append(unpack_grams(grams[at]))
                many += len(parts[-1][0])
                at += 1
            rows += zip(blocks[first:at], langs[first:at], grams[first:at], answers_to(parts, table, around))
        kinds = {"block": pa.int32(), "lang": pa.string(), "grams": pa.binary(), "counts": pa.binary()}
        return pa.table([pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [[]] * 4, kinds.values())], list(kinds))

    key = ["shard", "model", "copy"]
    own = counts.select("shard", F.col("lang").alias("model"), "grams", "counts").mapInArrow(repeated, "shard int, model string, grams binary, counts binary, copy int")
    return asked.groupBy(*key).cogroup(own.groupBy(*key)).applyInArrow(answer, "block int, lang string, grams binary, counts binary")


def look_up(wanted: DataFrame, tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, g, surprise (negative log probability) of wanted n-grams; languages without a model use the pooled one."""
    known = tables[1][1].select(F.col("lang").alias("_m"))
    out = wanted.join(known, F.col("lang") == F.col("_m"), "left").withColumn("_m", F.coalesce("_m", F.lit(POOLED)))
    p = None
    for order in range(1, ORDER + 1):
        probabilities, weights = tables[order]
        context = F.shiftright(_last(F.col("g"), order), 16)
        out = _joined(out, probabilities, "g", "p", _last(F.col("g"), order), order)
        out = _joined(out, weights, "h", "w", context, order)
        below = F.lit(1.0) if p is None else p
        p = F.coalesce(F.col(f"_p{order}"), F.coalesce(F.col(f"_w{order}"), F.lit(1.0) if order > 1 else F.lit(None)) * below)
    return out.select("lang", "g", (-F.ln(p)).alias("surprise"))


def _joined(rows: DataFrame, side: DataFrame, key: str, value: str, at: Column, order: int) -> DataFrame:
    right = side.select(F.col("lang").alias("_m"), F.col(key).alias("_k"), F.col(value).alias(f"_{value}{order}"))
    return rows.withColumn("_k", at).join(right, ["_m", "_k"], "left").drop("_k")


def deal(docs: DataFrame, blocks: int) -> DataFrame:
    """block, rows: documents (doc_id, text_key, lang, text) dealt into blocks by hash, packed by task and block."""
    key = F.xxhash64("text")
    placed = docs.select("doc_id", key.alias("text_key"), "lang", "text", F.pmod(F.xxhash64("doc_id", key), F.lit(blocks)).cast("int").alias("block"))

    def send(held):
        table = pa.Table.from_batches(held)
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            rows = table.select(["doc_id", "text_key", "lang", "text"]).take(pa.array(part))
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[part[:1]], pa.int32()), "rows": pa.array([pack_rows(rows)], pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in bounded(batches, "text", DEALT_BYTES):
            held.append(batch)
            size += batch.nbytes
            if size > DEALT_BYTES:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return placed.mapInArrow(run, "block int, rows binary")


def surprises(docs: DataFrame, tables: dict[int, tuple], blocks: int | None = None) -> DataFrame:
    """doc_id, text_key, lang, n_chars, surprise (mean over the characters; null without any) of every row of ``docs``."""
    blocks, order = blocks or text_bytes(docs) // BLOCK_BYTES + 1, max(tables)
    long = order > ORDER
    packed, cuts, shards = tables[order] if long else (None, {}, 1)
    split = copies(packed) if long else {}
    dealt = deal(docs, blocks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def by_language(table: pa.Table):
        """(language key, row numbers) of a block."""
        langs = np.array([f"={x or ''}" for x in table.column("lang").to_pylist()], dtype=object)
        for lang in sorted(set(langs)):
            yield lang, np.flatnonzero(langs == lang)

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows, asked = [], {}
        for texts in unpacked(table.column("rows"), OPENED_BYTES):
            for lang, own in by_language(texts):
                found, many, most = asked.get(lang, ([], 0, HELD_GRAMS))
                for _, part in runs_of(texts.column("text"), own, COUNTED_BYTES):
                    found.append(told_apart(part, order, each=False)[1:3])
                    many += len(found[-1][0])
                    if many > most:
                        found = [distinct(*map(np.concatenate, zip(*found)), each=False)[1:]]
                        many = len(found[0][0])
                        # What stays is only added to twice its size, so that it is not sorted out anew for each part.
                        most = max(HELD_GRAMS, 2 * many)
                asked[lang] = found, many, most
        for lang in sorted(asked):
            u, g = distinct(*map(np.concatenate, zip(*asked.pop(lang)[0])), each=False)[1:]
            # One key for each block, so that no task gets these requests of all blocks.
            rows.append((lang, SHORT, "", block, pack_whole(np.unique(g))))
            model = lang if lang in cuts else POOLED
            for shard, at in by_shard(u, g, shards) if long else ():
                rows.append((lang, shard, model, block % split.get((shard, model), 1), pack_grams(u[at], g[at])))
        kinds = {"lang": pa.string(), "shard": pa.int32(), "model": pa.string(), "copy": pa.int32(), "grams": pa.binary()}
        return pa.table([pa.array([block] * len(rows), pa.int32()), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds.values()))], ["block", *kinds])

    def short(batches):
        for batch in batches:
            for block, lang, shard, grams in zip(*(batch.column(x).to_pylist() for x in ("block", "lang", "shard", "grams"))):
                g = unpack_whole(grams) if shard == SHORT else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(g), block), pa.int32()), "lang": pa.array([lang] * len(g), pa.string()), "g": g})

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = unpack_rows([x.as_buffer() for x in table.column("rows")])
        count, mean = np.zeros(texts.num_rows, dtype=np.int64), np.full(texts.num_rows, np.nan)
        is_short = answers.column("grams").is_null().to_numpy()
        langs = answers.column("lang").to_numpy(zero_copy_only=False)
        short_g, short_s = (answers.column(x).to_numpy(zero_copy_only=False) for x in ("g", "surprise"))
        for lang, rows in by_language(texts):
            own = np.flatnonzero((langs == lang) & is_short)
            own = own[np.argsort(short_g[own])]
            known, surprise = short_g[own].astype(np.int64), short_s[own]
            if long:
                given = answers.filter(pa.array((langs == lang) & ~is_short))
                asked_u, asked_g = joined((unpack_grams(x) for x in given.column("grams").to_pylist()), 2)
                # Shards have no context in common, so their runs of contexts stay apart end to end.
                told = joined((unpack_all(x) for x in given.column("counts").to_pylist()), 5 * (order - ORDER))
                a, b = back_off(asked_u, asked_g, told, cuts.get(lang if lang in cuts else POOLED, {}))
                # An n-gram as one number: the places of its two parts among those of the block.
                before = np.unique(asked_u)
                number = np.searchsorted(before, asked_u) * len(known) + np.searchsorted(known, asked_g)
                place = np.argsort(number)
                number, a, b = number[place], a[place], b[place]
            for part, run in runs_of(texts.column("text"), rows):
                codes, u, g, offsets = told_apart(run, order)
                at = np.searchsorted(known, g)
                each = surprise[at]
                if long:
                    which = np.searchsorted(number, np.searchsorted(before, u) * len(known) + at)
                    each = -np.log(a[which] + b[which] * np.exp(-each))
                each = each[codes]
                sums = np.add.reduceat(np.append(each, 0.0), offsets[:-1])
                sizes = np.diff(offsets)
                count[part] = sizes
                mean[part] = np.where(sizes > 0, sums / np.maximum(sizes, 1), np.nan)
        return pa.table([
            texts.column("doc_id"), texts.column("text_key"), texts.column("lang"), pa.array(count), pa.array(mean, from_pandas=True),
        ], ["doc_id", "text_key", "lang", "n_chars", "surprise"])

    # Both kinds of requests read one shuffle of them: no filter or choice of columns tells the two plans apart below it.
    requests = dealt.groupBy("block").applyInArrow(ask, "block int, lang string, shard int, model string, copy int, grams binary").repartition("shard", "model", "copy")
    asked = requests.mapInArrow(short, "block int, lang string, g long").repartition("lang", "g")
    nothing = {x: F.lit(None).cast("binary") for x in ("grams", "counts")}
    answers = asked.join(look_up(asked.select("lang", "g").distinct(), tables), ["lang", "g"]).select("block", "lang", "g", "surprise", *(c.alias(x) for x, c in nothing.items()))
    if long:
        told = long_answers(requests, packed, order, split)
        answers = answers.unionByName(told.withColumns({"g": F.lit(None).cast("long"), "surprise": F.lit(None).cast("double")}))
    # No more files than blocks: small inputs leave few, large ones as many as there are partitions.
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        tell, f"doc_id {kind}, text_key long, lang string, n_chars long, surprise double"
    ).coalesce(blocks)


def averages(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """key, average: surprise of a character of held-out trusted texts, by language and pooled."""
    held = scores.join(ids.where("held").select("doc_id"), "doc_id", "left_semi").where("n_chars > 0 AND surprise IS NOT NULL")
    keyed = held.select(F.explode(F.array(_key(), F.lit(POOLED))).alias("key"), "surprise", "n_chars")
    return keyed.groupBy("key").agg((F.sum(F.col("surprise") * F.col("n_chars")) / F.sum("n_chars")).alias("average"))


def _key() -> Column:
    return F.concat(F.lit("="), F.coalesce("lang", F.lit("")))


def smoothed(scores: DataFrame, means: DataFrame) -> DataFrame:
    """``scores`` with the surprise drawn to the average of its language by PRIOR characters."""
    pooled = means.where(F.col("key") == POOLED).agg(F.max("average")).first()[0]
    own = scores.withColumn("key", _key()).join(means, "key", "left").withColumn("average", F.coalesce("average", F.lit(pooled).cast("double"), "surprise"))
    return own.withColumn("surprise", (F.col("surprise") * F.col("n_chars") + PRIOR * F.col("average")) / (F.col("n_chars") + PRIOR)).drop("average")


def limits(scores: DataFrame, ids: DataFrame, part: float, stretch: float) -> DataFrame:
    """key, limit of the smoothed surprise: from the median of held-out trusted texts ``stretch`` times the way to quantile ``part``.

    Quantiles come from counts in steps of 1 / STEPS, by language and pooled.
    """
    held = scores.join(ids.where("held").select("doc_id"), "doc_id", "left_semi").where("n_chars > 0 AND surprise IS NOT NULL")
    keyed = held.select(F.explode(F.array("key", F.lit(POOLED))).alias("key"), F.ceil(F.col("surprise") * STEPS).alias("bucket"))
    counted = keyed.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    by = Window.partitionBy("key")
    ranked = counted.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "all": F.sum("n").over(by)})
    middle, high = (F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("bucket"))) for q in (0.5, part))
    return ranked.groupBy("key").agg(middle.alias("m"), high.alias("h")).select("key", ((F.col("m") + F.lit(stretch) * (F.col("h") - F.col("m"))) / STEPS).alias("limit"))


def judge(docs: DataFrame, labels: DataFrame, part: float = 0.95, stretch: float = 8.0, order: int = ORDER) -> DataFrame:
    """doc_id, text_key, lang, n_chars, perplexity, threshold and kept of every row of ``docs`` (doc_id, lang, text).

    ``order`` is the length of the n-grams (ORDER to 2 * ORDER). ``labels`` (doc_id, quality, toxic) name the trusted documents; all of them are used. A text is kept while its
    perplexity (smoothed by PRIOR characters) is at most the threshold. A null, empty or blank text has no perplexity
    and is not kept. A language without trusted texts, null included, uses the pooled model and threshold; without any
    trusted text every text with a character is kept. ``text_key`` tells rows of one id with different texts apart;
    repeated rows are judged one by one; other columns are ignored; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    ids = trusted_ids(labels)
    size = text_bytes(docs)
    tables = fit(trusted_texts(docs, ids.where("NOT held")), order, size // SHARD_BYTES + 1)
    raw = cut_lineage(surprises(docs, tables, size // BLOCK_BYTES + 1))
    scores = smoothed(raw, cut_lineage(averages(raw, ids).coalesce(TABLE_FILES)))
    fences = cut_lineage(limits(scores, ids, part, stretch).coalesce(TABLE_FILES))
    pooled = fences.where(F.col("key") == POOLED).agg(F.max("limit")).first()[0]
    joined = scores.join(fences, "key", "left")
    limit = F.coalesce("limit", F.lit(pooled).cast("double"))
    within = F.col("surprise").isNull() | limit.isNull() | (F.col("surprise") <= limit)
    return joined.select(
        "doc_id", "text_key", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp("surprise")).alias("perplexity"), F.exp(limit).alias("threshold"),
        ((F.col("n_chars") > 0) & within).alias("kept"),
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` as the queries use it: n-grams of DEPTH characters, and the plain quantile QUANTILE as threshold."""
    return judge(docs, labels, part=QUANTILE, stretch=1.0, order=DEPTH)


def keep(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``docs`` that were kept, with their own columns."""
    return matching(docs, judged.where("kept"), "left_semi")
