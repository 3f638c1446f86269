"""Periodic runs of words: every maximal stretch that repeats itself, found by internal pattern matching.

The texts of a batch are laid end to end as word numbers, each text with numbers of its own and a mark of its own behind
it, so that nothing matches across texts. Doubling names all runs of 2^k words and leaves the suffix array of the places
whose first two words come again in their text. A run of period q holds an aligned block of L words, 2L - 1 <= q, within
its first period, and that block comes again q places further on. So each dyadic block asks for its occurrences in the
window of the next 4L places: a wavelet tree over the suffix array gives the range successor in the block's interval.
Occurrences closer than L / 2 form a progression, which is stepped over as one; blocks and progressions give candidate
periods, and the names give how far a candidate extends, from the longest to the shortest.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from skywharf.llm.rows import text_batches
from skywharf.llm.words import bounded

#: Fewest words of a run.
LEAST = 12
#: Words of the shortest dyadic block. A run of at least LEAST words has one before its last period whatever the period.
BLOCK = 2
#: Bytes of text that are searched as one.
BATCH_BYTES = 1_000_000


class Names:
    """Names of all runs of 2^k symbols, equal for equal runs, and the suffix array of the places that come again.

    ``levels[k][i]`` names the 2^k symbols from place i. Names keep the order of runs, so the places of one name of any
    level are one interval of ``order``, which holds the places whose first BLOCK symbols occur elsewhere. ``symbols``
    ends with a symbol that occurs nowhere else.
    """

    def __init__(self, symbols: np.ndarray):
        size = len(symbols)
        first = np.argsort(symbols, kind="stable")
        self.levels = [self._named(first, symbols[first], np.arange(size), np.empty(size, dtype=np.int64))]
        self.order, slots = self._open(first, np.arange(size))
        reach, repeated = 1, np.empty(0, dtype=np.int64)
        while len(self.order):
            name = self.levels[-1]
            # A place within reach of the end covers the last symbol, so its name is its own and it is closed by now.
            key = name[self.order] * size + name[self.order + reach]
            by = np.argsort(key, kind="stable")
            placed = self.order[by]
            self.levels.append(self._named(placed, key[by], slots, name.copy()))
            self.order, slots = self._open(placed, slots)
            repeated = self.order if reach == 1 else repeated
            reach *= 2
        self.order, self.at = repeated[np.argsort(self.levels[-1][repeated])], {}

    @staticmethod
    def _named(places: np.ndarray, keys: np.ndarray, slots: np.ndarray, name: np.ndarray) -> np.ndarray:
        """``name`` with the slot of the first of equal keys for each of ``places``, which are in order of their keys."""
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, dtype=bool)
        name[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))] if len(keys) else 0
        return name

    def _open(self, places: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (and their slots) whose name another place has too."""
        names = self.levels[-1][places]
        same = names[1:] == names[:-1]
        more = np.append(same, False) | np.append(False, same)
        return places[more], slots[more]

    def interval(self, k: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First slot of ``order`` with the name that each place has on level k, and the slot behind the last."""
        if k not in self.at:
            self.at[k] = self.levels[k][self.order]
        return np.searchsorted(self.at[k], self.levels[k][places], "left"), np.searchsorted(self.at[k], self.levels[k][places], "right")

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal symbols from x and y on, for x < y."""
        x, y, start = x.copy(), y.copy(), x
        for k in range(len(self.levels) - 1, -1, -1):
            fits = y + (1 << k) <= len(self.levels[0])
            same = fits & (self.levels[k][x] == self.levels[k][np.where(fits, y, 0)])
            x[same] += 1 << k
            y[same] += 1 << k
        return x - start

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal symbols before x and y, for x < y."""
        x, y, start = x.copy(), y.copy(), x
        for k in range(len(self.levels) - 1, -1, -1):
            fits = x >= 1 << k
            same = fits & (self.levels[k][np.where(fits, x - (1 << k), 0)] == self.levels[k][np.where(fits, y - (1 << k), 1)])
            x[same] -= 1 << k
            y[same] -= 1 << k
        return start - x


class WaveletTree:
    """Numbers of a sequence by their bits, for the next larger number within a range of places."""

    def __init__(self, values: np.ndarray, most: int):
        self.values, self.bits, self.ones = values, max(int(most).bit_length(), 1), []
        row = values
        for bit in range(self.bits - 1, -1, -1):
            one = (row >> bit & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(one)))
            row = np.concatenate([row[~one], row[one]])

    def _walk(self, low: np.ndarray, high: np.ndarray, choose):
        for bit, ones in zip(range(self.bits - 1, -1, -1), self.ones):
            zeros_all = len(ones) - 1 - ones[-1]
            one_low, one_high = ones[low], ones[high]
            zeros = (high - low) - (one_high - one_low)
            right = choose(bit, zeros)
            low, high = np.where(right, zeros_all + one_low, low - one_low), np.where(right, zeros_all + one_high, high - one_high)

    def successor(self, low: np.ndarray, high: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Smallest number larger than ``above`` in places low to high, -1 for none."""
        smaller = np.zeros(len(low), dtype=np.int64)

        def counting(bit, zeros):
            right = (above + 1) >> bit & 1 == 1
            np.add(smaller, zeros, out=smaller, where=right)
            return right

        self._walk(low, high, counting)
        rank, found = smaller.copy(), np.zeros(len(low), dtype=np.int64)

        def picking(bit, zeros):
            right = rank >= zeros
            np.subtract(rank, zeros, out=rank, where=right)
            found[right] |= 1 << bit
            return right

        self._walk(low, high, picking)
        return np.where(smaller < high - low, found, -1)


def candidates(names: Names, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs of level k: each run whose period lies in the range of blocks of 2^k symbols has one inside."""
    length = 1 << k
    nearest, farthest = (1 if length == BLOCK else 2 * length - 1), 4 * length - 2
    blocks = names.order[names.order % length == 0]
    low, high = names.interval(k, blocks)
    low, high, blocks = low[high - low > 1], high[high - low > 1], blocks[high - low > 1]
    places, periods = [], []

    def offer(at, period):
        fits = (period >= nearest) & (period <= farthest)
        places.append(at[fits])
        periods.append(period[fits])

    last = blocks
    while len(blocks):
        found = tree.successor(low, high, last)
        inside = (found >= 0) & (found - blocks <= farthest)
        blocks, low, high, last, found = (x[inside] for x in (blocks, low, high, last, found))
        gap = found - last
        offer(blocks, found - blocks)
        # Two occurrences this close: the block has this period, and what follows is a progression to the end of its stretch.
        dense = 2 * gap <= length
        if dense.any():
            b, x, p = blocks[dense], last[dense], gap[dense]
            start, end = x - names.behind(x, x + p), x + p + names.ahead(x, x + p)
            own_start, own_end = b - names.behind(b, b + p), b + p + names.ahead(b, b + p)
            offer(b, p)
            offer(b, end - own_end)
            offer(b, start - own_start)
            # Stretches that touch repeat around their border with every member of the progression.
            touching = (start <= own_end) & (start > own_start)
            if touching.any():
                first, upto = x[touching], np.minimum(end[touching] - length, b[touching] + farthest)
                many = np.maximum((upto - first) // p[touching] + 1, 0)
                which = np.repeat(np.arange(len(first)), many)
                step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                offer(b[touching][which], first[which] + step * p[touching][which] - b[touching][which])
            found = found.copy()
            found[dense] = x + (end - length - x) // p * p
        last = found
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))


def find(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of every maximal run of at least max(``least``, 2 * period) symbols, by start and period.

    ``symbols`` (whole numbers) ends with one that occurs nowhere else; ``least`` is 9 or more.
    """
    if least < 9:
        raise ValueError("runs of fewer than 9 symbols need shorter blocks")
    nothing = np.empty(0, dtype=np.int64)
    names = Names(symbols) if len(symbols) else None
    if names is None or not len(names.order):
        return nothing, nothing, nothing
    tree = WaveletTree(names.order, len(symbols))
    found = [candidates(names, tree, k) for k in range(1, len(names.levels))]
    place, period = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([place, period]), axis=1)
    place, period = pairs[:, pairs.sum(axis=0) < len(symbols)]
    start, end = place - names.behind(place, place + period), place + period + names.ahead(place, place + period)
    long = (end - start >= 2 * period) & (end - start >= least)
    start, end, period = start[long], end[long], period[long]
    # The runs of multiples of a period have the same ends as the run of the period itself.
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.empty(0, dtype=bool)
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def repeated_tail(doc_id: int, count: int) -> np.ndarray | None:
    """Word numbers of the text that the query searches for every tenth id by hash: a tail that repeats; None for other texts."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not count:
        return None
    g = h // 10
    a = g % count
    p = 1 + (count - a) // (3 + g % 8)
    at = np.arange(count)
    return np.where(at >= a, a + (at - a) % p, at)


def runs(docs: DataFrame, rewrite=None, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), kept_words and collapsed of every row of ``docs`` (doc_id, text).

    Words are what stands between the ASCII white space 09-0D and 20, counted from 0. A run is a maximal stretch of words
    with its smallest period, of at least max(``least``, 2 * period) words. ``collapsed`` is the text without the words
    that a run holds behind its first period, joined by one space. ``rewrite(doc_id, count)`` may give the numbers of the
    words to search in place of the text's own.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``; repeated rows and rows without an id
    are searched one by one (``rewrite`` is not asked without an id); an empty table gives an empty result; other columns
    are ignored. A text is searched whole, in memory that grows with its words: about 8 bytes a word for each doubling of
    its longest repeat.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches):
        for batch in bounded(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id").to_pylist()
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            if rewrite:
                for k, own in enumerate(words):
                    at = rewrite(ids[k], len(own)) if ids[k] is not None else None
                    if at is not None:
                        words[k] = [own[i] for i in at.tolist()]
            sizes = np.array([len(own) for own in words], dtype=np.int64)
            flat = np.empty(int(sizes.sum()), dtype=object)
            flat[:] = [w for own in words for w in own]
            codes, distinct = pd.factorize(flat)
            text = np.repeat(np.arange(len(words)), sizes)
            begins = np.cumsum(sizes + 1) - sizes - 1
            ends = begins + sizes
            # Numbers of the words of one text, and behind each text a number that nothing else has.
            symbols = np.empty(len(flat) + len(words), dtype=np.int64)
            symbols[np.arange(len(flat)) + text] = codes + text * np.int64(len(distinct) + 1)
            symbols[ends] = np.int64(len(distinct)) + np.arange(len(words)) * np.int64(len(distinct) + 1)
            start, length, period = find(symbols, least)
            owner = np.searchsorted(begins, start, "right") - 1
            change = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            dropped = np.cumsum(change)[:-1] > 0
            cuts = np.searchsorted(owner, np.arange(len(words) + 1))
            collapsed, kept = [], []
            for k, own in enumerate(words):
                if cuts[k + 1] > cuts[k]:
                    own = [own[i] for i in np.flatnonzero(~dropped[begins[k] : ends[k]]).tolist()]
                kept.append(len(own))
                collapsed.append(b" ".join(own).decode("utf-8", "surrogatepass"))
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begins[owner] if len(start) else start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(sizes, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
                "kept_words": pa.array(kept, pa.int64()), "collapsed": pa.array(collapsed, pa.string()),
            })

    return docs.select("doc_id", "text").mapInArrow(
        search, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_words long, collapsed string"
    )
