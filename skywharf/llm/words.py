"""Words of whole texts as bytes, and 64-bit hashes of word sequences, for batches inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z become lower case, all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER; ASCII bytes other than letters and digits become spaces.
ALNUM = bytes(c if (c := LOWER[b]) in _WORD_BYTES else 32 for b in range(256))


def spaced_words(text: str | None, table: bytes = LOWER) -> list[bytes]:
    """Words between the ASCII white space 09-0D and 20 (what ``bytes.split`` uses); none for null.

    ``table`` is applied before: LOWER for lower-cased words, ALNUM for words of letters and digits.
    """
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNDO = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def hash_spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space of all texts, end to end, and the offsets of the texts.

    A word's hash is a polynomial of its bytes, taken as a difference of running sums, so no word is made an object.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    space = _SPACES[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    powers = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * powers[:-1], out=sums[1:])
    powers[1:] = _UNDO
    np.cumprod(powers, out=powers)
    hashed = (sums[ends] - sums[starts]) * powers[starts]
    hashed ^= hashed >> np.uint64(32)
    hashed *= _MIX
    hashed ^= hashed >> np.uint64(29)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return hashed, np.searchsorted(starts, begins + 1)


def hash_words(batch: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, end to end, and the offsets of its texts."""
    offsets = np.zeros(len(batch) + 1, dtype=np.int64)
    np.cumsum([len(words) for words in batch], out=offsets[1:])
    flat = np.empty(offsets[-1], dtype=object)
    at = 0
    for words in batch:
        flat[at : at + len(words)] = words
        at += len(words)
    hashed = pd.util.hash_array(flat, categorize=True) if at else np.empty(0, dtype=np.uint64)
    return hashed, offsets


def hash_runs(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; runs across texts are for the caller to leave out."""
    count = max(len(hashed) - size + 1, 0)
    runs = np.full(count, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        runs *= _STEP
        runs += hashed[k : k + count]
    runs ^= runs >> np.uint64(31)
    runs *= _MIX
    runs ^= runs >> np.uint64(29)
    return runs


def bounded(batches, column: str, most: int = 2_000_000):
    """Arrow batches cut so that each holds about ``most`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for first, last in zip(cuts, cuts[1:]):
            if last > first:
                yield batch.slice(first, last - first)
