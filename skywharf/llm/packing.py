"""Arrays and rows as compressed bytes, for tables whose rows each carry many values through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _zstd(level: int = 3) -> pa.Codec:
    """Made where it is used: a codec cannot be sent to tasks."""
    return pa.Codec("zstd", compression_level=level)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes: equal high bytes stand side by side."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").reshape(-1).astype(np.int64, copy=False)


def pack_whole(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, after how many they are and how many numbers they hold; small where these are from 0."""
    sizes = np.array([len(x) for x in arrays], dtype=np.int64)
    head = np.array([len(arrays), sizes.sum()], dtype="<u8").tobytes()
    return head + _zstd(9).compress(b"".join(map(_planes, [sizes, *arrays])), asbytes=True)


def unpack_all(data: bytes) -> list[np.ndarray]:
    many, total = np.frombuffer(data, "<u8", 2).astype(np.int64)
    plain = np.frombuffer(_zstd().decompress(data[16:], int(many + total) * 8), dtype=np.uint8)
    sizes = _whole(plain[: many * 8])
    return list(map(_whole, np.split(plain[many * 8 :], np.cumsum(sizes * 8))[:many]))


def unpack_whole(data: bytes) -> np.ndarray:
    return unpack_all(data)[0]


def turned(u: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six characters (three in u, three in g) as the three before the last, and the second, the first and the last.

    Sorted by these, n-grams with equal characters before the last stand together, whatever their length.
    """
    return (g >> 16) | ((u & 0xFFFF) << 32), ((u >> 16 & 0xFFFF) << 32) | (u >> 32 << 16) | (g & 0xFFFF)


def starts_of(inner: np.ndarray, outer: np.ndarray, characters: int) -> np.ndarray:
    """Where ``turned`` n-grams begin to differ in the three characters before the last or so many before these."""
    return np.flatnonzero((np.diff(inner, prepend=-1) != 0) | (np.diff(outer >> 16 * (3 - characters), prepend=-1) != 0))


def pack_grams(u: np.ndarray, g: np.ndarray) -> bytes:
    """Pairs in their order, small where it is that of ``turned``: characters that stay are held once."""
    inner, outer = turned(u, g)
    first, starts = np.flatnonzero(np.diff(inner, prepend=-1)), starts_of(inner, outer, 2)
    inside = np.diff(np.searchsorted(starts, first), append=len(starts))
    return pack_whole(np.diff(inner[first], prepend=0), inside, outer[starts] >> 16, np.diff(starts, append=len(u)), outer & 0xFFFF)


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, inside, before, sizes, last = unpack_all(data)
    inner, before = np.repeat(np.repeat(np.cumsum(steps), inside), sizes), np.repeat(before, sizes)
    return ((before & 0xFFFF) << 32) | (before >> 16 << 16) | (inner >> 32), ((inner & 0xFFFFFFFF) << 16) | last


def pack_shares(values: np.ndarray) -> bytes:
    """Numbers from 0 without the last 20 of their 64 bits (rounded: they are off by 2^-33 of themselves at most), equal neighbours once."""
    kept = (values.view(np.int64) + (1 << 19)) >> 20
    starts = np.flatnonzero(np.diff(kept, prepend=-1))
    return pack_whole(kept[starts], np.diff(starts, append=len(kept)))


def unpack_shares(data: bytes) -> np.ndarray:
    kept, sizes = unpack_all(data)
    return (np.repeat(kept, sizes) << 20).view(np.float64)


def squeeze(texts: pa.Array) -> pa.Array:
    """Each text as its length in bytes and compressed bytes; null stays."""
    codec = _zstd(9)
    plain = (None if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist())
    return pa.array([None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in plain], pa.binary())


def expand(packed: pa.Array) -> pa.Array:
    codec = _zstd()
    plain = (None if t is None else codec.decompress(t[8:], int.from_bytes(t[:8], "little")).to_pybytes() for t in packed.to_pylist())
    return pa.array(plain, pa.binary()).cast(pa.string())


def pack_rows(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=_zstd(9))) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_rows(parts: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(part).read_all() for part in parts])
