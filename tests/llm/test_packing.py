"""Packed arrays and rows give back what went in."""

import numpy as np
import pyarrow as pa
import pytest

from skywharf.llm import packing


@pytest.mark.parametrize("size", [0, 1, 1000])
def test_round_trips(size):
    rnd = np.random.default_rng(size)
    u, g = rnd.integers(0, 1 << 48, size), rnd.integers(0, 1 << 48, size)
    u[::2] = 5
    order = np.lexsort((g, u))
    u, g = u[order], g[order]
    got_u, got_g = packing.unpack_grams(packing.pack_grams(u, g))
    assert (got_u == u).all() and (got_g == g).all() and len(got_u) == len(got_g) == size
    assert (packing.unpack_whole(packing.pack_whole(g)) == g).all()
    shares = np.repeat(rnd.random(size), 2)
    shares[: size // 2] = 0
    assert np.allclose(packing.unpack_shares(packing.pack_shares(shares)), shares, rtol=2**-32, atol=0)


def test_texts_and_rows():
    texts = pa.array(["a", None, "", "é漢😀 " * 1000])
    assert packing.expand(packing.squeeze(texts)).equals(texts)
    table = pa.table({"doc_id": [1, None, 3, 3], "text": texts})
    assert packing.unpack_rows([packing.pack_rows(table), packing.pack_rows(table.slice(0, 1))]).combine_chunks().equals(pa.concat_tables([table, table.slice(0, 1)]).combine_chunks())
