"""Periodic runs against plain comparison of every word with the one a period further on."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import oracle
import pytest

from skywharf.llm import catalog, periodic_runs


def plain_runs(s, least=12):
    found = {}
    for q in range(1, len(s) // 2 + 1):
        same = [a == b for a, b in zip(s, s[q:])] + [False]
        start = None
        for j, equal in enumerate(same):
            if equal and start is None:
                start = j
            elif not equal and start is not None:
                if j + q - start >= max(least, 2 * q):
                    found.setdefault((start, j + q), q)
                start = None
    return sorted((a, b - a, q) for (a, b), q in found.items())


def found_runs(s):
    return list(zip(*(x.tolist() for x in periodic_runs.find(np.array([*s, 10**6])))))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_short_alphabets(seed):
    """Random words, repeated phrases that break off, and mirrored or doubled stretches whose borders repeat with many periods."""
    rnd = random.Random(seed)
    total = 0
    for _ in range(400):
        kind, letters = rnd.random(), rnd.choice([1, 2, 2, 3])
        if kind < 0.4:
            s = [rnd.randrange(letters) for _ in range(rnd.randint(1, 160))]
        elif kind < 0.7:
            s = []
            while len(s) < 100:
                s += [rnd.randrange(letters) for _ in range(rnd.randint(1, 20))] * rnd.randint(1, 7)
                s = s[: len(s) - rnd.randint(0, 3)]
        else:
            s = ([rnd.randrange(2) for _ in range(rnd.randint(1, 4))] * 40)[: rnd.randint(5, 70)]
            s = s[::-1] + s if rnd.random() < 0.5 else s + s[rnd.randint(0, 3) :] + s
            s[rnd.randrange(len(s))] ^= rnd.randint(0, 1)
        assert found_runs(s) == plain_runs(s), s
        total += len(plain_runs(s))
    assert total > 300


def test_successor_of_a_range():
    rnd = random.Random(2)
    for size in (1, 2, 7, 64, 65):
        values = rnd.sample(range(100), size)
        tree = periodic_runs.WaveletTree(np.array(values), 100)
        for _ in range(60):
            a, b, x = rnd.randint(0, size), rnd.randint(0, size), rnd.randint(-1, 100)
            a, b = min(a, b), max(a, b)
            got = tree.successor(*(np.array([v]) for v in (a, b, x)))[0]
            assert got == min([v for v in values[a:b] if v > x], default=-1)


def test_long_repeats_take_little_time():
    started = time.time()
    assert found_runs([1] * 200_000) == [(0, 200_000, 1)]
    assert found_runs([*range(5)] * 40_000) == [(0, 200_000, 5)]
    assert time.time() - started < 60


def plain_row(doc_id, text, rewrite):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_on_given_documents(spark):
    folder = f"{oracle.DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows, with_runs = catalog.QUERIES["op13_periodic_runs"](spark, folder).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        if len((texts[r["doc_id"]] or "").split()) > 1500:
            continue
        runs, text = plain_row(r["doc_id"], texts[r["doc_id"]], True)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        expected = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (r["n_runs"], (r["start"], r["length"], r["period"], r["exponent_milli"])) == (len(runs), expected)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs >= 5


def test_texts_of_a_batch_do_not_mix(spark):
    """Repeats across texts are no runs; nulls, blanks, repeated rows and rows without an id have defined results."""
    phrase = " ".join("abcdefg")
    docs = [(1, f"{phrase} {phrase}"), (1, f"{phrase} {phrase}"), (2, phrase), (3, phrase), (None, "x " * 12), (4, None), (5, " \n\t"), (6, "é\x85 " * 13 + "end")]
    rows = periodic_runs.runs(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_words"], r["collapsed"]) for r in rows]
    assert got == [
        (1, 14, [(0, 14, 7)], 7, phrase), (1, 14, [(0, 14, 7)], 7, phrase), (2, 7, [], 7, phrase), (3, 7, [], 7, phrase), (None, 12, [(0, 12, 1)], 1, "x"),
        (4, 0, [], 0, ""), (5, 0, [], 0, ""), (6, 14, [(0, 13, 1)], 2, "é\x85 end"),
    ]
