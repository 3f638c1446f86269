"""Word hashes, components and the n-gram join against plain versions."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest

from skywharf.llm import ngram_join
from skywharf.llm.components import components
from skywharf.llm.words import ALNUM, LOWER, hash_spaced, hash_words, spaced_words

TEXTS = ["", " ", "a", "Ab ab\tAB\x0bx", "ünï cödé 漢 字 \x1c \x85 x", "x" * 5000 + " y", "trailing \n", "🙂 🙂"]


def test_words_are_those_of_the_definition():
    for text in TEXTS:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in spaced_words(text)] == re.findall(r"[^\x20\x09-\x0D]+", lowered)
        assert [w.decode() for w in spaced_words(text, ALNUM)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_word_hashes_tell_words_apart():
    rnd = random.Random(3)
    texts = TEXTS + [" ".join(rnd.choice(["tom", "tim", "mit", "ab", "ba", "a", "b", "aa"]) for _ in range(rnd.randint(0, 40))) for _ in range(50)]
    hashed, offsets = hash_spaced([t.encode().translate(LOWER) for t in texts])
    words = [spaced_words(t) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    by = defaultdict(set)
    for word, value in zip((w for x in words for w in x), hashed.tolist()):
        by[word].add(value)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert len(hash_words(words)[0]) == len(hashed)


def test_packed_numbers_return():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (ngram_join.unpack(ngram_join.pack(values, 6), 6) == values).all()
    assert len(ngram_join.unpack(ngram_join.pack(values[:0], 6), 6)) == 0


def requests(rows):
    """Requests of blocks to one shard, from (grams, counts) of each."""
    return pa.table({
        "shard": pa.array([3] * len(rows), pa.int32()), "block": pa.array(range(len(rows)), pa.int32()),
        "grams": pa.array([ngram_join.pack(g, 6) for g, _ in rows], pa.binary()), "counts": pa.array([ngram_join.pack(c, 2) for _, c in rows], pa.binary()),
    })


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_answers_of_a_shard(monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_GRAMS", held, raising=False)
    rnd = np.random.default_rng(5)
    grams = [np.unique(rnd.integers(1 << 47, (1 << 47) + 60, size, dtype=np.uint64)) for size in (1, 5, 40, 200)]
    grams.append(np.array([0, (1 << 48) - 1], dtype=np.uint64))
    rows = [(g, rnd.choice(np.array([1, 1, 2, 65535], dtype=np.uint64), len(g))) for g in grams]
    total = Counter()
    for g, c in rows:
        total.update(dict(zip(g.tolist(), c.tolist())))
    answers = ngram_join._answer(requests(rows)).to_pylist()
    assert [a["block"] for a in answers] == list(range(len(rows)))
    for (g, _), a in zip(rows, answers):
        got = list(zip(ngram_join.unpack(a["grams"], 6).tolist(), ngram_join.unpack(a["counts"], 4).tolist()))
        assert got == [(x, total[x]) for x in g.tolist() if total[x] >= 2]


def test_answers_of_a_large_shard_take_little_memory():
    """A task's Python worker lives beside the heap of the executor: what it holds must not be many times the requests."""
    rnd = np.random.default_rng(6)
    pool = rnd.integers(0, 1 << 48, 1_000_000, dtype=np.uint64)
    rows = [(g, np.ones_like(g)) for g in (np.unique(rnd.choice(pool, 30_000)) for _ in range(60))]
    table, many = requests(rows), sum(len(g) for g, _ in rows)
    tracemalloc.start()
    ngram_join._answer(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * many


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, 5)]
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {x: root(x) for x in linked} and loops


def plain(rows):
    sets = {}
    for key, text in rows:
        words = spaced_words(text)
        sets[key] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    of = {k: k for k in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def check(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain(rows)


def test_join_on_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{oracle.DATA}/sf0.001/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_join_on_groups_of_near_copies(spark, seed):
    """Chains, copies with many edits around the threshold, common passages and tiny texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 400))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(30)], []
    for k in range(60):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy[rnd.randint(0, 12) :])))
    for k in range(60, 90):
        base = list(base)
        base[rnd.randrange(len(base))] = word()
        rows.append((k, " ".join(base)))
    rows += [(k, " ".join(passage + [word() for _ in range(rnd.randint(0, 25))])) for k in range(90, 120)]
    rows += [(k, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8)))) for k in range(120, 160)]
    check(spark, rows)
