"""Language model, mixture, contamination, ring and pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from skywharf.llm import decontaminate, language_model, mixing, ngram_join, quality_rules, shards

import corpus_pipeline

from test_words_and_joins import plain as plain_groups  # noqa: E402

DIR = f"{oracle.DATA}/sf0.001"


def letters(text):
    return ["0" if "0" <= c <= "9" else min(c, "￿") for c in " ".join((text or "").split())]


class KneserNey:
    """Interpolated modified Kneser-Ney trigrams, in plain dictionaries."""

    def __init__(self, texts):
        self.counts = {3: Counter()}
        for text in texts:
            chars = ["\x02", "\x02", *letters(text)]
            self.counts[3].update(tuple(chars[k : k + 3]) for k in range(len(chars) - 2))
        for order in (2, 1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discounts, self.totals, self.freed = {}, {}, {}
        for order, counts in self.counts.items():
            n = Counter(counts.values())
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                self.discounts[order] = [max(0.0, k - (k + 1) * y * n[k + 1] / n[k]) for k in (1, 2, 3)]
            else:
                self.discounts[order] = [0.5, 1.0, 1.5]
            self.totals[order], self.freed[order] = Counter(), Counter()
            for g, c in counts.items():
                self.totals[order][g[:-1]] += c
                self.freed[order][g[:-1]] += self.discounts[order][min(c, 3) - 1]

    def probability(self, g):
        order = len(g)
        below = self.probability(g[1:]) if order > 1 else 1 / (len(self.counts[1]) + 1)
        total = self.totals[order][g[:-1]]
        if not total:
            return below
        c = self.counts[order][g]
        return (max(c - self.discounts[order][min(c, 3) - 1], 0) if c else 0) / total + self.freed[order][g[:-1]] / total * below

    def surprise(self, text):
        chars = ["\x02", "\x02", *letters(text)]
        return [-math.log(self.probability(tuple(chars[k : k + 3]))) for k in range(len(chars) - 2)]


class Long(KneserNey):
    """Interpolated modified Kneser-Ney n-grams of DEPTH characters, in plain dictionaries."""

    def __init__(self, texts):
        n = language_model.DEPTH
        self.counts = {n: Counter()}
        for text in texts:
            chars = ["\x02"] * (n - 1) + letters(text)
            self.counts[n].update(tuple(chars[k : k + n]) for k in range(len(chars) - n + 1))
        for order in range(n - 1, 0, -1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discounts, self.totals, self.freed = {}, {}, {}
        for order, counts in self.counts.items():
            seen = Counter(counts.values())
            if seen[1] and seen[2] and seen[3]:
                y = seen[1] / (seen[1] + 2 * seen[2])
                raw = [k - (k + 1) * y * seen[k + 1] / seen[k] for k in (1, 2, 3)]
                self.discounts[order] = [d if d > 0 else (k + 1) / 2 for k, d in enumerate(raw)]
            else:
                self.discounts[order] = [0.5, 1.0, 1.5]
            self.totals[order], self.freed[order] = Counter(), Counter()
            for g, c in counts.items():
                self.totals[order][g[:-1]] += c
                self.freed[order][g[:-1]] += self.discounts[order][min(c, 3) - 1]

    def mean(self, text):
        each = self.surprise(text)
        return sum(each) / len(each)

    def surprise(self, text):
        n = language_model.DEPTH
        chars = ["\x02"] * (n - 1) + letters(text)
        return [-math.log(self.probability(tuple(chars[k : k + n]))) for k in range(len(chars) - n + 1)]


def plain_quality(spark, docs, labels, part=0.95, stretch=8.0, model=KneserNey):
    """doc_id -> (perplexity, threshold, kept)"""
    good = {k for k in {d for d, _, _ in labels} if all(q == 1 and t == 0 for d, q, t in labels if d == k)}
    held = {r["i"] for r in spark.createDataFrame([(k,) for k in good], "i long").where(F.pmod(F.xxhash64(F.lit("held"), "i"), F.lit(5)) == 0).collect()}
    texts = {k: (t, lang) for k, t, lang in docs}
    langs = {texts[k][1] for k in good - held if k in texts}
    models = {lang: model([texts[k][0] for k in good - held if k in texts and texts[k][1] == lang]) for lang in langs}
    models[None] = model([texts[k][0] for k in good - held if k in texts])
    raw = {k: models[lang if lang in langs else None].surprise(t) for k, (t, lang) in texts.items()}
    mine = {lang: [k for k in held if k in texts and raw[k] and lang in (None, texts[k][1])] for lang in {x for _, x in texts.values()} | {None}}
    average = {lang: sum(sum(raw[k]) for k in ks) / sum(len(raw[k]) for k in ks) for lang, ks in mine.items() if ks}
    smooth = {k: (sum(raw[k]) + 64 * average.get(lang, average[None])) / (len(raw[k]) + 64) for k, (_, lang) in texts.items()}
    limit = {}
    for lang, ks in mine.items():
        if ks:
            steps = sorted(math.ceil(smooth[k] * 1000) for k in ks)
            at = lambda q: steps[max(math.ceil(q * len(steps) - 1e-9), 1) - 1]
            limit[lang] = (at(0.5) + stretch * (at(part) - at(0.5))) / 1000
    return {k: (math.exp(smooth[k]), math.exp(limit.get(lang, limit[None])), bool(raw[k]) and smooth[k] <= limit.get(lang, limit[None])) for k, (_, lang) in texts.items()}


def given(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    return docs, labels


def test_model_on_given_documents(spark):
    docs, labels = given(spark)
    expected = plain_quality(spark, [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labels)
    rows = language_model.judge(docs.repartition(3), spark.read.parquet(f"{DIR}/labels.parquet")).collect()
    for r in rows:
        perplexity, threshold, kept = expected[r["doc_id"]]
        assert math.isclose(r["perplexity"], perplexity, rel_tol=1e-9) and math.isclose(r["threshold"], threshold, rel_tol=1e-9) and r["kept"] == kept
    assert len(rows) == len(expected)


def test_trusted_texts_are_not_read_and_counted_by_one_task(spark, tmp_path):
    """A broadcast join would put both steps in a task, and an executor would keep two Python workers for each of its cores."""
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    spark.createDataFrame([(k, "en", f"text {k}") for k in range(30)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/docs")
    ids = language_model.trusted_ids(spark.read.parquet(f"{tmp_path}/labels"))
    texts = language_model.trusted_texts(spark.read.parquet(f"{tmp_path}/docs"), ids)
    assert texts.count() == 10
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_probabilities_of_a_context_sum_to_one(spark):
    texts = ["abracadabra banana", "cabana band", "a bad cad", "dab", "abc abd abe"]
    model = KneserNey(texts)
    seen = sorted({g[0] for g in model.counts[1]})
    for context in (("a", "b"), ("z", "a"), ("z", "z")):
        rest = model.probability((*context, "?"))
        assert math.isclose(sum(model.probability((*context, c)) for c in seen) + rest, 1.0)
    tables = language_model.fit(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    grams = [("a", "b", "r"), ("z", "a", "b"), ("z", "z", "?"), ("\x02", "\x02", "a"), ("n", "a", "n")]
    wanted = spark.createDataFrame([("=en", sum(ord(c) << 16 * (2 - k) for k, c in enumerate(g))) for g in grams] + [("=xx", ord("q"))], "lang string, g long")
    got = {r["g"]: r["surprise"] for r in language_model.look_up(wanted, tables).where("lang = '=en'").collect()}
    assert all(math.isclose(got[sum(ord(c) << 16 * (2 - k) for k, c in enumerate(g))], -math.log(model.probability(g))) for g in grams)


def test_model_rejects_junk_and_keeps_clean_texts(spark):
    folder = f"{oracle.DATA}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in language_model.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()}
    rows = labels.where("toxic = 0").collect()
    good, bad = ([kept[r["doc_id"]] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.35


@pytest.mark.parametrize("seed", range(3))
def test_water_filling(spark, seed):
    rnd = random.Random(seed)
    names = [None if k == 7 else f"s{k}" for k in range(9)]
    rows = [(k, rnd.choice(names[: rnd.randint(1, 9)]), " w" * rnd.choice([0, 1, 3, 10, 40])) for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).select("row.*", "size", "source_size", "target", "copies", "taken").collect()
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        share = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        if not (over := {s for s in order if s not in capped and share[s] > 2 * sizes[s]}):
            break
        capped |= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], share[r["source"]], rel_tol=1e-12)
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - share[s]) <= largest[s] / 2 + 1 for s in order)


def test_mix_is_seeded_and_repeats_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    once, again = (sorted(map(tuple, mixing.mix(docs.repartition(k)).select("row.doc_id", "taken").collect())) for k in (2, 5))
    assert once == again
    assert mixing.repeat(mixing.mix(docs)).columns == docs.columns


def plain_overlap(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    doc, hit, found = words(text), set(), set()
    for key, item in items:
        w = words(item)
        size = min(13, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
        for k in range(len(doc) - size + 1):
            if tuple(doc[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add(key)
    return len(doc), len(hit), found


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, seed):
    """Shared spans of every length around 13, short items, repeated words and items inside items."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdé") + str(rnd.randint(0, 30))
    items = [(k, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for k in range(25)]
    items += [(25, "a a a a a a a a a a a a a a"), (26, ""), (27, items[0][1]), (28, items[7][1] + " tail")]
    rows = []
    for k in range(150):
        parts = [word() for _ in range(rnd.randint(0, 20))]
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(items)[1].split()
            at = rnd.randrange(len(w) + 1)
            parts += w[at : at + rnd.choice([5, 11, 12, 13, 14, 40])] + [word() for _ in range(rnd.randint(0, 9))]
        rows.append((k, ", ".join(parts).upper().replace("É", "é") if k % 3 else " ".join(parts)))
    rows.append((150, "a " * 40))
    got = {r["doc_id"]: r for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, text in rows:
        n, hit, found = plain_overlap(text, items)
        assert (got[k]["n_words"], got[k]["n_hit"], set(got[k]["item_ids"])) == (n, hit, found), (k, text)
        assert got[k]["contaminated"] == (hit > 0 and 20 * hit >= n) and sum(s["end"] - s["first"] for s in got[k]["spans"]) == hit


def test_fingerprints_guarantee_shared_spans():
    rnd = random.Random(11)
    for _ in range(300):
        span = [f"w{rnd.randint(0, 9)}".encode() for _ in range(13)]
        a, b = ([f"x{rnd.randint(0, 99)}".encode() for _ in range(rnd.randint(0, 20))] + span + [f"y{rnd.randint(0, 99)}".encode() for _ in range(rnd.randint(0, 20))] for _ in range(2))
        one, two = decontaminate.fingerprints([a, b], ())
        assert set(one.tolist()) & set(two.tolist())


def plain_ring(positions, count, points=64, bits=14):
    """Shard of each key: keys go round by round to the next node clockwise that has room, in ring order."""
    nodes = shards.ring(count, points, bits)
    room = [len(positions) // count + (s < len(positions) % count) for s in range(count)]
    cells = [node[0] for node in nodes]
    waiting, out = defaultdict(list), {}
    for key in sorted(positions, key=positions.get):
        cell = positions[key] >> (64 - bits)
        waiting[next((k for k, c in enumerate(cells) if c >= cell), 0)].append(key)
    while waiting:
        for node in sorted(waiting):
            queue, shard = waiting.pop(node), nodes[node][1]
            out.update(dict.fromkeys(queue[: room[shard]], shard))
            left, room[shard] = queue[room[shard] :], max(room[shard] - len(queue), 0)
            if left:
                following = (node + 1) % len(nodes)
                while not room[nodes[following][1]]:
                    following = (following + 1) % len(nodes)
                waiting[following] = left + waiting.get(following, [])
    return out


def test_ring(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/sf0.01/documents.parquet")
    rows = shards.assign(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    positions = {r["doc_id"]: r["p"] % 2**64 for r in docs.select("doc_id", F.xxhash64(F.col("doc_id"), F.lit(None).cast("string")).alias("p")).collect()}
    assert {r["doc_id"]: r["shard"] for r in rows} == plain_ring(positions, 24)
    assert sorted(map(tuple, shards.assign(docs.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_another_shard_moves_few_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    few, more = (dict(shards.assign(docs, shards=k).select("doc_id", "shard").collect()) for k in (24, 25))
    moved = sum(few[k] != more[k] for k in few) / len(few)
    assert moved < 0.08  # the fair share of the new shard is 4 %


def test_quality_rules_keep_clean_and_reject_junk(spark):
    folder = f"{oracle.DATA}/sf0.1"
    rows = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic = 0 AND n_words >= 10").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_buckets_hold_their_numbers(spark):
    values = [*range(300), 999, 1000, 4095, 4096, 10**6, 10**12]
    frame = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality_rules.bucket_of(F.col("v")))
    rows = frame.withColumn("top", quality_rules.top_of(F.col("b"))).orderBy("v").collect()
    assert all(r["v"] <= r["top"] <= r["v"] * 1.04 for r in rows) and [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    assert all(r["v"] == r["top"] for r in rows if r["v"] < 64)


def test_pipeline(spark):
    """Every stage against its plain version on the stage's own input."""
    docs, labels = given(spark)
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = plain_quality(spark, [(k, r["text"], r["lang"]) for k, r in rows.items()], labels, language_model.QUANTILE, 1.0, Long)
    left = {k: rows[k] for k, (_, _, good) in kept.items() if good}
    out = corpus_pipeline.STAGES[0][1](spark, docs, DIR)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(left)
    groups = plain_groups([(k, r["text"]) for k, r in left.items()])
    left = {k: r for k, r in left.items() if groups[k][0] == 0 or groups[k][1] == k}
    left = {k: r for k, r in left.items() for n, hit, _ in [plain_overlap(r["text"], items)] if not (hit and 20 * hit >= n)}
    final = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in final} <= set(left)
    words = sum(len(r["text"].split()) for r in left.values())
    taken = sum(len(left[r["doc_id"]]["text"].split()) for r in final)
    assert abs(taken - 1.5 * words) < 0.05 * words
    mixed = mixing.mix(spark.createDataFrame(list(left.values()), docs.schema)).select("row.doc_id", "copies").collect()
    assert Counter(r["doc_id"] for r in final) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    counts = Counter(r["shard"] for r in final)
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1
