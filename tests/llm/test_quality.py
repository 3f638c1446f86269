"""Thresholds and n-grams of the quality queries."""

import math
import random
from collections import defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest

from skywharf.llm import language_model
from skywharf.llm.packing import pack_grams, pack_rows, turned

from test_stages import Long, given, plain_quality  # noqa: E402


def test_threshold_is_a_quantile_of_held_out_texts(spark):
    """No threshold lies above the worst held-out text of its language, and at least 99 % of them are kept."""
    folder = f"{oracle.DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = {r["doc_id"] for r in language_model.trusted_ids(labels).where("held").collect()}
    seen, limit = defaultdict(list), {}
    for r in language_model.quality(docs, labels).collect():
        limit[r["lang"]] = r["threshold"]
        if r["doc_id"] in held and r["perplexity"] is not None:
            seen[r["lang"]].append(r["perplexity"])
    assert len(seen) >= 4
    for lang, values in seen.items():
        assert math.log(limit[lang]) <= math.log(max(values)) + 1 / language_model.STEPS
        assert sum(v <= limit[lang] for v in values) >= 0.99 * len(values)


def test_query_on_given_documents(spark):
    """Perplexity, threshold and verdict of every document, with the settings of the query."""
    docs, labels = given(spark)
    expected = plain_quality(spark, [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labels, language_model.QUANTILE, 1.0, Long)
    rows = language_model.quality(docs.repartition(3), spark.read.parquet(f"{oracle.DATA}/sf0.001/labels.parquet")).collect()
    assert len(rows) == len(expected)
    for r in rows:
        perplexity, threshold, kept = expected[r["doc_id"]]
        assert math.isclose(r["perplexity"], perplexity, rel_tol=1e-9) and math.isclose(r["threshold"], threshold, rel_tol=1e-9) and r["kept"] == kept


def test_one_trusted_text_repeated(spark):
    """No n-gram is seen once or twice: the plain discounts apply, and nothing divides by 0."""
    docs = spark.createDataFrame([(k, "the same words again", "en") for k in range(3)] + [(9, "other words", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3)], "doc_id long, quality int, toxic int")
    assert all(r["perplexity"] > 0 for r in language_model.quality(docs, labels).collect())


def test_long_grams_equal_plain_kneser_ney(spark):
    texts = [("en", "abracadabra banana bandana and a cabana band"), ("en", "a bad cad had a banana 12 times"), ("de", "das band der bananen und das bad der anden"), ("de", "das rad")]
    tables = language_model.fit(spark.createDataFrame(texts, "lang string, text string"), language_model.DEPTH)
    models = {x: Long([t for lang, t in texts if x in (lang, None)]) for x in ("en", "de", None)}
    asked = [(1, "en", "a banana band"), (2, "de", "a banana band"), (3, "fr", "das bad and  zzz 9"), (4, None, "b"), (5, "en", "")]
    rows = language_model.surprises(spark.createDataFrame(asked, "doc_id long, lang string, text string"), tables).collect()
    got = {r["doc_id"]: r["surprise"] for r in rows}
    assert len(rows) == 5 and got[5] is None
    for k, lang, text in asked[:4]:
        assert math.isclose(got[k], models[lang if lang in models else None].mean(text), rel_tol=1e-9)


def test_every_text_has_a_finite_surprise(spark):
    """Copies make counts of counts that rise (more n-grams seen four times than three times)."""
    texts = ["abcdefgh", "abcdefxy", *["the same line again"] * 4, *["another one twice"] * 2, *["three of these"] * 3]
    tables = language_model.fit(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"), language_model.DEPTH)
    asked = spark.createDataFrame([(1, "en", "the same lime"), (2, "en", "anothex thse")], "doc_id long, lang string, text string")
    assert all(math.isfinite(r["surprise"]) for r in language_model.surprises(asked, tables).collect())


def test_counts_grow_with_the_texts(spark):
    """Four times the trusted text gives more than twice the n-grams."""
    rows = spark.read.parquet(f"{oracle.DATA}/sf0.01/documents.parquet").where("lang = 'en'").orderBy("doc_id").select("lang", "text")
    few, many = (language_model.count_grams(rows.limit(n), language_model.DEPTH).where("lang = '=en'").count() for n in (50, 200))
    assert many > 2 * few


def test_trusted_texts_are_opened_where_they_are_counted(spark):
    """One Python worker a task: no step before the count opens the texts, and the counts are those of the plain texts."""
    texts = [(k, lang, f"text {k} of the words {k % 3}") for k, lang in enumerate(["en", "de", None, "en"] * 5)]
    docs = spark.createDataFrame([*texts, (90, "en", None), (91, "en", "")], "doc_id long, lang string, text string")
    packed = language_model.trusted_texts(docs, docs.select("doc_id"))
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for order in (language_model.ORDER, language_model.DEPTH):
        plain, opened = (sorted(map(tuple, language_model.shard_counts(x, order, 1).select("shard", "lang", "n", "counts").collect())) for x in (docs, packed))
        assert plain == opened and plain


def test_answers_keep_every_bit(spark):
    """Answers are whole counts, so a surprise is off by rounding alone."""
    texts = [("en", "abracadabra banana bandana and a cabana band"), ("en", "a bad cad had a banana 12 times"), ("de", "das band der bananen und das bad der anden")]
    tables = language_model.fit(spark.createDataFrame(texts, "lang string, text string"), language_model.DEPTH)
    models = {x: Long([t for lang, t in texts if x in (lang, None)]) for x in ("en", "de", None)}
    asked = [(1, "en", "a banana band"), (2, "de", "das bad der bananen"), (3, "fr", "a bad band and das bad")]
    for r in language_model.surprises(spark.createDataFrame(asked, "doc_id long, lang string, text string"), tables).collect():
        _, lang, text = asked[r["doc_id"] - 1]
        assert math.isclose(r["surprise"], models[lang if lang in models else None].mean(text), rel_tol=2e-14)


def test_answers_are_small(spark):
    """Requests and answers of a block take under five bytes for each n-gram."""
    rows = spark.read.parquet(f"{oracle.DATA}/sf0.01/documents.parquet").where("lang = 'en'").orderBy("doc_id").select("text").limit(400).collect()
    texts = [r["text"] for r in rows]
    held = language_model.summed([(u, g, np.bincount(codes)) for codes, u, g, _ in [language_model.told_apart(texts[:200], language_model.DEPTH)]])
    found = language_model.levels(held, language_model.DEPTH)
    _, u, g, _ = language_model.told_apart(texts, language_model.DEPTH, each=False)
    at = np.lexsort(turned(u, g)[::-1])
    told = next(language_model.answers_to([(u[at], g[at])], found, language_model.contexts(found)))
    assert len(u) > 50_000 and len(pack_grams(u[at], g[at])) + len(told) < 5 * len(u)


@pytest.mark.parametrize("order", [3, 4, 5, 6])
def test_n_grams_are_told_apart(order):
    """As plain n-grams, with few and with very many different characters, and where there are none."""
    rnd = random.Random(1)
    wide = ["".join(chr(rnd.choice([rnd.randint(0x4E00, 0x9FFF), rnd.randint(32, 120), 0x1F600])) for _ in range(3000)) for _ in range(2)]
    for texts in ([], [""], ["a", "  ", "", "abc  12\t9"], ["ab cd ef" * 50, "ab"], wide):
        clean = ["".join("0" if c.isascii() and c.isdigit() else min(c, "￿") for c in " ".join(t.split())) for t in texts]
        plain = [("\x02" * (order - 1) + t)[k : k + order] for t in clean for k in range(len(t))]
        codes, u, g, offsets = language_model.told_apart(texts, order)
        grams = ["".join(chr((x >> 16 * k) & 0xFFFF) for x, many in ((int(a), order - 3), (int(b), 3)) for k in range(many)[::-1]) for a, b in zip(u, g)]
        assert [grams[k] for k in codes] == plain and len(set(grams)) == len(grams) and np.diff(offsets).tolist() == [len(t) for t in clean]
        none, only_u, only_g, _ = language_model.told_apart(texts, order, each=False)
        assert none is None and (only_u == u).all() and (only_g == g).all()


def test_few_texts_of_a_block_are_open_at_once():
    parts = [pack_rows(pa.table({"text": [f"{k} " * 5000]})) for k in range(8)]
    opened = list(language_model.unpacked(pa.chunked_array([pa.array(parts, pa.binary())]), 20_000))
    assert len(opened) == 4 and [r[:1] for t in opened for r in t.column("text").to_pylist()] == list("01234567")
