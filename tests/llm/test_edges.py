"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skywharf.llm import chat, decontaminate, html_text, language_model, licenses, mixing, ngram_join, periodic_runs, piece_codec, quality_rules, secret_scan, shards

import corpus_pipeline

CLASH = ["row", "n", "block", "size", "token", "tokens", "place", "shard", "cell", "first", "last", "key", "words", "rank", "weight", "copies", "taken", "target", "_row", "_id",
         "row_id", "row_key", "text_key", "found_id", "kept", "surprise", "component", "item_id", "fp", "order", "range", "metric", "bucket", "places", "windows", "spans", "alone", "one", "side", "h", "g", "p"]
LONG = "alpha beta gamma delta epsilon " * 40_000 + "end"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b"),
    (3, None, "en", None), (4, "", None, "a"), (5, " \n\t ", "de", None), (6, LONG, "de", "a"), (None, "no id here at all", None, None),
    (None, None, None, None), (7, "Ünïcode 漢字 🙂 text with token = \"abcdefghijklmnop\" in it", "fr", "c"),
]
ITEMS = [(1, ROWS[0][1]), (2, "no id here"), (None, "one two three"), (3, None), (4, "")]
LABELS = [(1, 1, 0), (2, 1, 0), (6, 1, None), (7, None, 0), (None, 1, 0), (7, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("x") for c in CLASH}).withColumn("n_chars", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in CLASH if c not in ("item_id",)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in CLASH})


OPERATORS = {
    "licenses": lambda d, i, b: licenses.scan(d),
    "quality_rules": lambda d, i, b: quality_rules.judge(d),
    "secrets": lambda d, i, b: secret_scan.scan(d),
    "pages": lambda d, i, b: html_text.extract(d.withColumnsRenamed({"doc_id": "page_id", "lang": "url"}).withColumn("html", F.col("text"))),
    "join": lambda d, i, b: ngram_join.groups(d),
    "model": lambda d, i, b: language_model.judge(d, b),
    "mix": lambda d, i, b: mixing.mix(d),
    "overlaps": lambda d, i, b: decontaminate.overlaps(d, i),
    "shards": lambda d, i, b: shards.assign(d),
    "quality": lambda d, i, b: language_model.quality(d, b),
    "pieces": lambda d, i, b: piece_codec.encode(d, open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()),
    "runs": lambda d, i, b: periodic_runs.runs(d, periodic_runs.repeated_tail),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(docs, items, labels, name):
    assert len(OPERATORS[name](docs, items, labels).collect()) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, items, labels, name):
    assert OPERATORS[name](docs.limit(0), items, labels).collect() == []


def test_empty_side_tables(docs, items, labels):
    assert not any(r["contaminated"] for r in decontaminate.overlaps(docs, items.limit(0)).collect())
    assert {r["doc_id"] for r in language_model.judge(docs, labels.limit(0)).where("kept").collect()} == {1, 2, 6, 7, None}


def test_defined_values(docs, items, labels):
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.groups(docs).collect()}
    assert found[1, 10] == found[2, 10] == 1 and found[3, 0] == 3 and found[None, 1] is None and found[None, 0] is None
    assert sum(r["kept"] for r in ngram_join.groups(docs).where("doc_id = 1 OR doc_id = 2").collect()) == 1
    seen = {r["doc_id"]: (r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in decontaminate.overlaps(docs, items).where("doc_id IS NOT NULL").collect()}
    assert seen[1] == (14, [1], True) and seen[3] == (0, [], False) and seen[6] == (0, [], False)
    mixed = {r["id"]: r["size"] for r in mixing.mix(docs).select(F.col("row.doc_id").alias("id"), "size").collect() if r["id"]}
    assert mixed[3] == mixed[4] == mixed[5] == 0 and mixed[6] == 200_001
    sharded = shards.assign(docs, shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in sharded) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert {(r["size"], r["text_crc32"]) for r in sharded if r["doc_id"] in (3, 4)} == {(8, 0)}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, items, labels, tmp_path_factory, k):
    folder = str(tmp_path_factory.mktemp("stage"))
    items.write.parquet(f"{folder}/benchmark.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    kept = [i for missing, i in ids if not missing]
    expected = {
        "quality": [1, 2, 2, 6, 7], "near_copies": [1, 3, 4, 5, 6, 7], "benchmark": [3, 4, 5, 6, 7], "sharding": [1, 2, 2, 3, 4, 5, 6, 7],
    }
    if name in expected:
        assert kept == expected[name]
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_chats(spark):
    turns = spark.createDataFrame(
        [(1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "a"), (1, "chosen", 1, "assistant", None), (1, "rejected", 1, "assistant", "b"), (2, "chosen", None, None, None), (None, None, 1, "user", "x"), (3, "other", 0, "user", "x")],
        "pair_id long, side string, turn long, role string, text string",
    ).withColumns({c: F.lit(1) for c in CLASH if c != "side"})
    rows = {r["pair_id"]: r for r in chat.format_pairs(turns).collect()}
    assert set(rows) == {1, 2} and rows[1]["prompt"] == "<|im_start|>user\na<|im_end|>\n" and rows[1]["chosen"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert rows[1]["rejected"][rows[1]["rejected_mask"][0]["start"] : rows[1]["rejected_mask"][0]["end"]] == "b<|im_end|>"
    assert rows[2]["chosen"] == "<|im_start|>unknown\n<|im_end|>\n" and rows[2]["chosen_mask"] == [] and rows[2]["rejected"] == ""
    assert chat.format_pairs(turns.limit(0)).collect() == []
    conversations = turns.select(F.col("pair_id").alias("conv_id"), "turn", "role", "text", "side")
    assert chat.format_pairs(chat.contrast(conversations)).count() == 3
