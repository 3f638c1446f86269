"""Merge-type encoding and decoding against the library."""

import hashlib
import random
import time

import oracle
import public_tokenizers
import pytest
import sentencepiece

from skywharf.llm import catalog, piece_codec

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
ALPHABET = [*"abcdefgh ABC  \n\t▁.,漢字🙂é\x00́<>0x12\x85 　", "the", "  ", "    ", "<0x41>", "<s>", "</s>", "<unk>", " ⁇ ", "�", "\r\n", "ing"]


@pytest.fixture(scope="module")
def both():
    return piece_codec.Vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_ids_and_texts_are_those_of_the_library(both):
    own, library = both
    rnd = random.Random(0)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", " ", "▁", "\n"]
    ids = own.encode(texts)
    assert ids == library.encode(texts)
    assert [own.decode(x) for x in ids] == library.decode(ids)


def test_any_ids_decode_as_in_the_library(both):
    """Control and unknown ids, broken bytes, spaces in front."""
    own, library = both
    rnd = random.Random(1)
    some = [lambda: rnd.randrange(32_000), lambda: rnd.randrange(3, 259), lambda: rnd.randrange(3), lambda: 259, lambda: 3 + rnd.choice(b"\xe6\xbc\xa2\xf0\x9f\xc3\xa9\xed\xa0\x80")]
    for _ in range(3000):
        ids = [rnd.choice(some)() for _ in range(rnd.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_merges_follow_scores_and_then_places(both):
    own, library = both
    for part in ("aaaaaaa", "abababab", "▁▁▁▁▁▁▁a", "ththethe"):
        assert [own.ids[s] for s in own.merged(part) if s in own.ids] == [i for i in (own.ids_of_part(part))]
    assert own.encode(["aaaaaaa"]) == library.encode(["aaaaaaa"])


def test_parts_in_arrays_equal_parts_in_a_heap(both):
    own, _ = both
    rnd = random.Random(4)
    whole = "".join(rnd.choice(["the", "ing", "a", "aa", "▁", "▁▁", "tion", ".", "é", "漢", "qx", "0"]) for _ in range(4000))
    parts = sorted({part for part in own.cut([whole])[1] if 1 < len(part) <= 64})
    assert len(parts) > 200 and own.ids_of_parts(parts) == [own.ids_of_part(part) for part in parts] and own.ids_of_parts([]) == []


def test_long_parts_stay_near_linear(both):
    own, library = both
    started = time.time()
    text = "a" * 200_000 + " " + "ab" * 50_000
    assert own.encode([text]) == library.encode([text]) and time.time() - started < 60


def test_kept_parts_may_overflow(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(piece_codec, "KEPT_PARTS", 3)
    texts = ["some words of a text that come again", "words of a text"]
    assert own.encode(texts, {}) == library.encode(texts)


def test_query_on_given_documents(spark):
    folder = f"{oracle.DATA}/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalog.QUERIES["op11_piece_codec"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r["agrees"]


def test_real_outputs_round_trip(spark):
    docs = spark.createDataFrame([(1, "a  text\nof words 漢🙂"), (1, "a  text\nof words 漢🙂"), (None, None), (3, "")], "doc_id long, text string")
    rows = piece_codec.encode(docs.repartition(2), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"]) > 0, r["agrees"]) for r in rows) == [
        (0, "", False, True), (1, "a  text\nof words 漢🙂", True, True), (1, "a  text\nof words 漢🙂", True, True), (3, "", False, True)]
    assert {r["agrees"] for r in piece_codec.encode(docs, MODEL, check=False).collect()} == {None}


def test_other_kinds_of_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    proto.normalizer_spec.add_dummy_prefix = False
    with pytest.raises(ValueError):
        piece_codec.Vocabulary(proto.SerializeToString())
    proto.normalizer_spec.add_dummy_prefix = True
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        piece_codec.Vocabulary(proto.SerializeToString())
