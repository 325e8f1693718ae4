"""SentencePiece encoding and decoding against the library, with offsets and other character maps."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from terrachron.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "   ", "\n", "\t", "▁", "▁▁", "a", "the", "ing", "é", "é", "ﬁ", "Ａ", "中", "日本", "😀", "​", "\xa0", "<s>", "</s>"]
PARTS += ["<unk>", "<0x41>", "!", "...", "www", "abab", "aaaa", "\x00", "\x7f", "　", "ก", "\r\n", "1234", "٣", "한"]


def odd_texts(n=1500):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(0, 40))) for _ in range(n)]
    return texts + [" " * k for k in range(40)] + ["", "x" * 3000, "ab" * 400 + "中" * 900, "▁" * 200 + "é" * 100]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("most", [64, 0])
def test_ids_and_texts(library, monkeypatch, most):
    """Rounds and heap alike; all odd texts at once."""
    monkeypatch.setattr(pieces, "ROUND_CHARACTERS", most)
    encoder, texts = pieces.PieceEncoder(pieces.read_model(MODEL)), odd_texts()
    texts += [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text, (ids, _, _) in zip(texts, encoder.encode_spans(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert encoder.decode_text(ids) == library.decode(ids.tolist())


def test_any_ids_decode(library):
    encoder, draw = pieces.PieceEncoder(pieces.read_model(MODEL)), random.Random(6)
    for _ in range(5000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(300), 28705, 1, 2, 0]) for _ in range(draw.randrange(0, 12))]
        assert encoder.decode_text(np.array(ids, np.int64)) == library.decode(ids)


def byte_places(text):
    return np.cumsum([0, *[len(c.encode()) for c in text]])


def test_spans_are_those_of_the_library(library):
    encoder, texts = pieces.PieceEncoder(pieces.read_model(MODEL)), odd_texts(400)
    for text, (ids, begins, ends) in zip(texts, encoder.encode_spans(texts)):
        want = library.encode(text, out_type="offset_mapping")
        places = byte_places(text)
        assert ids[1:-1].tolist() == want["ids"]
        assert list(zip(begins[1:-1].tolist(), ends[1:-1].tolist())) == [(places[a], places[b]) for a, b in want["offsets"]]
        assert (ends - begins).sum() == len(text.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_compiled_maps(rule, squeeze, prefix):
    """Longest-prefix normalisation by the library's own compiled maps, with source offsets."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze, add_dummy_prefix=prefix)
    rules = next(v for field, v in pieces.fields(normalizer.serialized_model_proto()) if field == 3)
    size = bytes([len(rules) & 127 | 128, len(rules) >> 7 & 127 | 128, len(rules) >> 14])
    with open(MODEL, "rb") as file:  # a later field of a message replaces the earlier one
        model = file.read() + bytes([3 << 3 | 2]) + size + rules
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceEncoder(pieces.parse_model(model))
    for text in odd_texts(600):
        want, offsets = normalizer.Normalize(text, with_offsets=True)
        got, origin = encoder.normalise(text)
        assert got == want
        if got:
            assert origin[byte_places(got)].tolist() == byte_places(text)[offsets].tolist()
        ids = next(encoder.encode_spans([text]))[0].tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert encoder.decode_text(np.array(ids)) == library.decode(ids)


def test_queries_of_all_rows(spark, odd, nothing, library):
    for frame in (odd, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        rows = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        want = []
        for doc_id, text in rows:
            ids = library.encode(text, add_bos=True, add_eos=True)
            digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            want.append((doc_id, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(text.encode())))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in pieces.digests(frame, MODEL).collect())
    coded = pieces.encode(odd, MODEL)
    back = {str(r.doc_id): r.text for r in pieces.decode(coded, MODEL).collect()}
    assert back["11"] == "été 中文 \U0001f600<|endoftext|>" and back["2"] == ""
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in coded.collect())
    assert pieces.digests(nothing, MODEL).count() == 0 == pieces.encode(nothing, MODEL).count()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.parse_model(b"")
