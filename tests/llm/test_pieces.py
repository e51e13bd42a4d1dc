"""SentencePiece by agenda against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from trainscore.llm import piece_bpe
from trainscore.llm.queries import PIECE_BPE, QUERIES

from .conftest import odd_texts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.Model(PIECE_BPE)


def digests(library, texts):
    out = []
    for i, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), True))
    return sorted(out, key=repr)


def test_ids_and_texts_equal_the_library(odd, empty, library):
    rows = piece_bpe.coded(odd, PIECE_BPE, check=True)
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == digests(library, odd_texts())
    assert piece_bpe.coded(empty, PIECE_BPE).count() == 0
    assert {r.agrees for r in piece_bpe.coded(odd, PIECE_BPE).collect()} == {None}


def test_agenda_on_random_texts(library, model):
    rng = random.Random(3)
    letters = "abcé ñ'ßÄ0１Ⅷ٣́̈　日Σσ👍<|>theandionre _-\n\t\r▁ {};()\x00"
    texts = ["", " ", "  ", "\n", " a", "a ", "<s>", "</s><unk>", "<0x41>", "▁", "▁▁a", "a▁ b", "\r\n{\r", "x" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(1500)]
    texts += ["".join(rng.choice("abct") for _ in range(n)) for n in (1, 2, 63, 64, 65, 66, 2000)]
    coder = piece_bpe.PieceEncoder(model)
    for text, ids in zip(texts, coder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert model.decode(ids) == library.decode(ids.tolist()), text


def test_sliced_batches_and_a_cleared_table(library, model, monkeypatch):
    monkeypatch.setattr(piece_bpe.PieceEncoder, "LETTERS", 10)
    coder = piece_bpe.PieceEncoder(model)
    texts = pa.array(["none of it", "one two three", "", "four five", "one six"]).slice(1)
    for text, ids in zip(texts.to_pylist(), coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice(model.bytes[128:].tolist()) if rng.random() < 0.6 else rng.choice([0, 1, 2, rng.randrange(3, 32000)]) for _ in range(rng.randint(0, 10))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_equal_scores_go_left_first_both_ways(model):
    """One stretch side by side, one with the heap: the same merges."""
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("aeinorst ") for _ in range(rng.randint(2, 60))).replace(" ", "")
        flat, counts = model.merged_many([text])
        points = np.array([model.number[c] for c in text], np.int32)
        assert flat.tolist() == model.merged_long(points).tolist() and counts[0] == len(flat)


def test_ids_come_back_as_text(odd):
    ids = piece_bpe.encode_column(odd.filter("doc_id = 12"), PIECE_BPE, "doc_id")
    assert piece_bpe.decode_column(ids, PIECE_BPE, "doc_id").first()["text"] == dict(odd_texts())[12]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "plain.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))  # a trainer of model type 1
    with pytest.raises(ValueError, match="merge-type"):
        piece_bpe.Model(str(path))


def test_the_query_covers_all_documents(spark, sf_dir, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_sentencepiece"](spark, sf_dir).collect()), key=repr) == digests(library, texts)
