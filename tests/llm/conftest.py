from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

# Columns that the operators might use for themselves ride along.
CLASHING = "id long, key string, class string, n long, hash long, rank int, token string, score double, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), 1, "k", "c", 2, 3, 4, "t", 0.5, "x") for i, t in texts]


def odd_texts():
    """Nulls, empty and very long texts, repeated rows, a missing id, copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, copy = prose(60), prose(80)
    return [
        (1, None),
        (2, ""),
        (3, " \t\r\n\x0b\x0c "),
        (4, "x" * 30_000),
        (5, prose(20_000)),
        (6, copy),
        (6, copy),
        (7, copy),
        (8, copy.upper() + "  "),
        (9, long + " " + copy),
        (None, prose(50)),
        (None, None),
        (10, "1234 5678"),
        (11, "<|endoftext|>a<|startoftext|>"),
        (12, "İstanbul ΣΑΣ    naïve 中文 \U0001f44d\U0001f3fd"),
        *[(100 + i, prose(rng.randint(3, 200))) for i in range(20)],
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(odd_texts()), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
