"""Token counts equal those of the library, whole and in chunks."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assay.llm.tokens import Counter, token_counts
from tests.llm.frames import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "1", "23", "!", "<|endoftext|>", "<|endof", "日本", "😀",
          "x" * 30, "the ", " word", "word.", ",", "　", " "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk, overlap", [(60, 8), (200, 64), (1 << 16, 1 << 10)])
def test_counts_equal_the_library(library, chunk, overlap):
    draw, counter = random.Random(chunk), Counter(PATH, chunk=chunk, overlap=overlap, margin=16)
    for _ in range(400):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 150)))
        assert counter.count([text]) == [library(text)], text
        assert counter.count_short([text]) == [library(text)], text


def test_overlaps_widen_over_a_word_longer_than_a_chunk(library):
    counter = Counter(PATH, chunk=100, overlap=10)
    for text in ("z" * 5000, "a " + "z" * 700 + " b " + "!" * 900, "<|endoftext|>" * 60, " " * 1000):
        assert counter.count([text]) == [library(text)]


def test_odd_rows(spark, library):
    got = token_counts(documents(spark, ODD), PATH, chunk=5000, overlap=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((i, len((t or "").encode()), library(t or ""), library(t or "") > 512) for i, t, *_ in ODD), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert token_counts(documents(spark, []), PATH).count() == 0
