"""Unbroken pieces of any length, in lockstep and alone, against the tiktoken library."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foliary.llm import bpe
from foliary.llm import queries as Q


@pytest.fixture(scope="module")
def coders():
    ranks = bpe.load_ranks(Q.tokenizer_file("byte_bpe_50k.tiktoken"))
    return bpe.Coder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def letters(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice(["the", "ing", "a", "qu", "Zx", "é", "ō", "tion"]) for _ in range(n))


def test_pieces_alone_and_in_lockstep(coders):
    coder, library = coders
    pieces = [letters(i, n) for i, n in enumerate([1, 2, 60, 90, 100, 130, 200, 500, 1000, 1001, 1002])] + ["a" * 300, "ab" * 400]
    for piece in pieces:
        raw = piece.encode()
        expected = library._core_bpe.encode_single_piece(raw)
        assert coder.merge_alone(raw).tolist() == expected == coder.merge([raw])[0].tolist()
    many = [letters(100 + i, 120) for i in range(40)]
    assert [x.tolist() for x in coder.encode(many + pieces)] == [library.encode_ordinary(t) for t in many + pieces]


def test_a_very_long_piece(coders):
    coder, library = coders
    piece = letters(7, 150_000)
    began = time.perf_counter()
    ids = coder.encode([piece])[0]
    assert time.perf_counter() - began < 30
    assert coder.decode(ids) == piece.encode()
    short = piece[:20_000]
    assert np.array_equal(coder.encode([short])[0], library.encode_ordinary(short))
