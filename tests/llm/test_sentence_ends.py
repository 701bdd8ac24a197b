"""Sentence ends of scripts that put no blank after them."""

import random

import numpy as np
import pytest

from tallyweave.llm import splitting

BYTE = "byte_bpe_50k"


def _pieces(text, name, most=64, shared=0):
    return [(int(kind), piece) for _, _, *columns in splitting.split_texts(text, name, [("l", most, shared)]) for *_, kind, piece in zip(*columns)]


@pytest.mark.parametrize("name", [BYTE, "word_bpe_49k"])
@pytest.mark.parametrize("sentence, end", [("突变会降低结合。", "。"), ("位置は内側か？", "？"), ("他说「很好！」", "」"), ("他说“很好。”", "”")])
def test_long_text_without_blanks(name, sentence, end):
    got = _pieces([sentence * 400], name)
    assert len(got) > 10
    assert all(kind == splitting.SENTENCE and piece.endswith(end) for kind, piece in got[:-1])


@pytest.mark.parametrize("name, most, shared", [("word_bpe_49k", 480, 48), (BYTE, 256, 32)])
def test_sentences_of_many_lengths_with_overlap(name, most, shared):
    rng = random.Random(7)
    text = "".join("".join(rng.choices("突变会降低结合位置测定高度保守残基", k=rng.randrange(4, 30))) + "。" for _ in range(1500))
    got = [kind for kind, _ in _pieces([text], name, most, shared)[:-1]]
    # not all: a cut is passed over if the next piece, the overlap before it, would start inside a character
    assert len(got) > 20 and got.count(splitting.SENTENCE) > 0.85 * len(got)


def _kinds(*texts):
    """Level of the boundary after each character but the last, each character a token."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at, opens = np.arange(1, len(chars)), np.cumsum([0, *map(len, texts)])[:-1]
    return splitting.levels(chars, at, at, np.ones(len(at), bool), opens).tolist()


def test_kinds_of_marks():
    assert _kinds("a。b") == [1, 3]
    assert _kinds("a。」』b") == [1, 1, 1, 3]
    assert _kinds("a？！b") == [1, 1, 3]
    assert _kinds("a。「b") == [1, 3, 1]
    assert _kinds("a」b") == [1, 1]
    assert _kinds("3.1!b…c") == [1] * 6
    assert _kinds("a. b") == [1, 3, 2]
    assert _kinds("a。", "」b")[-1] == 1
