"""Texts without blanks count as a whole in the quality score."""

import numpy as np

from inkstream.llm import quality_knn


def dense(text):
    _, dims, weights = quality_knn.sparse_vectors([text])
    out = np.zeros(quality_knn.WORD_DIMS + quality_knn.SHAPE_DIMS)
    out[dims] = weights
    return out


def test_what_follows_the_first_characters_of_a_token_counts():
    start = "漢字" * 40
    plain, marked = dense(start + "漢字" * 200), dense(start + "A1#b$" * 80)
    shapes = slice(quality_knn.WORD_DIMS, None)
    assert not np.array_equal(plain[shapes], marked[shapes])
    assert (dense(start + "A1#b$" * 80)[shapes] > 0).sum() > 2


def test_pieces_are_the_whole_token():
    text = "ab " + "x1" * 100 + " \n" + "y" * 64 + " z" * 3
    tokens = quality_knn.tokens_of(text)
    assert "".join(tokens) == "".join(text.split()) and max(map(len, tokens)) == quality_knn.PIECE_CHARS
    assert quality_knn.tokens_of(None) == [] and quality_knn.tokens_of("a bc") == ["a", "bc"]
