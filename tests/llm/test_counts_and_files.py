"""Token counts and token files against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkstream.llm import token_counts, token_files
from inkstream.llm.common import new_folder

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def strings(count, seed):
    draw = random.Random(seed)
    alphabet = [*" \n\t\ra'sé漢1.,\xa0\x85\x1c▁<|>😀́", " ", "re", "ll", "The", "<|endoftext|>", "  ", "<s>", " and", "!!"]
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(count)]


def test_counts_equal_the_library():
    model, count = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.counter_of(PIECES)
    for text in [*strings(4000, 1), "a" * 5000, " " * 300, "ab " * 500]:
        assert count(text) == len(model.encode(text)), repr(text)
    assert count(None) == count("") == 0


def test_merging_without_cuts_is_the_same():
    ranks = token_counts.sentencepiece_ranks(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in strings(500, 2):
        if text:
            assert token_counts.merged_count("▁" + text.replace(" ", "▁"), ranks) == len(model.encode(text)), repr(text)


def test_encoder_equals_the_library():
    tokenizer, encode = Tokenizer.from_file(BYTES), token_files.encoder_of(BYTES)
    for text in [*strings(4000, 3), "a" * 5000, " " * 300, "plain text, with 12 words.\nAnd don't they'll 's."]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 31, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype("<u4")
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert (token_files.unpack(packed, width, 0, 1000) == ids).all()
    assert (token_files.unpack(packed, width, 123, 321) == ids[123:444]).all()
    assert len(token_files.unpack(packed, width, 10, 0)) == 0


def expected(rows):
    tokenizer, at, found = Tokenizer.from_file(BYTES), 0, []
    for id_, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        found.append((id_, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


@pytest.mark.parametrize("block_ids", [1, 50, token_files.BLOCK_IDS])
def test_files_read_back(spark, plain, block_ids):
    rows = [(i * 7 % 101, t) for i, t in enumerate([*strings(60, 4), None, "", "word " * 300])]
    path = new_folder(spark, "test-tokens")
    token_files.write(plain(rows), path, BYTES, parts=5, block_ids=block_ids)
    got = sorted(tuple(r) for r in token_files.read_digests(spark, path).collect())
    assert got == sorted(expected(rows))
    wanted = rows[5][0]
    one = token_files.read_ids(spark, path, [wanted]).collect()
    assert [(r["start"], r["n_tokens"]) for r in one] == [x[1:3] for x in expected(rows) if x[0] == wanted]
    assert zlib.crc32(np.array(one[0]["ids"], "<u4").tobytes()) == next(x[3] for x in expected(rows) if x[0] == wanted)


def test_odd_tables(spark, odd, clashing, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (odd, clashing):
        counts = token_counts.token_counts(docs, PIECES).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted([(r[0], r[2]) for r in counts], key=key) == sorted([(i, len(model.encode(t or ""))) for i, t in rows], key=key)
        path = new_folder(spark, "test-tokens")
        token_files.write(docs, path, BYTES, parts=3)
        got = token_files.read_digests(spark, path).collect()
        # Null ids come first; their two texts may stand in either order.
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(x[2:] for x in expected(rows))
        assert [(r["doc_id"], r["start"]) for r in sorted(got, key=lambda r: r["start"])][2:] == [x[:2] for x in expected(rows)][2:]
    assert token_counts.token_counts(nothing, PIECES).collect() == []
    path = new_folder(spark, "test-tokens")
    token_files.write(nothing, path, BYTES)
    assert token_files.read_digests(spark, path).collect() == []
