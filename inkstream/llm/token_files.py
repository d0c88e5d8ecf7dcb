"""Token ids in fixed-width bit-packed blocks.

Each id takes the least number of bits that holds the vocabulary. A file of the data set holds rows of blocks: whole
documents in ascending id order, until a block has BLOCK_IDS ids. A row carries the documents' ids, their offsets in
the block, the width and the packed bits, so a reader finds a document from the row's id range and unpacks it with
numpy alone. The rows are kept in Parquet: any store that Spark writes holds it, half-written attempts of lost
executors never show, and the id ranges are skipped by their statistics.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered

#: A block ends with the document that brings it to this many ids.
BLOCK_IDS = 1 << 16
#: Distinct words that a worker remembers, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: A blank with something else than white space behind it begins a new pre-token in byte-level BPE.
_CUT = re.compile(r" (?=\S)")
#: Latin letters (each a Unicode letter), and the byte-level BPE pre-tokens of texts that hold only these, digits,
#: ASCII punctuation, blanks and line ends.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCTUATION = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[ \n0-9{_LATIN}{_PUNCTUATION}]*")
_PRETOKENS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LATIN}]+| ?[0-9]+| ?[{_PUNCTUATION}]+|\s+(?!\S)|\s+")


def width_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids at `width` bits each, lowest bit first."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """ids first to first + count of a packed block; only the bytes that hold them are touched."""
    if width == 16:
        return np.frombuffer(payload, "<u2", count, first * 2).astype("<u4")
    low, high = first * width // 8, -(-(first + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    bits = bits[first * width - low * 8 :][: count * width].reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, int]:
    """The character that byte-level BPE writes for each byte: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + n for n, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as the tokenizer gives them, each distinct piece of text encoded once.

    Byte-level BPE cuts a text into pre-tokens and encodes each by itself. Texts of Latin letters, digits and ASCII
    punctuation are cut just so here, and their pre-tokens go to the library's model; where every blank stands before
    something else, whole words are remembered, and all words of a text that are not go to the library in one call: a
    token that begins with a blank begins a word. Any other text is cut at blanks before something that isn't
    white space, where a pre-token always begins. Texts with a special token's string go whole to the library, as do
    all texts where the tokenizer is of another kind.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        # Tasks use the cores; the library's own threads would only stand in their way.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        cutter = rules["pre_tokenizer"] or {}
        self.by_chunk = rules["normalizer"] is None and cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter["use_regex"]
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.letters = byte_letters()
        self.chunks = Remembered(self.whole, CACHE_ENTRIES // 4, CACHE_CHARS)
        self.pretokens = Remembered(self.pretoken, CACHE_ENTRIES // 4, CACHE_CHARS)
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        blank = chr(self.letters[0x20])
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(blank)]] = True

    def whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pretoken(self, text: str) -> bytes:
        written = text.encode().decode("latin-1").translate(self.letters)
        return _little([t.id for t in self.tokenizer.model.tokenize(written)])

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, _PRETOKENS.findall(text)))

    def new_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain texts, each behind a blank."""
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, "<u4")
        cuts = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
        if len(cuts) != len(words) + 1:
            return [self.plain(" " + word) for word in words]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def of_words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        if None in found:
            missing = {w for w, ids in zip(words, found) if ids is None}
            got = {w: ids for w in missing if (ids := self.older_words.get(w)) is not None}
            if unknown := [w for w in missing if w not in got]:
                got.update(zip(unknown, self.new_words(unknown), strict=True))
            found = [got[w] if ids is None else ids for w, ids in zip(words, found)]
            for w, ids in got.items():
                if len(w) <= CACHE_CHARS:
                    if len(self.words) >= CACHE_ENTRIES // 2:
                        self.words, self.older_words = {}, self.words
                    self.words[w] = ids
        return found

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_chunk or any(s in text for s in self.special):
            return self.whole(text)
        if _PLAIN.fullmatch(text):
            if "  " in text or " \n" in text or text[-1] == " ":
                return self.plain(text)
            head, *rest = text.split(" ")
            return self.plain(head) + b"".join(self.of_words(rest))
        head, *rest = _CUT.split(text)
        return b"".join(map(self.chunks.__getitem__, [head, *(" " + c for c in rest)]))


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append end_id to each document and write the blocks in ascending id order.

    One range shuffle of the documents puts them in order; each part is encoded and packed where it is. Null ids come
    first; documents with the same id are ordered by text; a null or empty text is its end_id alone. An empty table
    gives a data set without rows. parts: number of files, the session's shuffle partitions by default.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange(parts, F.col("id"), F.xxhash64("text")).sortWithinPartitions(F.col("id"), F.xxhash64("text"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        width, end = width_for(max(encode.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        ids: list = []
        packed: list[bytes] = []
        offsets, block, done = [0], 0, 0
        kind = None

        def closed() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(packed), "<u4"), width)
            known = [i for i in ids if i is not None]
            columns = [[part], [block], [done], [len(ids)], [offsets[-1]], [width], [known[0] if known else None], [known[-1] if known else None], [ids], [offsets], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), kind, kind, pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed.append(encode(text.as_py()) + end)
                ids.append(id_)
                offsets.append(offsets[-1] + len(packed[-1]) // 4)
                if offsets[-1] >= block_ids:
                    yield closed()
                    done, block = done + offsets[-1], block + 1
                    ids, packed, offsets = [], [], [0]
        if ids:
            yield closed()

    names = ["part", "block", "start", "n_docs", "n_ids", "width", "first_id", "last_id", "ids", "offsets", "bits"]
    schema = f"part int, block int, start bigint, n_docs bigint, n_ids bigint, width int, first_id {id_type}, last_id {id_type}, ids array<{id_type}>, offsets array<bigint>, bits binary"
    ordered.mapInArrow(run, schema).write.parquet(path)


def _unpacked(blocks: DataFrame, id_type: str, wanted: Callable[[object], bool], schema: str, digest: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    """A row for each wanted document of blocks (base, ids, offsets, width, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, ids, offsets, width, bits in zip(*(c for c in batch.columns)):
                width, payload, ends, at = width.as_py(), bits.as_py(), offsets.as_py(), base.as_py()
                picked = [k for k, id_ in enumerate(ids.as_py()) if wanted(id_)]
                columns = [
                    pa.array([ids[k].as_py() for k in picked], batch.schema.field("ids").type.value_type),
                    pa.array([at + ends[k] for k in picked], pa.int64()),
                    pa.array([ends[k + 1] - ends[k] for k in picked], pa.int64()),
                    pa.array([digest(unpack(payload, width, ends[k], ends[k + 1] - ends[k])) for k in picked], kind),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "value"])

    return blocks.select("base", "ids", "offsets", "width", "bits").mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, value {schema}")


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The blocks with `base`, the number of ids in all files before them: a running sum of one row per file."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # One row per file of the data set, whose number is the writer's setting.
    return blocks.join(F.broadcast(before), "part").withColumn("base", F.col("before") + F.col("start")), blocks.schema["first_id"].dataType.simpleString()


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, unpacked from the files."""
    blocks, id_type = _placed(spark, path)
    rows = _unpacked(blocks, id_type, lambda _: True, "bigint", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())
    return rows.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("value").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, wanted: list, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of the wanted documents: random access by the blocks' id ranges."""
    blocks, id_type = _placed(spark, path)
    found: Column = F.lit(False)
    for id_ in wanted:
        found = found | ((F.col("first_id") <= id_) & (F.col("last_id") >= id_))
    keys = frozenset(wanted)
    rows = _unpacked(blocks.filter(found), id_type, lambda id_: id_ in keys, "array<bigint>", lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()))
    return rows.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("value").alias("ids"))
