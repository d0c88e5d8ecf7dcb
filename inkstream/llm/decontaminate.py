"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as words (letters and digits, without case). Running Karp-Rabin hashes of
SEED_WORDS words find where a document shares a seed with an item; seeds on one diagonal join to matches. For each
pair of a document and an item the longest match is marked again and again, never overlapping an earlier one, until
no unmarked match of a seed's length is left. The share of the item's words that is marked tells a leak, in whatever
order its passages stand in the document.

The benchmark is read in blocks of bounded size, each sent to every task; every document meets every block.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, blocks_for, in_batches, without

#: Words of a seed, and the share of an item's words that tells a leak.
SEED_WORDS, LEAST_COVERAGE = 5, 0.5
#: Bytes of benchmark text in a block, on average; blocks are cut by a hash of the item.
BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORDS = re.compile(r"[^\W_]+")


def words_of(token: str) -> list[str]:
    return _WORDS.findall(token.lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `length` ids, modulo 2^64."""
    hashes = np.zeros(len(ids) - length + 1, np.uint64)
    for at in range(length):
        hashes = hashes * _BASE + ids[at : at + len(hashes)].astype(np.uint64) + np.uint64(1)
    return hashes


def matches(seeds: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, document position, item position) from all seeds (document, item) of `length` words."""
    diagonals = defaultdict(list)
    for in_doc, in_item in seeds:
        diagonals[in_doc - in_item].append(in_item)
    found = []
    for diagonal, starts in diagonals.items():
        starts.sort()
        first = last = starts[0]
        for at in [*starts[1:], None]:
            if at is not None and at <= last + 1:
                last = at
                continue
            found.append((last - first + length, first + diagonal, first))
            first = last = at
    return found


def tile(found: list[tuple[int, int, int]], least: int, item_length: int) -> int:
    """Words of the item that greedy tiling marks: the longest match first, ties by position in the item, then document."""
    heap = [(-length, in_item, in_doc) for length, in_doc, in_item in found]
    heapq.heapify(heap)
    item_marked, doc_marked = np.zeros(item_length, bool), set()
    while heap:
        length, in_item, in_doc = heapq.heappop(heap)
        length = -length
        free = [not item_marked[in_item + k] and in_doc + k not in doc_marked for k in range(length)]
        if all(free):
            item_marked[in_item : in_item + length] = True
            doc_marked.update(range(in_doc, in_doc + length))
            continue
        # What earlier tiles leave of the match competes again.
        first = None
        for k, is_free in enumerate([*free, False]):
            if is_free and first is None:
                first = k
            elif not is_free and first is not None:
                if k - first >= least:
                    heapq.heappush(heap, (first - k, in_item + first, in_doc + first))
                first = None
    return int(item_marked.sum())


class Benchmark:
    """Items as word ids, with their seeds by hash."""

    def __init__(self, items: list[tuple[object, str | None]], seed_words: int = SEED_WORDS) -> None:
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                self.items.append((item_id, np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)))
        # Items shorter than a seed are sought whole.
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, (_, ids) in enumerate(self.items):
            length = min(seed_words, len(ids))
            by_hash = self.seeds.setdefault(length, {})
            for at, value in enumerate(rolling(ids, length).tolist()):
                by_hash.setdefault(value, []).append((number, at))
        self.hashes = {length: np.sort(np.fromiter(by_hash, np.uint64, len(by_hash))) for length, by_hash in self.seeds.items()}
        self.known = Remembered(self._ids, 500_000, 64)

    def _ids(self, token: str) -> tuple[int, ...]:
        return tuple(self.numbers.get(w, -1) for w in words_of(token))

    def ids_of(self, text: str) -> np.ndarray:
        ids: list[int] = []
        for found in map(self.known.__getitem__, text.split()):
            ids += found
        return np.array(ids, np.int64)

    def covered(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item, marked words, words of the item) for every item that shares a seed with the text."""
        ids = self.ids_of(text or "")
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            unknown = np.cumsum(np.concatenate([[0], ids < 0]))
            whole = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(whole):
                continue
            values = rolling(ids, length)[whole]
            at = np.searchsorted(hashes, values)
            hit = hashes[np.minimum(at, len(hashes) - 1)] == values
            for in_doc, value in zip(whole[hit].tolist(), values[hit].tolist()):
                for number, in_item in self.seeds[length][value]:
                    if np.array_equal(self.items[number][1][in_item : in_item + length], ids[in_doc : in_doc + length]):
                        by_item[number].append((in_doc, in_item))
        found = []
        for number, seeds in sorted(by_item.items()):
            item_id, words = self.items[number]
            least = min(SEED_WORDS, len(words))
            found.append((item_id, tile(matches(seeds, min(least, len(words))), least, len(words)), len(words)))
        return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_coverage: float = LEAST_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, matched_words, item_words, coverage): every pair whose coverage is at least least_coverage.

    Null and empty texts and items without words match nothing. Repeated rows of either side give repeated pairs; null
    ids stay. An empty table on either side gives no rows. Extra columns aren't read. The longest runs are marked
    first, so reordered passages count, and a passage that stands twice in the document counts once.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, matched_words bigint, item_words bigint"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = blocks_for(total, block_bytes)
    item_kind = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        # A block holds about block_bytes of text, whatever the size of the benchmark.
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("item", "text").collect()])

        def make(shared: object = shared) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            known = Benchmark(shared.value)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = [(at, *hit) for at, text in enumerate(batch.column(1)) for hit in known.covered(text.as_py()) if hit[1] >= least_coverage * hit[2]]
                columns = list(zip(*rows)) or [(), (), (), ()]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_kind), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=[id_col, item_col, "matched_words", "item_words"])

            return run

        pairs = in_batches(docs.select(id_col, text_col), schema, make)
        found = pairs if found is None else found.unionAll(pairs)
    return found.withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """docs without those that leak a benchmark item, by the rules of `leaks`; null ids are matched as one id.

    Where less than SEED_WORDS words are marked nothing is dropped: a short item stands in many clean texts.
    """
    return without(docs, leaks(docs, benchmark, id_col, **options).filter(F.col("matched_words") >= SEED_WORDS), id_col)
