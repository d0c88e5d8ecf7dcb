"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, read as words of the perfect binary Golay code
[23, 12, 7]. Each word has one nearest codeword (at most 3 bits away) and, where that is exactly 3 bits away, five
more at 4 bits. If two words differ in at most one bit, the nearest codeword of either is among the codewords within
4 bits of the other. Three errors over three segments leave (pigeonhole) either one segment equal and another with at
most one error, or one error in each, so two fingerprints within 3 bits share at least one of these keys:

* one segment as it is (21 or 22 bits) with the codeword index (12 bits) of another: six ordered pairs;
* the three codeword indices together (36 bits).

One side of the join takes the nearest codeword, the other all within 4 bits (about five), so a fingerprint has about
70 keys of 33 to 36 bits in all. A near pair meets whichever of the two stands on which side, so the join keeps the
meetings in one order, and verifies them on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_batches, per_text, without, written

#: The generator polynomial of the code, its word length and its check bits.
GENERATOR, LENGTH, CHECKS = 0xAE3, 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = [(i, j) for i in range(3) for j in range(3) if i != j]
MAX_BITS = 3
SEED = 42
#: Keys with more meetings than the square of this go the linear way of `_through_middles`.
BUCKET_LIMIT = 512
_CHUNK = 50_000


def remixed(hashes: np.ndarray, round_: int) -> np.ndarray:
    """Independent hashes for a further fingerprint of the same shingles; round 0 keeps them."""
    if not round_:
        return hashes
    mixed = hashes ^ np.uint64(round_ * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def bit_counts(text: str, size: int, rounds: int = 1) -> tuple[np.ndarray, int]:
    """How many of the shingles' hashes have each bit, lowest first, a row per round; and the number of shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((rounds, 64), np.int64), 0
    size = min(size, len(words))
    counts, total = np.zeros((rounds, 64), np.int64), len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    for first in range(0, total, _CHUNK):
        part = words[first : min(first + _CHUNK, total) + size - 1]
        joined = b" ".join(part)
        ends = [e + i for i, e in enumerate(accumulate(map(len, part)))]
        starts = [0, *(e + 1 for e in ends)]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)
        for round_ in range(rounds):
            bits = np.unpackbits(remixed(hashes, round_).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[round_] += bits.sum(axis=0, dtype=np.int64)
    return counts, total


def fingerprint(text: str | None, size: int = 3, rounds: int = 1) -> list[int]:
    """SimHashes as signed 64-bit numbers, one per round; 0 without words."""
    counts, total = bit_counts(text or "", size, rounds)
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, rounds: int = 1) -> DataFrame:
    """(id, fp, fp1, ...): one row per document with a fingerprint per round; null and empty texts have 0."""

    def make() -> Callable[[list], list[pa.Array]]:
        return lambda texts: [pa.array(column, pa.int64()) for column in zip(*(fingerprint(t, shingle_words, rounds) for t in texts))]

    return per_text(docs, [id_col], ", ".join(["fp bigint", *(f"fp{n} bigint" for n in range(1, rounds))]), make, text_col)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; equal for words that differ by a codeword."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = rest ^ (((rest >> bit) & 1) * (GENERATOR << (bit - CHECKS)))
    return rest


def error_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the one error of at most 3 bits, and the five errors of 4 bits (-1 where there are none)."""
    leaders, fours = np.zeros(1 << CHECKS, np.int64), np.full((1 << CHECKS, 5), -1, np.int64)
    for weight in range(4):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        leaders[syndrome(errors)] = errors
    errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), 4)], np.int64)
    at = syndrome(errors)
    order = np.argsort(at, kind="stable")
    fours[at[order].reshape(-1, 5)[:, 0]] = errors[order].reshape(-1, 5)
    return leaders, fours


def codewords(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices of the codewords within 4 bits, the nearest first; -1 fills the rows that have only that one."""
    leaders, fours = tables
    at = syndrome(words)
    further = np.where(fours[at] < 0, -1, (words[:, None] ^ fours[at]) >> CHECKS)
    return np.concatenate([((words ^ leaders[at]) >> CHECKS)[:, None], further], axis=1)


def keys_of(fps: np.ndarray, probe: bool, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) of one side of the join, each key once per fingerprint."""
    unsigned = fps.view(np.uint64)
    segments = [((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [codewords(s, tables) for s in segments]
    kept, rows = [], []

    def add(keys: np.ndarray, valid: np.ndarray) -> None:
        at, _ = np.nonzero(valid)
        kept.append(keys[valid])
        rows.append(at)

    for tag, (exact, fuzzy) in enumerate(PAIRS):
        codes = near[fuzzy] if probe else near[fuzzy][:, :1]
        add((tag << 40) | (segments[exact][:, None] << 12) | codes, codes >= 0)
    if probe:
        codes, rest = near[0], (near[1][:, 0] << 12) | near[2][:, 0]
        add((len(PAIRS) << 40) | (codes << 24) | rest[:, None], codes >= 0)
    else:
        second, third = near[1][:, :, None], near[2][:, None, :]
        keys = (len(PAIRS) << 40) | (near[0][:, :1, None] << 24) | (second << 12) | third
        add(keys.reshape(len(fps), -1), ((second >= 0) & (third >= 0)).reshape(len(fps), -1))
    return np.concatenate(kept), np.concatenate(rows)


def _keyed(fps: DataFrame, probe: bool, column: str) -> DataFrame:
    """(key, column). A join of these needs a hint: Spark sizes them like fps, of which they hold dozens of times the rows."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        tables = error_tables()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(0).to_numpy()
            keys, rows = keys_of(values, probe, tables)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], names=["key", column])

        return run

    return in_batches(fps, f"key bigint, {column} bigint", make)


def _through_middles(members: DataFrame, max_bits: int) -> DataFrame:
    """Links that join all members within max_bits, without comparing members pairwise.

    Two values at most 3 bits apart have a middle at most 1 bit from one and 2 bits from the other. All members
    within 1 bit of a middle, and all within 2, are linked to its smallest member within 1: each of these links is
    at most 3 bits long, and any pair within 3 bits is joined through them. 65 and 2,081 rows per member.
    """
    flips = np.array([0, *(1 << b for b in range(64)), *((1 << a) | (1 << b) for a, b in combinations(range(64), 2))], np.uint64)

    def around(count: int, column: str) -> DataFrame:
        def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                values = batch.column(0).to_numpy().view(np.uint64)
                middles = (values[:, None] ^ flips[None, :count]).reshape(-1).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(middles), pa.array(np.repeat(values, count).view(np.int64))], names=["z", column])

            return run

        return in_batches(members, f"z bigint, {column} bigint", make)

    reach = {0: (1, 1), 1: (1, 65), 2: (65, 65), 3: (65, 2081)}[max_bits]
    centres = around(reach[0], "b").groupBy("z").agg(F.min("b").alias("b"))
    return around(reach[1], "a").join(centres.hint("merge"), "z").filter("a <> b").select("a", "b")


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): pairs of the distinct values in column fp that join all values at most max_bits (0 to 3) apart.

    Buckets in which more than bucket_limit squared pairs would meet are not compared pairwise: their members are
    linked by `_through_middles`, which joins the same values at a cost that is linear in the members.
    """
    probe, nearest = _keyed(fps, True, "a"), _keyed(fps, False, "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    sizes = probe.select("key", F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(nearest.select("key", F.lit(0).alias("x"), F.lit(1).alias("y")))
    sizes = sizes.groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    crowded = written(sizes.filter(F.col("x") * F.col("y") > bucket_limit * bucket_limit).select("key"), "crowded")
    if crowded.isEmpty():
        return probe.join(nearest.hint("merge"), (probe["key"] == nearest["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    members = probe.join(crowded, "key", "left_semi").select(F.col("a").alias("fp")).unionAll(nearest.join(crowded, "key", "left_semi").select(F.col("b").alias("fp")))
    probe, nearest = probe.join(crowded, "key", "left_anti"), nearest.join(crowded, "key", "left_anti")
    plain = probe.join(nearest.hint("merge"), (probe["key"] == nearest["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    return plain.unionAll(_through_middles(members.distinct(), max_bits))


def _further_links(prints: DataFrame, column: str, max_bits: int, bucket_limit: int) -> DataFrame:
    """(a, b): links of one more round, told by the fingerprints of the first (each value by its smallest)."""
    pairs = written(prints.select("fp", F.col(column).alias("value")).distinct(), "round")
    firsts = written(pairs.groupBy("value").agg(F.min("fp").alias("first")), "round-firsts")
    equal = pairs.join(firsts, "value").filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = links(firsts.select(F.col("value").alias("fp")), max_bits, bucket_limit)
    for side in ("a", "b"):
        near = near.join(firsts.select(F.col("value").alias(side), F.col("first").alias(f"{side}_first")), side)
    return written(equal.unionAll(near.select("a_first", "b_first")), "round-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT, rounds: int = 1) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable through fingerprints at most max_bits apart.

    With several rounds each document has as many independent fingerprints, and documents are linked where any of
    them is near: a pair of similar texts gets as many chances. fp is the first round's.

    Equal fingerprints are one node, so copies cost a grouped minimum. Null and empty texts have fingerprint 0 and are
    linked like any other. Rows with a null id get their group's smallest id and never name a group (null if a group
    has no id). Repeated rows stay. An empty table gives no rows. Extra columns aren't read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle_words, rounds), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    edges = links(classes.select("fp"), max_bits, bucket_limit)
    for n in range(1, rounds):
        edges = edges.unionAll(_further_links(prints, f"fp{n}", max_bits, bucket_limit))
    joined = components(edges, "simhash").withColumnRenamed("node", "fp")
    # Only groups of several fingerprints need their smallest id; any other fingerprint is its own group.
    grouped = classes.join(joined, "fp")
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.select("fp", "component").join(least, "component").select("fp", "component_id")
    alone = classes.join(joined, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    return prints.select(id_col, "fp").join(written(named.unionAll(alone), "named"), "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """docs without those whose near-duplicate group has a smaller id.

    Of rows that share the kept id one stays, whichever text is smallest. Documents with a null id are no copies of
    anything that can be named, so they stay.
    """
    groups = near_duplicates(docs, id_col, **options)
    return without(docs, groups.filter(F.col(id_col) != F.col("component_id")), id_col)
