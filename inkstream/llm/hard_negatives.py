"""Hard negatives by threshold joins over inverted blocks of integer vectors.

Rows are dealt into blocks by a hash of their id. A block is an inverted index: dimensions run in one order for all
vectors, by falling energy, and each chunk of them lists the rows that are indexed there. For a threshold t and an anchor
a, a row's trailing dimensions are left out as soon as their norm is below t / |a|, since what they could add stays
below t; rows are sorted by where they end, so a chunk's list is a prefix. Partial scores are accumulated chunk by chunk;
what partial score plus remaining norms leaves below the threshold is pruned, and the few pairs left are completed.

Anchors meet the blocks with a high threshold first, taken from the spread of their scores over a sample of
SAMPLE_ROWS rows. Windows that hold too few rows come again with the next lower one, until they fill or the threshold is
the window's own lower end. The sample steers the number of rounds only: results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
SCALE = 256
#: Rows of an index block and anchors of an anchor block, about; rows of the sample, about.
BLOCK_ROWS, ANCHOR_ROWS, SAMPLE_ROWS = 32_768, 512, 4_096
#: Rows that the first threshold of a window is expected to pass for each one needed, and the growth per round.
EXPECTED, GROWTH, ROUNDS = 2, 8, 6
#: Dimensions of a chunk, anchors accumulated at once, share of pairs below which pairs are completed one by one.
CHUNK, _ANCHORS_AT_ONCE, _FEW = 8, 64, 0.05
_ALL, _NONE = 1 << 62, -(1 << 62)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v): rows with an id, a label and finite components only, each component as floor(scale * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))


def _matrix(values: pa.ListArray, dims: int, order: np.ndarray) -> np.ndarray:
    """Vectors as rows, short ones padded with zeros, dimensions in the index's order."""
    ends, flat = np.asarray(values.offsets), np.asarray(values.values).astype(np.int64)
    lengths = np.diff(ends)
    made = np.zeros((len(lengths), dims), np.int64)
    at = np.arange(dims) < lengths[:, None]
    made[at] = flat[ends[0] : ends[-1]]
    return made[:, order]


def _narrow(matrix: np.ndarray) -> tuple[bytes, int]:
    """The matrix in the narrowest integers that hold it, and their bytes."""
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return matrix.astype(f"<i{width}").tobytes(), width


def inverted_blocks(rows: DataFrame, blocks: int, dims: int, order: np.ndarray) -> DataFrame:
    """(block, ids, labels, vectors, width): the rows (id, label, v) packed. Of a repeated id the smallest label, then vector stays."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids, labels = (np.asarray(table[c].combine_chunks()) for c in ("id", "label"))
        matrix = _matrix(table["v"].combine_chunks(), dims, np.arange(dims))
        if len(np.unique(ids)) < len(ids):
            sorted_ = np.lexsort((*matrix.T[::-1], labels, ids))
            first = sorted_[np.append(True, ids[sorted_][1:] != ids[sorted_][:-1])]
            ids, labels, matrix = ids[first], labels[first], matrix[first]
        packed, width = _narrow(matrix[:, order])
        return pa.table({"block": [key[0].as_py()], "ids": [ids.astype("<i8").tobytes()], "labels": [labels.astype("<i8").tobytes()], "vectors": [packed], "width": pa.array([width], pa.int32())}, schema=schema)

    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32())])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, labels binary, vectors binary, width int")


def tail_norms(matrix: np.ndarray, chunks: list[slice]) -> np.ndarray:
    """Norm of what is left from each chunk on; the last column is zero."""
    squares = np.zeros((len(matrix), len(chunks) + 1))
    for c, part in enumerate(chunks):
        squares[:, c] = (matrix[:, part].astype(np.float64) ** 2).sum(axis=1)
    return np.sqrt(squares[:, ::-1].cumsum(axis=1)[:, ::-1])


class Block:
    """One index block in memory."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, width: int) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.matrix = np.frombuffer(vectors, f"<i{width}").reshape(len(self.ids), -1)
        self.chunks = [slice(i, i + CHUNK) for i in range(0, self.matrix.shape[1], CHUNK)]
        self.tails = tail_norms(self.matrix, self.chunks)
        self.longest = self.tails[:, 0].max(initial=0)
        self.as_kind: dict[type, np.ndarray] = {}

    def of_kind(self, kind: type) -> np.ndarray:
        if kind not in self.as_kind:
            self.as_kind = {kind: self.matrix.astype(kind)}
        return self.as_kind[kind]

    def scores(self, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) with the exact scores of all allowed rows that reach the anchor's least, and maybe of others.

        allowed: boolean, anchors x rows.
        """
        a_tails = tail_norms(anchors, self.chunks)
        most = a_tails[:, 0].max(initial=0) * self.longest
        # Sums of any terms stay within the product of the norms, so floats that hold it are exact.
        kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
        a_matrix, rows = anchors.astype(kind), self.of_kind(kind)
        bound = least - (4 + 1e-9 * most)
        a_tails = a_tails * (1 + 1e-5)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(bound > 0, bound / a_tails[:, 0], -1.0).min()
        # Chunks in which a row is indexed; those before it in the order are indexed at least as far.
        last = len(self.chunks)
        indexed = np.full(len(rows), last) if reach <= 0 else (self.tails[:, :last] >= reach).sum(axis=1)
        order = np.argsort(-indexed, kind="stable")
        order = order[: np.count_nonzero(indexed)]
        indexed, rows, tails, allowed = indexed[order], rows[order], self.tails[order], allowed[:, order]
        total = np.zeros((len(anchors), len(order)), kind)

        def alive(done: np.ndarray) -> np.ndarray:
            left = a_tails[:, done] * tails[np.arange(len(done)), done]
            return allowed & (total + left >= bound[:, None])

        for c, part in enumerate(self.chunks):
            listed = int(np.searchsorted(-indexed, -c))
            if not listed:
                break
            total[:, :listed] += a_matrix[:, part] @ rows[:listed, part].T
            if c + 1 < last and (c + 1) & c == 0 and c and alive(np.minimum(indexed, c + 1)).mean() < _FEW:
                break
        done = np.minimum(indexed, c + 1) if len(self.chunks) else indexed
        pairs = alive(done)
        if pairs.mean() < _FEW if pairs.size else True:
            one, other = np.nonzero(pairs)
            score, at = total[one, other], done[other]
            for c, part in enumerate(self.chunks):
                lacks = at <= c
                score[lacks] += (a_matrix[one[lacks], part] * rows[other[lacks], part]).sum(axis=1, dtype=kind)
                keep = score + a_tails[one, np.maximum(at, c + 1)] * tails[other, np.maximum(at, c + 1)] >= bound[one]
                one, other, score, at = one[keep], other[keep], score[keep], at[keep]
            cuts = np.searchsorted(one, np.arange(len(anchors) + 1))
            for i in range(len(anchors)):
                yield i, order[other[cuts[i] : cuts[i + 1]]], score[cuts[i] : cuts[i + 1]]
        else:
            for c, part in enumerate(self.chunks):
                lacks = done <= c
                if lacks.any():
                    total[:, lacks] += a_matrix[:, part] @ rows[lacks, part].T
            for i in range(len(anchors)):
                found = np.flatnonzero(pairs[i])
                yield i, order[found], total[i, found]


def first_of(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` first: higher scores first, ties by smaller id."""
    at = np.arange(len(ids))
    if len(ids) > count:
        at = at[scores >= np.partition(scores, -count)[-count]]
    return at[np.lexsort((ids[at], -scores[at]))][:count]


def block_hits(block: Block, anchors: pa.StructArray, order: np.ndarray, count: int, same: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor id, window, ids, scores): the first `count` rows of the block in each window of each anchor (id, label, v, windows)."""
    ids, labels, v, windows = anchors.flatten()
    ids, labels, matrix = np.asarray(ids), np.asarray(labels), _matrix(v, len(order), order)
    ends = np.asarray(windows.offsets)
    number, low, high = (np.asarray(c) for c in windows.values.flatten())
    least = np.minimum.reduceat(low[: ends[-1]], ends[:-1]).astype(np.float64)
    for begin in range(0, len(ids), _ANCHORS_AT_ONCE):
        some = slice(begin, begin + _ANCHORS_AT_ONCE)
        allowed = ((labels[some, None] == block.labels) == same) & (ids[some, None] != block.ids)
        for i, rows, scores in block.scores(matrix[some], least[some], allowed):
            if not len(rows):
                continue
            scores = scores.astype(np.int64)
            for w in range(ends[begin + i], ends[begin + i + 1]):
                inside = np.flatnonzero((scores >= low[w]) & (scores <= high[w]))
                if len(inside):
                    best = inside[first_of(block.ids[rows[inside]], scores[inside], count)]
                    yield int(ids[begin + i]), int(number[w]), block.ids[rows[best]], scores[best]


def search(index: DataFrame, blocks: int, anchors: DataFrame, order: np.ndarray, count: int, same: bool) -> DataFrame:
    """(anchor_id, window, id, score): the first `count` rows of every block in each window.

    anchors: id, label, v, part, windows (array of window, low, high). Each anchor block is one row that goes to every
    index block; windows of an anchor share the accumulation.
    """
    packed = anchors.groupBy("part").agg(F.collect_list(F.struct("id", "label", "v", "windows")).alias("anchors"))
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(index, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                if number != batch["block"][row].as_py():
                    number = batch["block"][row].as_py()
                    block = Block(*(batch[c][row].as_py() for c in ("ids", "labels", "vectors", "width")))
                found = list(block_hits(block, batch["anchors"][row].values, order, count, same))
                sizes = [len(f[2]) for f in found]
                columns = [np.repeat(np.array([f[0] for f in found], np.int64), sizes), np.repeat(np.array([f[1] for f in found], np.int32), sizes)]
                columns += [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "window", "id", "score"])

    return met.select("block", "ids", "labels", "vectors", "width", "anchors").mapInArrow(run, "anchor_id bigint, window int, id bigint, score bigint")


def falling_thresholds(low: int, high: int, mean: float, spread: float, rows: float, count: int) -> list[int]:
    """Thresholds within a window that are expected to pass more and more rows; the last is the window's lower end."""
    made: list[int] = []
    if spread > 0 and math.isfinite(mean) and rows > 0:
        normal = NormalDist(mean, spread)
        above = 0.0 if high >= _ALL else 1 - normal.cdf(high)
        for r in range(ROUNDS - 1):
            share = above + EXPECTED * count * GROWTH**r / rows
            if share >= 0.5:
                break
            made.append(min(max(math.floor(normal.inv_cdf(1 - share)), low), high))
    return [t for t in made if t > low] + [low]


def with_thresholds(anchors: DataFrame, sample: list, rows: int, dims: int, count: int, same: bool) -> DataFrame:
    """anchors (id, label, v, part, windows of window, low, high) with `lows`, the falling thresholds, in each window."""
    labels = np.array([r["label"] for r in sample], np.int64)
    drawn = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        drawn[i, : len(r["v"])] = r["v"]
    kind = pa.list_(pa.struct([("window", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("lows", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for label, v, windows in zip(*(batch[c].to_pylist() for c in ("label", "v", "windows"))):
                fits = (labels == label) == same
                scores = drawn[fits][:, : len(v)] @ np.array(v, np.float64)
                mean, spread = (float(scores.mean()), float(scores.std())) if len(scores) > 1 else (0.0, 0.0)
                expected = rows * len(scores) / max(1, len(sample))
                made.append([w | {"lows": falling_thresholds(w["low"], w["high"], mean, spread, expected, count)} for w in windows])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "label", "v", "part")), pa.array(made, kind)], names=["id", "label", "v", "part", "windows"])

    return anchors.select("id", "label", "v", "part", "windows").mapInArrow(run, "id bigint, label bigint, v array<bigint>, part int, windows array<struct<window:int,low:bigint,high:bigint,lows:array<bigint>>>")


def fill(index: DataFrame, blocks: int, anchors: DataFrame, order: np.ndarray, count: int, same: bool) -> DataFrame:
    """(anchor_id, window, id, score, rank): the first `count` rows of each window, or all it has, in rounds of falling thresholds.

    anchors: as with_thresholds returns them, written.
    """
    done, active = None, anchors
    for round_ in range(ROUNDS):
        # In this round a window reaches down to its next threshold, and is over if it fills or that was the last.
        at = lambda w: F.element_at(w["lows"], F.least(F.lit(round_ + 1), F.size(w["lows"])))
        asked = active.withColumn("windows", F.transform("windows", lambda w: F.struct(w["window"], at(w).alias("low"), w["high"])))
        hits = search(index, blocks, asked, order, count, same)
        first = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
        best = written(hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= count), "negatives-round")
        full = best.filter(F.col("rank") == count).select(F.col("anchor_id").alias("id"), "window")
        open_ = active.select("id", F.explode("windows").alias("w")).filter(F.size("w.lows") > round_ + 1).select("id", F.col("w.window").alias("window"))
        open_ = written(open_.join(full, ["id", "window"], "left_anti"), "negatives-open")
        settled = best.join(open_.withColumnRenamed("id", "anchor_id"), ["anchor_id", "window"], "left_anti")
        done = settled if done is None else done.unionAll(settled)
        still = open_.groupBy("id").agg(F.collect_set("window").alias("still"))
        if still.isEmpty():
            break
        kept = active.join(still, "id").withColumn("windows", F.filter("windows", lambda w: F.array_contains("still", w["window"])))
        active = written(kept.drop("still"), "negatives-active")
    return done


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of usable() rows (id, label, v).

    is_anchor: condition on `id`. Scores are inner products; higher ones come first, ties by smaller id. An anchor's
    positives are its first rows of the same label, its negatives for each of these the first rows of other labels whose
    score is between the two percentages of the positive's (none where that is negative). An anchor without positives or
    negatives gives no rows. Of rows that repeat an id one takes part, with the smallest label, then vector. A vector
    shorter than others counts as padded with zeros. Scores must fit into 64 bits. An empty table gives no rows.
    """
    spark = rows.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.count_if(is_anchor).alias("anchors")).first()
    if not facts["n"] or not facts["anchors"] or not facts["dims"]:
        return spark.createDataFrame([], schema)
    total, dims = facts["n"], facts["dims"]
    # One row per dimension.
    energy = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("e")).collect()
    order = np.array([r["d"] for r in sorted(energy, key=lambda r: (-r["e"], r["d"]))])
    # Every anchor goes to every block, so there are as many as the cores and the memory ask for, and no more.
    blocks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(total / block_rows))
    index = written(inverted_blocks(rows, blocks, dims, order), "negatives-index")

    # About SAMPLE_ROWS rows, whatever the table's size.
    share = min(1.0, SAMPLE_ROWS / total)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "v").collect()

    parts = math.ceil(facts["anchors"] / ANCHOR_ROWS)
    anchors = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s"))
    anchors = anchors.select("id", "s.label", "s.v", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int").alias("part"))
    window = lambda n, low, high: F.struct(n.cast("int").alias("window"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    wanted = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(_NONE), F.lit(_ALL))))
    wanted = written(with_thresholds(wanted, sample, total, dims, positives, True), "negatives-anchors")
    near = fill(index, blocks, wanted, order, positives, True)
    near = written(near.select("anchor_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    score, hundred = F.col("positive_score").cast("decimal(20,0)"), F.lit(100).cast("decimal(3,0)")
    low, high = F.ceil(score * least_percent / hundred), F.floor(score * most_percent / hundred)
    windows = near.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).filter("low <= high")
    windows = windows.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(window(F.col("window"), F.col("low"), F.col("high"))).alias("windows"))
    wanted = wanted.drop("windows").join(windows, "id")
    wanted = written(with_thresholds(wanted, sample, total, dims, negatives, False), "negatives-windows")
    found = fill(index, blocks, wanted, order, negatives, False)
    joined = found.join(near, ["anchor_id", "window"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The registered query's rows: anchors are ids divisible by 100, labels of ids divisible by 7 move on by one.
MINE_SQL = f"""
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
