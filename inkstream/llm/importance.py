"""Importance resampling towards a target set, with weights from bit-sliced aggregation.

A feature is a run of consecutive words; its bucket is crc32 modulo the number of buckets. A document's bucket counts are
cut into bit planes: plane p holds one bit per bucket, that of 2^p in the bucket's count. A bucket's gain, the floor of
SCALE times the logarithm of how much likelier it is in the target than in the documents, is cut likewise, with one more
plane of negative value for the sign (two's complement). The weight of a document is then a sum over pairs of planes:

    weight = sum over p, q of 2^p * (+/-) 2^q * popcount(count plane p AND gain plane q)

which is exact in integers. The gains are one number per bucket, so what tasks receive never grows with the data. Ranks
come from one range sort of (score, id) rows whose parts are numbered where they are and placed by the parts' sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, free_names, per_text, written

BUCKETS, LONGEST_RUN, SCALE = 10_000, 1, 1000
#: Of the documents with at least LEAST_WORDS words, PERCENT of a hundred are drawn.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Distinct features that a worker remembers, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64
#: Documents whose planes are made at once: a plane of 10,000 buckets takes 1.25 kB for each.
_AT_ONCE = 64
#: Row numbers of a part, in monotonically_increasing_id.
_PART_BITS = 33

#: Bytes of a word: digits, small letters and all of UTF-8 beyond ASCII; everything else divides words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case; none of a null text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Features:
    """Bucket numbers of all features of a text."""

    def __init__(self, buckets: int, longest_run: int) -> None:
        self.longest_run = longest_run
        self.bucket = Remembered(lambda feature: zlib.crc32(feature) % buckets, CACHE_ENTRIES, CACHE_CHARS)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        runs = [np.fromiter(map(self.bucket.__getitem__, words), np.int64, len(words))]
        for size in range(2, min(self.longest_run, len(words)) + 1):
            runs.append(np.array([self.bucket[b" ".join(words[i : i + size])] for i in range(len(words) - size + 1)], np.int64))
        return np.concatenate(runs)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest_run: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any. Every task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest_run), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(words_of(text.as_py())), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(text_col)).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest_run: int = LONGEST_RUN) -> DataFrame:
    """(bucket, gain): one row for every bucket, floor(SCALE * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

    S and T count all features of docs and target, s and t those of the bucket. Null texts have none; empty tables
    give counts of zero.
    """
    spark = docs.sparkSession
    counted = bucket_counts(docs, text_col, buckets, longest_run).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, text_col, buckets, longest_run).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    held = written(counted.unionAll(wanted).unionAll(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "importance-buckets")
    both = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    ratio = (F.col("t") + 1).cast("double") * (both["all_s"] + buckets) / ((F.col("s") + 1).cast("double") * (both["all_t"] + buckets))
    return held.select("bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).alias("gain"))


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers, lowest first, as rows of 64-bit words; numbers are the last axis of `values`."""
    count = int(values.shape[-1])
    depth = max(1, int(values.max(initial=0)).bit_length())
    words = -(-count // 64) * 64
    made = np.zeros((depth, *values.shape[:-1], words // 8), np.uint8)
    for p in range(depth):
        packed = np.packbits((values >> p) & 1 != 0, axis=-1, bitorder="little")
        made[p, ..., : packed.shape[-1]] = packed
    return made.view(np.uint64)


def signed_planes(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Planes of signed numbers in two's complement, and the value of each: powers of two, the last one negative."""
    depth = 1 + max(int(np.abs(values).max(initial=0)).bit_length(), 1)
    planes = planes_of(np.where(values < 0, values + (1 << depth), values))
    full = np.zeros((depth, planes.shape[-1]), np.uint64)
    full[: len(planes)] = planes
    return full, [1 << q for q in range(depth - 1)] + [-(1 << (depth - 1))]


def weights_of(documents: list[np.ndarray], gain_planes: np.ndarray, values: list[int], buckets: int) -> np.ndarray:
    """Weight of each document, given as the bucket numbers of its features: AND, popcount, sums of powers of two."""
    total = np.zeros(len(documents), np.int64)
    for first in range(0, len(documents), _AT_ONCE):
        some = documents[first : first + _AT_ONCE]
        counts = np.zeros((len(some), buckets), np.uint32)
        for i, numbers in enumerate(some):
            found, times = np.unique(numbers, return_counts=True)
            counts[i, found] = times
        most = counts.max(axis=1, initial=0)
        rows = np.arange(len(some))
        p = 0
        while (rows := rows[most[rows] >> p > 0]).size:
            plane = planes_of((counts[rows] >> p) & 1)[0]
            for gain_plane, value in zip(gain_planes, values):
                total[first + rows] += (value << p) * np.bitwise_count(plane & gain_plane).sum(axis=1, dtype=np.int64)
            p += 1
    return total


def weigh(docs: DataFrame, gained: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest_run: int = LONGEST_RUN) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of docs; the weight is the sum of the gains of all its features.

    gained: (bucket, gain), one row per bucket at most; a missing bucket gains nothing. A null or blank text has no
    features and weight 0. Repeated rows stay; extra columns aren't read.
    """
    # As many rows as there are buckets, a parameter.
    table = np.zeros(buckets, np.int64)
    for row in gained.select("bucket", "gain").toLocalIterator():
        table[row["bucket"]] = row["gain"]

    def make() -> Callable[[list], list[pa.Array]]:
        features = Features(buckets, longest_run)
        gain_planes, values = signed_planes(table)

        def run(texts: list) -> list[pa.Array]:
            words = [words_of(text) for text in texts]
            found = [features(w) for w in words]
            columns = [[len(w) for w in words], [len(f) for f in found], weights_of(found, gain_planes, values, buckets)]
            return [pa.array(c, pa.int64()) for c in columns]

        return run

    return per_text(docs, [id_col], "n_words bigint, n_features bigint, weight bigint", make, text_col)


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(-SCALE * ln(-ln(u))) for u from the first eight hex digits of sha256("seed:id"); a null id is written as nothing."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS, longest_run: int = LONGEST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs.

    score is the weight plus Gumbel noise of the id, so the highest scores are a draw without replacement in proportion
    to exp(weight / SCALE). Of the N documents with least_words words, floor(percent * N / 100) are drawn: the highest
    scores, ties to the smaller id (null ids last). rank numbers them from 1, others have null. Rows that repeat an id
    and score are ranked one after the other. An empty table gives no rows; an empty target makes all gains follow the
    documents alone. Extra columns aren't read.
    """
    spark = docs.sparkSession
    gained = gains(docs, target, text_col, buckets, longest_run)
    weighed = weigh(docs, gained, id_col, text_col, buckets, longest_run)
    score = F.col("weight") + noise(F.col(id_col), seed)
    scored = written(weighed.select(F.col(id_col), "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("enough")), "importance-scores")

    # Rows in order; a row's number in its part is fixed as the parts are written, and the parts' sizes place them.
    order = [F.col("enough").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", _PART_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("enough").alias("enough"))
    # One row per part of the sort: the session's shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), (F.sum("enough").over(everything) * percent / 100).cast("long").alias("drawn"))
    position = F.col("start") + (F.col("at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return ranked.select(F.col(id_col), "n_features", "weight", "score", F.when(position <= F.col("drawn"), position).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of docs whose id is drawn, all columns kept; null ids are one id."""
    drawn = resample(docs, target, id_col, text_col, **options).filter("rank is not null")
    name = free_names(docs, "drawn_id")[0]
    ids = drawn.select(F.col(id_col).alias(name)).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[name]), "left_semi")


#: The rows of resample() at its defaults. crc32 is a fold of each distinct word's bytes over the table of its polynomial.
RESAMPLE_SQL = f"""
WITH RECURSIVE powers AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM powers WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM powers WHERE k = 8),
cut AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), words AS (
  SELECT side, id, word, count(*) AS n FROM (SELECT side, id, unnest(w) AS word FROM cut) GROUP BY ALL
), bytes AS (
  SELECT word, [('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT FOR i IN range(1, length(hex(word)) // 2 + 1)] AS b
  FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc
), placed AS (SELECT side, id, bucket, n FROM words JOIN hashed USING (word)),
totals AS (
  SELECT sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS big_s, sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS big_t FROM placed
), gained AS (
  SELECT bucket, floor(1000 * ln((sum(CASE WHEN side = 't' THEN n ELSE 0 END) + 1)::DOUBLE * (any_value(big_s) + {BUCKETS})::DOUBLE
    / ((sum(CASE WHEN side = 'd' THEN n ELSE 0 END) + 1)::DOUBLE * (any_value(big_t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM placed, totals GROUP BY bucket
), weighed AS (
  SELECT id AS doc_id, sum(n * gain)::BIGINT AS weight FROM placed JOIN gained USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT id AS doc_id, w FROM cut WHERE side = 'd') LEFT JOIN weighed USING (doc_id)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS enough FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * enough // 100 THEN place END AS rank FROM ordered
"""
