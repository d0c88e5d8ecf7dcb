"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII blanks; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: str | None = None
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    A session on one machine (master local or local[n]) that names none gets a temporary folder, removed at its end.
    On a cluster the setting is needed: another machine cannot see a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that this run made itself."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Remembered(dict):
    """Results of a function by key, in bounded memory: the last `entries` keys seen, and those seen before once again.

    A full table becomes the older generation; what is asked for again moves back from there.
    """

    def __init__(self, function: Callable[[str], object], entries: int, longest: int) -> None:
        super().__init__()
        self.function, self.entries, self.longest, self.older = function, entries // 2, longest, {}

    def __missing__(self, key: str) -> object:
        found = self.older.get(key)
        if found is None:
            found = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def clean_up(spark: SparkSession) -> None:
    """Delete what the operators of this session have written to the shared folder; their results must be stored by then."""
    while _made:
        remove(spark, _made.pop())


def in_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with state per task: `make` runs once in the task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def per_text(df: DataFrame, keys: list[str], schema: str, make: Callable[[], Callable[[list], list[pa.Array]]], text: str = "text") -> DataFrame:
    """The key columns as they are, followed by what a task's function makes of the list of whole texts."""
    names = [*keys, *(part.split()[0] for part in schema.split(", "))]
    declared = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), schema])

    def prepare() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        step = make()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [batch.column(i) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, *step(batch.column(len(keys)).to_pylist())], names=names)

        return run

    return in_batches(df.select(*keys, F.col(text)), declared, prepare)


def utf8_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text).cast("long"), F.lit(0).cast("long"))


def blocks_for(rows: int, per_block: int) -> int:
    """Number of hash blocks that keeps a block of any one key near `per_block` rows."""
    return max(1, math.ceil(rows / per_block))


def first_by_hash(rows: DataFrame, key: str, count: int, *ties: str | Column) -> DataFrame:
    """The first `count` rows by a hash of `key`, then `ties`.

    Rows that the table's size puts far beyond the last of them are dropped before any are ordered, so about `count` rows
    are ordered in all, not as many of each partition. A table that is scanned twice here should be written before.
    """
    total, place = rows.count(), F.xxhash64(key)
    share = (count + 6 * math.sqrt(count) + 10) / max(total, 1)
    while share < 1:
        near = rows.filter(place <= int(-(2**63) + share * (2**64 - 1)))
        if near.count() >= count:
            return near.orderBy(place, key, *ties).limit(count)
        # A key that holds many rows lies beyond the cut.
        share *= 8
    return rows.orderBy(place, key, *ties).limit(count)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, count: int, *ties: str) -> DataFrame:
    """(label_id, *ties, text): at most `count` labelled documents of docs, the first by a hash of the id.

    labels: label_id and the columns `ties`. Only labels of ids that docs hold are candidates, so a part of the documents
    has as many rows to learn from as it can; where ids repeat, the bound holds for the joined rows as well.
    """
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id")).distinct()
    known = written(labels.join(ids, "label_id", "left_semi"), "labelled-ids")
    chosen = first_by_hash(known, "label_id", count, *ties)
    # At most `count` short rows.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("label_id", *ties, "text"), "labelled-texts")
    return written(first_by_hash(rows, "label_id", count, *ties, F.xxhash64("text")), "labelled-rows") if rows.count() > count else rows


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have yet (compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def without(docs: DataFrame, losers: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is an id of losers; all columns stay, a null id is one id."""
    gone = free_names(docs, "gone")[0]
    ids = losers.select(F.col(id_col).alias(gone)).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids[gone]), "left_anti")


#: Parts into which the joins of `components` cut the edges of a node, so that a hub is never one task's work.
HUB_PARTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m of least (a, m); the edges of one a are spread over HUB_PARTS keys.

    Spark sizes the repeated side as if it were not repeated, and might broadcast it; so the join is named.
    """
    left = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)))
    right = least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long"))))
    return left.join(right.hint("merge"), ["a", "part"]).drop("part")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) can reach.

    Alternating large-star and small-star steps on the edge table: every step is a grouped minimum (combined before
    the shuffle) and a salted join, so a hub never meets in one task, and the number of steps grows with the logarithm
    of the longest chain. Each round is a table in the shared folder that replaces the one before. Nulls and loops
    are ignored.
    """
    spark, path = edges.sparkSession, None
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        previous, path = path, new_folder(spark, name)
        if previous is not None:
            # Large star: a node's larger neighbours move to the smallest of its neighbours and itself.
            both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # Small star: a node's smaller neighbours and the node itself move to the smallest of them.
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            current = _with_least(large, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        current.write.parquet(path)
        current = spark.read.schema("a bigint, b bigint").parquet(path)
        if previous is not None:
            remove(spark, previous)
        # Done when every edge leads to a root: no node has two parents, and no parent has one.
        nodes = current.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        nodes = nodes.unionAll(current.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").isEmpty():
            break
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
