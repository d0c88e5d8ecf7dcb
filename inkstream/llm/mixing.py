"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Each document of a source expects the same number of copies, the source's target over its size. Along the documents of
the source (by size, so that any run of copies takes long and short ones in proportion) these expectations are summed;
one random offset per source is added, and a document is emitted once for each integer that its step crosses.

The running sum needs a document's rank in its source. No source is sorted in one task: ranks are counted inside
(source, size, block) cells, and the cells before are summed from their counts, over sizes first and blocks second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blocks_for, written

#: Weights by position of the source in code point order, null last; they repeat.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MOST_REPEATS = 3
#: Rows of one source and size that one task ranks.
BLOCK_ROWS = 20_000
SEED = 42
#: Offsets are multiples of 2^-20, so that adding one to a whole number is exact.
_OFFSETS = 1 << 20


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hashed(text: Column, below: int | Column) -> Column:
    """A number from 0 to below - 1 made of the first 28 bits of a digest, the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), below if isinstance(below, Column) else F.lit(below))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, position, weight, target) from (source, size).

    The targets share the sum of all sizes by weight. Those above `most` times their source's size stop there and the
    rest is shared again; this ends with all of the sources capped whose most * size / weight is small: with the
    sources in this order, one is capped if it is so when all before it are. One row per source passes through the
    window, never one per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("position", F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "position")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left_size = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = most * F.col("source_size") * left_weight < F.col("weight") * left_size
    marked = weighed.withColumn("capped", capped)
    free = Window.partitionBy()
    rest = F.sum("source_size").over(free) - most * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(free), F.lit(0))
    shares = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(free), F.lit(0))
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(rest.cast("double") * F.col("weight") / shares)
    return marked.select("source", "source_size", "position", "weight", target.alias("target"))


def with_copies(docs: DataFrame, sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with _size, _source_size, _target and _copies.

    docs has the columns _size (words) and _tie (a text that orders rows of one id); sized holds the same rows'
    (id, source, _size, _tie), written. A source without words has target 0 and gives no copies.
    """
    blocks = blocks_for(sized.count(), block_rows)
    sources = targets(sized.select(F.col(source_col).alias("source"), F.col("_size").alias("size")), weights, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hashed(F.concat(F.lit(f"{seed} "), F.coalesce(F.col("source"), F.lit("null"))), _OFFSETS) / F.lit(float(_OFFSETS))
    sources = written(sources.withColumn("expected", expected).withColumn("offset", offset), "mix-sources")

    def celled(df: DataFrame) -> DataFrame:
        # A source is known by its position from here on: never null, and short.
        named = sources.select(F.col("source").alias("_source"), F.col("position").alias("_position"))
        joined = df.join(named, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
        return joined.withColumn("_block", _hashed(F.coalesce(F.col(id_col).cast("string"), F.col("_tie")), blocks))

    cell = ["_position", "_size", "_block"]
    counts = celled(sized).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    by_size = counts.groupBy("_position", "_size").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("_position", "_size", F.coalesce(F.sum("n").over(before("_position", "_size")), F.lit(0)).alias("smaller"))
    in_size = counts.select(*cell, F.coalesce(F.sum("n").over(before("_position", "_size", "_block")), F.lit(0)).alias("earlier"))
    starts = in_size.join(by_size, ["_position", "_size"]).select(*cell, (F.col("smaller") + F.col("earlier")).alias("_before"))
    starts = written(starts, "mix-cells")
    rates = sources.select(F.col("position").alias("_position"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "expected", "offset")
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(id_col), F.col("_tie")))
    placed = celled(docs).withColumn("_inside", inside).join(starts, cell).join(rates, "_position")
    rank = F.col("_before") + F.col("_inside")
    crossed = F.floor(F.col("offset") + F.col("expected") * rank) - F.floor(F.col("offset") + F.col("expected") * (rank - 1))
    return placed.withColumn("_copies", crossed.cast("long")).drop("_position", "_block", "_inside", "_before", "expected", "offset")


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with the word count and, where the id is null, a digest of the text."""
    tie = F.when(F.col(id_col).isNull(), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.withColumn("_size", word_count(text_col)).withColumn("_tie", tie)


def takings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """(id, size, source_size, target, taken) for every document.

    size: words of the text (null: 0); taken: words that the mix takes of it, repeats counted. A null source is one
    more source, the last. Documents with a null id are told apart by their text. Repeated rows are documents of
    their own. An empty table gives no rows; extra columns aren't read. The same rows give the same mix each time.
    """
    narrow = sized_rows(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).select(id_col, source_col, "_size", "_tie")
    sized = written(narrow, "mix-sizes")
    mixed = with_copies(sized, sized, id_col, source_col, **options)
    return mixed.select(id_col, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (also not at all), with all their columns.

    The rules are those of `takings`. Columns of docs that begin with an underscore keep their values.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    keys = (names[id_col], names[text_col], names[source_col])
    sized = written(sized_rows(plain.select(*dict.fromkeys(keys)), *keys).select(keys[0], keys[2], "_size", "_tie"), "mix-sizes")
    mixed = with_copies(sized_rows(plain, *keys), sized, keys[0], keys[2], **options).filter("_copies > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select(*(F.col(n).alias(c) for c, n in names.items()))


def takings_sql(table: str = "documents", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> str:
    """DuckDB SQL for `takings` on a table with distinct ids; the targets come from repeated sharing."""
    hashed = lambda text, below: f"(('0x' || substr(md5({text}), 1, 7))::BIGINT % {below})"
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
weighed AS (SELECT *, CASE pos % {len(weights)} {cases} END::BIGINT AS weight FROM named),
rounds AS (
  SELECT 0 AS round, list(pos ORDER BY pos) AS open FROM weighed
  UNION ALL
  SELECT round, open FROM (
    SELECT r.round + 1 AS round, (
      SELECT coalesce(list(w.pos ORDER BY w.pos), []) FROM weighed w
      WHERE list_contains(r.open, w.pos) AND {most} * w.source_size * (SELECT sum(weight) FROM weighed WHERE list_contains(r.open, pos))
        >= w.weight * ((SELECT sum(source_size) FROM weighed) - {most} * (SELECT coalesce(sum(source_size), 0) FROM weighed WHERE NOT list_contains(r.open, pos)))) AS open,
      r.open AS earlier
    FROM rounds r) WHERE len(open) < len(earlier)),
last AS (SELECT open FROM rounds ORDER BY round DESC LIMIT 1),
shared AS (
  SELECT w.source, w.source_size, w.pos, CASE WHEN list_contains(open, pos)
    THEN ((SELECT sum(source_size) FROM weighed) - {most} * (SELECT coalesce(sum(source_size), 0) FROM weighed x WHERE NOT list_contains(open, x.pos)))::DOUBLE
      * w.weight / (SELECT sum(weight) FROM weighed x WHERE list_contains(open, x.pos))
    ELSE ({most} * w.source_size)::DOUBLE END AS target
  FROM weighed w, last),
ranked AS (
  SELECT s.doc_id, s.size, h.source_size, h.target,
    CASE WHEN h.source_size > 0 THEN h.target / h.source_size ELSE 0.0 END::DOUBLE AS expected,
    {hashed(f"'{seed} ' || coalesce(h.source, 'null')", _OFFSETS)} / {float(_OFFSETS)}::DOUBLE AS shift,
    row_number() OVER (PARTITION BY h.pos ORDER BY s.size,
      {hashed("s.doc_id::VARCHAR", f"greatest(1, ceil((SELECT count(*) FROM sized) / {block_rows}.0)::BIGINT)")}, s.doc_id) AS rank
  FROM sized s JOIN shared h ON s.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, (size * (floor(shift + expected * rank) - floor(shift + expected * (rank - 1))))::BIGINT AS taken FROM ranked"""
