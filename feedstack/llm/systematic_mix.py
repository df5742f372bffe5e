"""Mixing sources to target weights by systematic sampling.

A source's documents all have the same number of expected copies, target words / source words.  In a fixed order their
prefix sums are position x copies; one random offset for each source is added, and a document is emitted once for each
integer boundary that its step crosses.  The order runs by size, so the rounding of neighbours cancels out and a
source's taken words come near its target.

The position of a document is the number of documents in all smaller cells (source, size class, hash bin) plus its rank
in its own cell.  So a source, or many documents of one size, never meet in one task: only the counts of the cells do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, empty_as, written

#: Weights of the sources in the order of their names, repeating; the share of all words that the mix takes; the most
#: copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Documents of the largest source for each hash bin, and the least number of bins.
BIN_DOCS = 200_000
LEAST_BINS = 8


def word_count(col: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(empty_as(col), F.lit(WORD)).cast("long")


def _draw(key: Column) -> Column:
    """The first 32 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def source_key(source: str) -> Column:
    """A source's name, or a key of its own for null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (skey, source, source_size: one row for each source) with ``target``: the sources share ``share`` of
    all words by weight; none gets more than ``most`` times its size, and the excess goes to the others by weight.

    With the sources by ascending size for each weight, those that reach their limit come first; the first one that
    does not fixes the level for all after it."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    t = (t.withColumn("rank", F.row_number().over(by_limit))
         .withColumn("all", F.sum("source_size").over(everywhere) * F.lit(share))
         .withColumn("weights", F.sum("weight").over(everywhere))
         .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
         .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", (F.col("all") - F.col("full")) / (F.col("weights") - F.col("gone")))
    free = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("rank", "level"))
    t = t.withColumn("chosen", F.min(free).over(everywhere))
    return t.select("skey", "source", "source_size", F.when(
        F.col("chosen").isNull() | (F.col("rank") < F.col("chosen.rank")), F.col("limit"))
        .otherwise(F.col("chosen.level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, source: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ``source``; all columns are kept) with ``size`` (words), ``source_size``,
    ``target``, ``copies`` (0 to ``most``) and ``taken`` = copies x size.

    A column of ``docs`` with one of these five names is replaced.  Null texts have size 0; a null source is a source of
    its own, after all others.  Rows of one size and doc_id are ordered by a hash of their text, so reruns agree however the
    rows are partitioned; equal rows are told apart by position only, so it does not matter which of them is taken.  Sources without words have target 0 and no copies.  A run depends on the rows, ``seed`` and the weights
    only.  An empty table gives an empty result."""
    added = ("size", "source_size", "target", "copies", "taken", "skey", "_class", "_bin", "_rank", "_start", "_tkey")
    own = docs.select(*[c for c in docs.columns if c not in added])
    rows = own.withColumns({"size": word_count(), "skey": source_key(source), "_tkey": F.xxhash64(empty_as("text"))})
    sizes = written(rows.groupBy("skey").agg(F.first(F.col(source)).alias("source"), F.sum("size").alias("source_size"),
                                             F.count(F.lit(1)).alias("n")), "sizes")
    bins = F.greatest(F.lit(LEAST_BINS), F.ceil(F.max("n") / BIN_DOCS)).cast("long")
    n_bins = sizes.agg(F.coalesce(bins, F.lit(LEAST_BINS).cast("long"))).first()[0]
    rows = (rows.withColumn("_class", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
            .withColumn("_bin", _draw(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n_bins))
    cell = ["skey", "_class", "_bin"]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy("skey").orderBy("_class", "_bin")
              .rowsBetween(Window.unboundedPreceding, -1))
    cells = (counts.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
             .join(targets(sizes.drop("n"), weights, share, most).drop("source"), "skey"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", "_tkey"))
    placed = rows.withColumn("_rank", rank).join(cells, cell)
    offset = _draw(F.concat(F.lit(f"{seed}:"), F.col("skey"))) / F.lit(4294967296.0)
    expected = F.col("target") / F.col("source_size")
    position = F.col("_start") + F.col("_rank")
    copies = F.when(F.col("source_size") > 0, F.floor(position * expected + offset)
                    - F.floor((position - 1) * expected + offset)).otherwise(F.lit(0)).cast("long")
    return (placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select(*own.columns, "size", "source_size", "target", "copies", "taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 1 in ``copy``."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


#: DuckDB: the mix of a relation ``documents``; the same order, offsets and levels.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY skey),
b AS (SELECT greatest(8, ceil(coalesce(max(n), 0) / 200000.0))::BIGINT AS bins FROM s),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight,
         2 * source_size::DOUBLE AS lim
  FROM s),
l AS (
  SELECT *, row_number() OVER o AS rk, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
         coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used,
         coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gone
  FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)),
f AS (SELECT *, (total - used) / (weights - gone) AS lev FROM l),
c AS (SELECT min(rk) AS rk FROM f WHERE lev <= lim / weight),
t AS (
  SELECT f.skey, f.source_size,
         CASE WHEN c.rk IS NULL OR f.rk < c.rk THEN f.lim ELSE (SELECT lev FROM f f2 WHERE f2.rk = c.rk) * f.weight END AS target
  FROM f, c),
p AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.skey ORDER BY floor(sqrt(d.size::DOUBLE)),
                                 ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % b.bins, d.size, d.doc_id NULLS FIRST) AS pos
  FROM d, b),
m AS (
  SELECT p.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN
           (floor(pos * (t.target / t.source_size) + ('0x' || substr(md5('0:' || p.skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
            - floor((pos - 1) * (t.target / t.source_size) + ('0x' || substr(md5('0:' || p.skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::BIGINT
         ELSE 0 END AS copies
  FROM p JOIN t USING (skey))
"""
