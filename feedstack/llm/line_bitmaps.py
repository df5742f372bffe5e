"""Line dedup by range-partitioned line hashes, as compressed keep bitmaps.

Column expressions only.  A line's key is the line without white space at both ends, A-Z lower-cased; two 64-bit hashes stand
for it.  The hashes of every document are written once as a compact table, so that texts are cut into lines once:

1. ``repartitionByRange`` deals the (hash, document, position) rows by the hash, and they are sorted by hash, document and
   position inside a partition.  A window reads each key's rows in that order: the first row is the first occurrence, and
   a row whose document differs from the one before begins another document.  The range is the window's own
   partitioning, so there is no second shuffle.
2. A key that holds a large share of all rows would fill one partition.  A mergeable sketch (``approx_top_k``, at most
   ``HEAVY`` keys) finds such keys among all rows; one partial aggregate counts them exactly; and their rows are
   dealt by (hash, salt), so that many partitions read them.  The exact counts, at most ``HEAVY`` rows, are broadcast.  The
   sketch decides only where rows go, never what is dropped.
3. Dropped positions of a document become its keep bitmap: the ascending bounds ``[s0, e0, s1, e1, ...]`` of its dropped
   runs [s, e).  No text is shuffled for it.  ``apply`` joins bitmaps with texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, empty_as, written

#: White space stripped at both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that the sketch reports at most, and keys that it tracks.
HEAVY, TRACKED = 1000, 10_000
#: A key is heavy when it holds more rows than this part of a partition's mean; its rows go in pieces of about that size.
SHARE = 4


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), _UPPER, _LOWER)


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with two hashes of its text, which with its id name a document."""
    return docs.withColumns({"_text": empty_as("text")}).select(
        *[F.col(c) for c in docs.columns], "_text", F.xxhash64("_text").alias("_t1"),
        F.xxhash64(F.lit(7), F.col("_text")).alias("_t2"))


def hashed_lines(docs: DataFrame, by: str, least_chars: int) -> DataFrame:
    """Per row: ``by, _t1, _t2, n_lines``, and of each line two hashes of its key (null where the key is too short)."""
    keys = F.transform(F.split("_text", "\n"), line_key)

    def hashed(*salt: Column) -> Column:
        return F.transform("_keys", lambda k: F.when(F.length(k) >= least_chars, F.xxhash64(*salt, k)))

    return (_identified(docs.select(by, "text")).select(by, "_t1", "_t2", keys.alias("_keys"))
            .select(by, "_t1", "_t2", F.size("_keys").alias("n_lines"), hashed().alias("_h"), hashed(F.lit(7)).alias("_g")))


def keep_bitmaps(docs: DataFrame, least_docs: int = 2, keep_first: bool = True, least_chars: int = 1,
                 by: str = "doc_id") -> DataFrame:
    """One row per document of ``docs`` (``by``, text; other columns are ignored): ``by``, two hashes of the text, ``n_lines,
    n_dropped`` (long) and ``bounds`` (array<int>): the bounds [s0, e0, s1, e1, ...] of the dropped runs of lines, from 0.

    A line whose key has ``least_chars`` code points and stands in at least ``least_docs`` documents is dropped, but for its
    first occurrence (least document, then least position) with ``keep_first``.  A null or empty text is one empty line.
    Rows that are equal in ``by`` (null is a value) and text are one document given again: they count once and share a
    bitmap.  Rows with one ``by`` and other texts are other documents.  A very long text is an array of line hashes in one
    row.  An empty table gives an empty result."""
    document = [by, "_t1", "_t2"]
    lines = written(hashed_lines(docs, by, least_chars), "line-hashes")
    every = lines.select(*document, F.explode(F.filter(
        F.transform(F.arrays_zip("_h", "_g"), lambda x, i: F.struct(x["_h"].alias("h"), x["_g"].alias("g"), i.alias("pos"))),
        lambda x: x["h"].isNotNull())).alias("_x"))
    rows = every.select(*document, F.col("_x.h").alias("_h"), F.col("_x.g").alias("_g"), F.col("_x.pos").alias("_pos"))
    total = lines.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n")).first().n

    piece = max(1, total // (SHARE * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    often = written(
        rows.agg(F.expr(f"approx_top_k(_h, {HEAVY}, {TRACKED})").alias("x")).select(F.explode("x").alias("x"))
        .filter(F.col("x.count") > piece)
        .select(F.col("x.item").alias("_h"), F.ceil(F.col("x.count") / piece).cast("long").alias("_pieces")), "heavy-lines")
    # exact numbers of the heavy keys: at most HEAVY hashes; one row per document and key, then one per key
    held = (rows.join(F.broadcast(often), "_h").groupBy("_h", "_g", *document).agg(F.min("_pos").alias("_pos"))
            .groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_all"), F.min(F.struct(*document, "_pos")).alias("_least")))
    held = written(held, "heavy-counts")
    salt = F.coalesce(F.pmod(F.xxhash64(*document), F.col("_pieces")), F.lit(0).cast("long"))
    dealt = (rows.join(F.broadcast(often), "_h", "left").withColumn("_salt", salt)
             .select(*document, "_h", "_g", "_pos", "_salt").repartitionByRange("_h", "_g", "_salt"))
    key = Window.partitionBy("_h", "_g", "_salt")
    ordered = key.orderBy(*document, "_pos")
    this, last = F.struct(*document), F.lag(F.struct(*document)).over(ordered)
    streamed = (dealt.withColumn("_begins", F.when(this.eqNullSafe(last), 0).otherwise(1))
                .withColumn("_rank", F.row_number().over(ordered))
                .withColumn("_docs", F.sum("_begins").over(key)))
    joined = streamed.join(F.broadcast(held), ["_h", "_g"], "left")
    repeated = joined.filter(F.coalesce("_all", "_docs") >= least_docs)
    if keep_first:
        first = F.when(F.col("_all").isNull(), F.col("_rank") == 1).otherwise(
            F.struct(*document, "_pos").eqNullSafe(F.col("_least")))
        repeated = repeated.filter(~first)
    placed = (lines.select(*document, "n_lines", F.lit(None).cast("int").alias("_pos"))
              .unionByName(repeated.select(*document, F.lit(None).cast("int").alias("n_lines"), F.col("_pos").cast("int")))
              .groupBy(*document).agg(F.max("n_lines").cast("long").alias("n_lines"),
                                      F.sort_array(F.collect_set("_pos")).alias("_d")))
    # runs of the dropped positions, in one pass over them
    starts = F.filter("_d", lambda x, i: (i == 0) | (F.col("_d")[i - 1] != x - 1))
    ends = F.filter("_d", lambda x, i: (i == F.size("_d") - 1) | (F.col("_d")[i + 1] != x + 1))
    out = (placed.withColumns({"_starts": starts, "_ends": ends})
           .select(*document, "n_lines", F.size("_d").cast("long").alias("n_dropped"),
                   F.flatten(F.zip_with("_starts", "_ends", lambda s, e: F.array(s, e + 1))).alias("bounds")))
    out = written(out, "keep-bitmaps")
    for table in (lines, often, held):
        discard(table)
    return out


def apply(docs: DataFrame, bitmaps: DataFrame, by: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that ``bitmaps`` keeps (joined by \\n; a null text becomes empty), and
    ``n_lines, n_dropped``.  Other columns stay, also repeated rows."""
    short = bitmaps.filter("n_dropped > 0").select(F.col(by).alias("_by"), F.col("_t1").alias("_u1"), F.col("_t2").alias("_u2"),
                                                   F.col("bounds").alias("_bounds"))
    rows = _identified(docs)
    met = rows.join(short, rows[by].eqNullSafe(short["_by"]) & (F.col("_t1") == F.col("_u1")) & (F.col("_t2") == F.col("_u2")),
                    "left")
    met = met.withColumns({"_lines": F.split("_text", "\n"), "_bounds": F.coalesce("_bounds", F.array().cast("array<int>"))})
    met = met.withColumn("_n", F.size("_lines"))
    runs = F.sequence(F.lit(0), F.expr("cast(size(_bounds) / 2 as int)"))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("_bounds", 2 * i - 1))
    end = lambda i: F.coalesce(F.get("_bounds", 2 * i), F.col("_n"))
    kept = F.flatten(F.transform(runs, lambda i: F.slice("_lines", begin(i) + 1, end(i) - begin(i))))
    dropped = F.aggregate(F.transform("_bounds", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda s, x: s + x)
    return met.select(*[F.when(F.size("_bounds") > 0, F.array_join(kept, "\n")).otherwise(F.col("_text")).alias("text")
                        if c == "text" else F.col(c) for c in docs.columns],
                      F.col("_n").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
