"""Benchmark decontamination by template canonicalisation.

Words become template symbols: a number, a unit after a number and a capitalised name turn into typed placeholders, every
other word is its lower-cased self; punctuation separates words.  A capitalised word that begins a sentence is a name
unless it is one of ``STARTERS``.  Windows of the template, and windows of the words themselves, are joined by hash with
those of the benchmark.  Matches on one alignment of a document and an item are put together, and the slots are checked:
each literal of the item must stand for one literal of the document, and the other way round.  So a question whose numbers,
names or units were exchanged is found, and a text that only looks alike is not.

An alignment counts as evidence in two ways.  By its exact words: those under windows whose words, or whose slots too, are
equal; what happens beside them does not matter.  And by its longest stretch of matched words with consistent slots, if that has
at least half of the alignment's matched words; an alignment without a contradiction is such a stretch as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_as, list_column, text_runs, written
from .hashing import mix, span_hashes, spans

#: Words of a window, and of a run on one alignment that makes a document contaminated (a shorter item: all its words).
WINDOW = 8
RUN_WORDS = 13
#: Windows of the benchmark that one pass over the documents looks for; more of them take more passes.
PASS_WINDOWS = 1_000_000
#: Units that count as such after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs "
         "hour hours day days week weeks month months year years percent usd eur gbp dollar dollars cent cents euro euros "
         "pound pounds meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet "
         "gram grams kilogram kilograms liter liters litre litres degree degrees kb mb gb tb hz khz mhz ghz w kw mw v").split()
#: Capitalised at the start of a sentence, these are no names.
STARTERS = ("a after all an and are as at because before but by calculate can compute could did do does each every find "
            "for from given he her his how i if in is it its let my no not of on one or our she should since so solve "
            "some suppose take that the their then there these they this those to was we were what when where which "
            "while who whose why will with would you your").split()

_U = np.uint64
_ODD = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, 256, dtype=np.uint64) * _U(2) + _U(1)
NUMBER, UNIT, NAME = (int(x) for x in mix(np.arange(1, 4, dtype=np.uint64)))
_byte = np.arange(256)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_UPPER = (_byte >= 65) & (_byte <= 90)
_LOWER = (_byte >= 97) & (_byte <= 122)
_WORD = _DIGIT | _UPPER | _LOWER | (_byte >= 128)
_STOP = np.isin(_byte, list(b".!?\n"))
_POINT = np.isin(_byte, list(b".,"))


def _vocabulary(names: list[str]) -> np.ndarray:
    text = np.frombuffer("".join(names).encode(), np.uint8)
    end = np.cumsum([len(x.encode()) for x in names])
    return np.sort(span_hashes(text, np.r_[0, end[:-1]], end))


_UNIT_HASHES = _vocabulary(list(UNITS))
_STARTER_HASHES = _vocabulary(list(STARTERS))


def templates(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template symbols of all words of the rows, the literal hash of each placeholder (0 elsewhere), and the rows."""
    inside = _WORD[data]
    if len(data) > 2:  # a point between digits belongs to the number
        digit = _DIGIT[data]
        inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    start, end, row = spans(inside, bounds)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), row
    literal = span_hashes(data, start, end)
    number = _DIGIT[data[start]]
    same = np.r_[False, row[1:] == row[:-1]]
    unit = np.isin(literal, _UNIT_HASHES) & same & np.r_[False, number[:-1]]
    stops = np.r_[0, np.cumsum(_STOP[data])]
    gap = np.r_[0, end[:-1]]
    within = same & (stops[start] == stops[np.minimum(gap, start)])
    second = np.minimum(start + 1, len(data) - 1)
    name = _UPPER[data[start]] & ~number & ~unit & (end - start > 1) & ~_UPPER[data[second]]
    name &= within | ~np.isin(literal, _STARTER_HASHES)
    symbol = literal.copy()
    for chosen, value in ((number, NUMBER), (unit, UNIT), (name, NAME)):
        symbol[chosen] = _U(value)
    return symbol, np.where(number | unit | name, literal, _U(0)), row


def _hash(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h += mix(words[at + j] * _ODD[j] + _ODD[j + 1])
    return mix(h + _U(size))


def windows(symbol: np.ndarray, slot: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, exact) of the windows of ``size`` words within a row: one over the template where at least half of
    its words are literal, and one over the words themselves where any of them is a slot.  ``exact``: the hash tells the
    words (a template without slots does).  A short last window of a row is no window."""
    n = max(len(symbol) - size + 1, 0)
    filled = np.r_[0, np.cumsum(slot != 0)]
    held = filled[size:size + n] - filled[:n]
    whole = row[:n] == row[size - 1:size - 1 + n]
    masked, literal = np.flatnonzero(whole & (2 * held <= size)), np.flatnonzero(whole & (held > 0))
    return (np.concatenate([_hash(symbol, masked, size), _hash(np.where(slot != 0, slot, symbol), literal, size)]),
            np.concatenate([masked, literal]), np.concatenate([held[masked] == 0, np.ones(len(literal), bool)]))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


WINDOW_SCHEMA = "key long, pos int, size int, h long, slots array<bigint>"


def _windows_of(sizes: tuple[int, ...], wanted=None, whole: bool = False):
    """The windows of rows (key, text), all of them or those whose hash is wanted; an exact one has no ``slots``.
    ``whole``: a row with fewer words than the first size gives one window of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = wanted.value if wanted is not None else None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, bounds in text_runs(batch.column(1)):
                symbol, slot, row = templates(data, bounds)
                first = np.searchsorted(row, np.arange(j - i + 1))
                count = np.diff(first)
                for size in sorted({*sizes, *(count[(count > 0) & (count < sizes[0])].tolist() if whole else ())}):
                    h, at, exact = windows(symbol, slot, row, size)
                    kept = np.ones(len(at), bool)
                    if whole:  # windows of the main size, or the one window of a short row
                        kept &= (size == sizes[0]) | (count[row[at]] == size)
                    if look is not None:
                        kept &= look[np.minimum(np.searchsorted(look, h), len(look) - 1)] == h
                    h, at, exact = h[kept], at[kept], exact[kept]
                    for a in range(0, len(at), 1 << 15):
                        x, y, z = at[a:a + (1 << 15)], h[a:a + (1 << 15)], exact[a:a + (1 << 15)]
                        lits = slot[x[~z][:, None] + np.arange(size)].ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[i + row[x]]), pa.array((x - first[row[x]]).astype(np.int32)),
                             pa.array(np.full(len(x), size, np.int32)), pa.array(_signed(y)),
                             list_column(_signed(lits), np.where(z, 0, size), pa.int64())],
                            names=["key", "pos", "size", "h", "slots"])

    return run


def _row_key() -> Column:
    """A document row by its id and text: equal rows are one."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), empty_as("text"))


def _stretch(place: list[int], left: list[int], right: list[int], n: int) -> tuple[int, int, int]:
    """The longest stretch of ``n`` words whose slots are consistent, as (words, first slot, slot after the last); slot i is
    word ``place[i]`` and stands for ``left[i]`` in the item and ``right[i]`` in the document."""
    ends = [*place, n]
    ahead: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    best, first = (place[0] if place else n, 0, 0), 0
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        while (a in ahead and ahead[a][0] != b) or (b in back and back[b][0] != a):
            for known, x in ((ahead, left[first]), (back, right[first])):
                known[x][1] -= 1
                if not known[x][1]:
                    del known[x]
            first += 1
        ahead.setdefault(a, [b, 0])[1] += 1
        back.setdefault(b, [a, 0])[1] += 1
        best = max(best, (ends[i + 1] - (place[first - 1] + 1 if first else 0), first, i + 1), key=lambda x: x[0])
    return best


def _evidence(pos: np.ndarray, size: np.ndarray, n_slots: np.ndarray, a: np.ndarray, b: np.ndarray,
              least: int) -> tuple[int, int, int] | None:
    """(words, -changed, slots) of an alignment that counts.  Window i covers ``size[i]`` words of the item from ``pos[i]`` on;
    the slots of item and document, one for each word (0: a literal), follow each other in ``a`` and ``b``."""
    exact = n_slots == 0
    own = np.repeat(np.arange(len(pos)), n_slots)
    place = pos[own] + np.arange(len(own)) - np.r_[0, np.cumsum(n_slots)][own]
    differs = np.zeros(len(pos), bool)
    differs[own[a != b]] = True
    flat = np.repeat(pos - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    matched, same = np.unique(flat), np.unique(flat[np.repeat(exact | ~differs, size)])
    at, one = np.unique(place[a != 0], return_index=True)
    left, right = a[a != 0][one], b[a != 0][one]
    found = []
    if len(same) >= least:
        found.append((len(same), 0, int(np.isin(at, same).sum())))
    words, i, j = _stretch(np.searchsorted(matched, at).tolist(), left.tolist(), right.tolist(), len(matched))
    if words >= least and 2 * words >= len(matched):
        found.append((words, -int((left[i:j] != right[i:j]).sum()), j - i))
    return max(found, default=None)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments (key, item, least, seen) to (key, item, words, slots, changed) of those that count."""
    for batch in batches:
        out = []
        for key, item, least, seen in zip(*batch.columns, strict=True):
            pos, size, a, b = seen.values.flatten()
            best = _evidence(pos.to_numpy().astype(np.int64), size.to_numpy().astype(np.int64),
                             a.value_lengths().to_numpy().astype(np.int64), a.flatten().to_numpy(), b.flatten().to_numpy(),
                             least.as_py())
            if best is not None:
                out.append((key.as_py(), item.as_py(), best[0], best[2], -best[1]))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                         names=["key", "item", "words", "slots", "changed"])


def find(docs: DataFrame, benchmark: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(row_key, doc_id, item_id, words, slots, changed): a row for each document of ``docs`` (doc_id, text) and item
    of ``benchmark`` (item_id, text) of which it holds ``run_words`` words (a shorter item: all of them) on one alignment,
    exactly or with consistent slots (see above).  ``words`` is the most that an alignment has, ``slots`` its placeholders and
    ``changed`` those whose literal differs.

    Equal rows count once (``row_key`` tells rows by id and text; a null doc_id is kept).  Null and empty texts on either
    side match nothing; a null item_id is kept as such.  Texts are read whole, in one pass of cost in their length; the windows
    of one alignment, no more than the item has, are judged together.  Other columns are ignored.  An empty table on either
    side gives an empty result."""
    spark = docs.sparkSession
    items = benchmark.select(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")),
                                        empty_as("text")).alias("key"),
                             F.col("item_id").cast("long").alias("item_id"), empty_as("text").alias("text"))
    items = items.dropDuplicates(["key"])
    parts = written(items.select("key", "text").mapInArrow(_windows_of((WINDOW,), whole=True), WINDOW_SCHEMA), "items")
    least = parts.groupBy("key").agg(F.least(F.max(F.col("pos") + F.col("size")), F.lit(run_words)).alias("least"))
    sizes = sorted({WINDOW, *[r[0] for r in parts.select("size").distinct().collect()]}, reverse=True)
    parts = parts.join(least, "key").select(F.col("key").alias("item"), "least", F.col("pos").alias("item_pos"), "h",
                                            F.col("slots").alias("item_slots"))
    text = docs.select(_row_key().alias("key"), empty_as("text").alias("text"))
    # The windows looked for in a pass are bounded; a larger benchmark takes several passes over all documents.
    hashes = written(parts.select("h").distinct().withColumn("lot", F.pmod(F.xxhash64("h"), F.lit(1 << 20))), "hashes")
    total = hashes.count()
    passes = max(1, -(-total // PASS_WINDOWS))
    hits = None
    for k in range(passes):
        own = hashes.filter(F.col("lot") % passes == k).select("h").toPandas()["h"].to_numpy(np.int64)
        if not len(own):
            continue
        wanted = spark.sparkContext.broadcast(np.sort(own.view(np.uint64)))
        found = text.mapInArrow(_windows_of(tuple(sizes), wanted), WINDOW_SCHEMA)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], WINDOW_SCHEMA)
    hits = written(hits.withColumn("seen", F.xxhash64("key", "pos", "h")).dropDuplicates(["seen"]).drop("seen"), "hits")
    # An alignment has one window of each kind for a position of the item; windows that together are too short are left out.
    aligned = (hits.join(parts, "h").groupBy("key", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
               .agg(F.first("least").alias("least"), F.sum("size").alias("most"),
                    F.collect_list(F.struct("item_pos", "size", "item_slots", "slots")).alias("seen"))
               .filter("most >= least").select("key", "item", "least", "seen"))
    kept = (aligned.mapInArrow(_judge, "key long, item long, words int, slots int, changed int")
            .groupBy(F.col("key").alias("row_key"), "item")
            .agg(F.max(F.struct("words", (-F.col("changed")).alias("kept"), "slots")).alias("best"))
            .join(items.select(F.col("key").alias("item"), "item_id"), "item"))
    ids = docs.select(_row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"))
    ids = ids.join(kept.select("row_key").distinct(), "row_key", "left_semi").distinct()
    return ids.join(kept, "row_key").select(
        "row_key", "doc_id", "item_id", F.col("best.words").cast("long").alias("words"),
        F.col("best.slots").cast("long").alias("slots"), (-F.col("best.kept")).cast("long").alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no run of the benchmark, with all their columns."""
    bad = written(find(docs, benchmark, run_words).select("row_key").distinct(), "contaminated")
    return (docs.withColumn("_row_key", _row_key())
            .join(bad.withColumnRenamed("row_key", "_row_key"), "_row_key", "left_anti").select(*docs.columns))
