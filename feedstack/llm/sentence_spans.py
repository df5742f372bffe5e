"""Substring dedup by sliding sentence spans.

From every sentence on, the shortest run of at least SENTENCES sentences and WORDS words is hashed; runs are compared over
all documents, and every sentence covered by a run that is not the first of its kind (by doc_id, then place) is removed.

A map task already knows the first run of each hash among its own rows: all others of it are repeats for certain and are not
compared any further.  So each task gives at most one run of a hash to the comparison, and a passage that many documents
share never gathers in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_as, text_runs
from .hashing import mix, power, span_hashes, spans

#: A run has at least so many sentences and words.  From its LONG-th word on, a sentence is also cut after each word whose
#: hash is divisible by CUT: so long stretches without a full stop are compared too, wherever they start.
SENTENCES, WORDS, LONG, CUT = 2, 16, 16, 4

_U = np.uint64
_byte = np.arange(256)
_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_STOP = np.isin(_byte, list(b".!?\n"))


def sentences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sentences of all rows: first byte, row, words before it, and the running hash sums of the words."""
    start, end, row = spans(_WORD[data], bounds)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(1, np.uint64)
    up, _ = power(len(start) + 1)
    word = mix(span_hashes(data, start, end))
    sums = np.zeros(len(start) + 1, np.uint64)
    np.cumsum(word * up[:len(start)], out=sums[1:])
    stops = np.r_[0, np.cumsum(_STOP[data])][start]
    fresh = np.r_[True, (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])]
    begin = np.flatnonzero(fresh)
    inside = np.arange(len(start)) - np.repeat(begin, np.diff(np.r_[begin, len(start)]))
    first = np.flatnonzero(fresh | np.r_[False, (inside[:-1] >= LONG - 1) & (word[:-1] % _U(CUT) == 0)])
    return start[first], row[first], first, sums


def runs(row: np.ndarray, first: np.ndarray, sums: np.ndarray, n_sentences: int, n_words: int) -> tuple[np.ndarray, ...]:
    """(hash, sentence, length in sentences) of the run from each sentence on; those cut off by the row's end are none."""
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.r_[first, len(sums) - 1]
    at = np.arange(n)
    to = np.maximum(at + n_sentences, np.searchsorted(edge, first + n_words))
    good = to <= np.searchsorted(row, row, side="right")
    at, to = at[good], to[good]
    _, down = power(len(sums))
    return mix((sums[edge[to]] - sums[edge[at]]) * down[edge[at]] + (edge[to] - edge[at]).astype(np.uint64)), at, to - at


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


RUNS = "h long, known boolean, doc long, tkey long, pos int, len int, salt long"
KEY = ["doc", "tkey"]


def _occurrences(docs: DataFrame, n_sentences: int, n_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            tkey = batch.column(1).to_numpy(zero_copy_only=False)
            made = []
            for i, _, data, bounds in text_runs(batch.column(2)):
                _, row, first, sums = sentences(data, bounds)
                h, at, length = runs(row, first, sums, n_sentences, n_words)
                pos = at - np.searchsorted(row, row[at])
                made.append((h, doc[i + row[at]], tkey[i + row[at]], pos, length))
            h, d, t, pos, length = (np.concatenate(x) for x in zip(*made, strict=True)) if made else [np.zeros(0, np.int64)] * 5
            order = np.lexsort((pos, t, d, h))
            h, d, t, pos, length = h[order], d[order], t[order], pos[order], length[order]
            same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
            twin = np.r_[False, (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (pos[1:] == pos[:-1])] if len(h) else same
            # The same row twice is one occurrence; it keeps the standing of its twin.
            kept = ~(same & twin)
            h, d, t, pos, length, same = h[kept], d[kept], t[kept], pos[kept], length[kept], same[kept]
            for a in range(0, len(h), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(h[s])), pa.array(same[s]), pa.array(d[s]), pa.array(t[s]), pa.array(pos[s].astype(np.int32)),
                     pa.array(length[s].astype(np.int32)), pa.array(np.where(same[s], t[s] ^ pos[s], 0))],
                    names=["h", "known", "doc", "tkey", "pos", "len", "salt"])

    return docs.mapInArrow(run, RUNS)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are not the first of their hash among the rows of this partition, or known as repeats."""
    parts = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in range(6)) for b in batches]
    if not parts:
        return
    h, known, d, t, pos, length = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((pos, t, d, h, known))
    open_ = order[~known[order]]
    same = np.r_[False, h[open_[1:]] == h[open_[:-1]]] if len(open_) else np.zeros(0, bool)
    if len(open_):  # twins of the first occurrence are no repeats
        lead = np.flatnonzero(~same)
        head = np.repeat(open_[lead], np.diff(np.r_[lead, len(open_)]))
        same &= (d[open_] != d[head]) | (t[open_] != t[head]) | (pos[open_] != pos[head])
    at = np.concatenate([open_[same], np.flatnonzero(known)])
    for a in range(0, len(at), 1 << 16):
        x = at[a:a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(d[x]), pa.array(t[x]), pa.array(pos[x]), pa.array(length[x])],
                                         names=["doc", "tkey", "pos", "len"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = batch.column(0), batch.column(2).to_pylist()
        for i, j, data, bounds in text_runs(batch.column(1)):
            begin, row, _, _ = sentences(data, bounds)
            first = np.searchsorted(row, np.arange(j - i + 1))
            texts, total, removed = [], [], []
            for r in range(j - i):
                n = int(first[r + 1] - first[r])
                raw = data[bounds[r]:bounds[r + 1]].tobytes()
                gone = np.zeros(n + 1, np.int64)
                for m in marks[i + r] or ():
                    gone[m["pos"]] += 1
                    gone[min(m["pos"] + m["len"], n)] -= 1
                gone = np.cumsum(gone)[:n] > 0
                if gone.any():
                    edge = np.r_[begin[first[r]:first[r + 1]] - bounds[r], len(raw)]
                    raw = raw[:edge[0]] + b"".join(raw[edge[k]:edge[k + 1]] for k in np.flatnonzero(~gone))
                texts.append(raw.decode())
                total.append(n)
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(texts, pa.string())], names=["doc_id", "n_sentences", "n_removed", "text"])


def dedup_spans(docs: DataFrame, n_sentences: int = SENTENCES, n_words: int = WORDS, parts: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_sentences, n_removed, text`` (what is kept).

    Words are runs of letters and digits, compared with A-Z in lower case; sentences end at ``.``, ``!``, ``?`` or a line
    feed (long ones also inside, see LONG).  The first occurrence of a run is that of the smallest doc_id (null last; then by a hash of the text), then the
    earliest.  A removed sentence goes with what follows it up to the next one.  Rows equal in id and text are one document
    and get the same result; null texts count as empty; other columns are ignored; an empty table gives an empty result.
    ``parts``: partitions of the comparison (default: the session's shuffle partitions), whose share is held as arrays."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keyed = docs.select(doc.alias("doc"), F.xxhash64(empty_as("text")).alias("tkey"), empty_as("text").alias("text"), "doc_id")
    seen = _occurrences(keyed.select("doc", "tkey", "text"), n_sentences, n_words)
    repeats = (seen.repartition(parts, "h", "salt").drop("salt")
               .mapInArrow(_repeats, "doc long, tkey long, pos int, len int"))
    marks = repeats.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "len")).alias("marks"))
    kind = dict(docs.dtypes)["doc_id"]
    return (keyed.join(marks, KEY, "left").select("doc_id", "text", "marks")
            .mapInArrow(_cut, f"doc_id {kind}, n_sentences long, n_removed long, text string"))
