"""Ranked lexical search with range-maximum sparse tables on posting lists.

The score of a document is the sum of its terms' integer impacts.  A posting list holds the impacts of one term by document
number, and a sparse table answers the largest impact, and its place, in any range of the list.  Best first, an interval of
document numbers is taken off a query's queue.  Its bound is the sum of the range maxima of the query's terms.  It is
split at the document of the greatest single impact, which is scored exactly; what lies left and right of it goes back with
bounds of its own.  A query ends when no interval's bound reaches its k-th score.

Spark deals the work: texts are read once into a written table of compact rows (the query terms of each document).  Every
task takes such rows in groups of about ``GROUP`` postings, builds the lists and tables of a group, searches it for all
queries, and carries only the k best documents of each query, which also bound the next group's search.  What a task
holds is bounded by the group, the query terms and k documents a query, whatever the input.  Query terms go to the tasks
in passes of at most ``PASS_TERMS`` (item, term) rows; more of them take more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, empty_as, list_column, written

#: Postings of one group of documents.
GROUP = 1 << 20
#: (item, term) rows of one pass.
PASS_TERMS = 200_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Intervals of a query that are split at once.
WIDEST = 64
_NO_ID = (1 << 63) - 1
#: A-Z to a-z; other ASCII characters but digits and a-z to a space.  Bytes above 127 belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """The terms of a text (UTF-8) with their occurrences."""
    raw, out, at = (text or "").encode().translate(_FOLD), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term: binary), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(term_counts(t)) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)),
                                              pa.array([t for x in found for t in x], pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", empty_as("text").alias("text")).mapInArrow(
        run, f"item_id {kind}, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with at least one term: ``doc_id``, ``n`` (its terms with repeats), and of the terms in ``vocabulary``
    their numbers (``terms``) and occurrences (``tfs``)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value.get
        for batch in batches:
            kept, n, terms, tfs, sizes = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                counts = term_counts(text)
                if not counts:
                    continue
                kept.append(i)
                n.append(counts.total())
                known = [(t, c) for t, c in zip(map(number, counts), counts.values(), strict=True) if t is not None]
                sizes.append(len(known))
                terms += [t for t, _ in known]
                tfs += [c for _, c in known]
            if kept:
                sizes = np.array(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(kept)), pa.array(n, pa.int64()),
                     list_column(np.array(terms, np.int32), sizes, pa.int32()), list_column(np.array(tfs, np.int64), sizes, pa.int64())],
                    names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_as("text").alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<bigint>")


class Lists:
    """Posting lists of a group of documents with a sparse table over all of them."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.argsort(term.astype(np.int64) * n_docs + doc, kind="stable")
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        term = term[order].astype(np.int64)
        self.key = term * n_docs + self.doc
        self.terms, self.first = np.unique(term, return_index=True)
        self.end = np.r_[self.first[1:], len(term)]
        longest = int((self.end - self.first).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for x in range(1, longest.bit_length()):
            self.log[1 << x:] = x
        # level x holds the place of the largest impact (the first of them) among 2^x postings; an impact is looked up by it
        level = np.arange(len(term), dtype=np.int32)
        self.table = [level]
        for x in range(1, longest.bit_length()):
            half = 1 << (x - 1)
            left, right = level[:-half], level[half:]
            level = np.concatenate([np.where(self.impact[left] >= self.impact[right], left, right), level[len(level) - half:]])
            self.table.append(level)
        self.table = np.stack(self.table)

    def most(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact in each range [a, b) of places, and its place; 0 where the range is empty."""
        some = b > a
        level = self.log[np.where(some, b - a, 1)]
        a = np.where(some, a, 0)
        left = self.table[level, a]
        right = self.table[level, np.where(some, b - (1 << level), 0)]
        x, y = self.impact[left], self.impact[right]
        return np.where(some, np.maximum(x, y), 0), np.where(x >= y, left, right)

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the documents that may be among the k best: all with a positive score of at least
        ``least`` that k others of this group do not exceed."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = self.terms[at] * self.n_docs
        a, b = self.first[at][None, :], self.end[at][None, :]
        best, place = self.most(a, b)
        bound, split = best.sum(axis=1), place[np.arange(1), best.argmax(axis=1)]
        none = np.zeros(0, np.int64)
        docs, scores, found, width, least = [none], [none], none, 4, max(1, least)
        while True:
            open_ = bound >= least
            if not open_.all():
                a, b, bound, split = a[open_], b[open_], bound[open_], split[open_]
            if not len(bound):
                break
            if len(bound) > width:
                order = np.argpartition(-bound, width - 1)
                now, later = order[:width], order[width:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            width = min(WIDEST, width * 2)
            doc = self.doc[split[now]]
            p = np.searchsorted(self.key, base[None, :] + doc[:, None])
            hit = self.key[np.minimum(p, len(self.key) - 1)] == base[None, :] + doc[:, None]
            score = np.where(hit, self.impact[np.minimum(p, len(self.key) - 1)], 0).sum(axis=1)
            docs.append(doc)
            scores.append(score)
            found = np.r_[found, score]
            if len(found) >= k:
                found = np.partition(found, len(found) - k)[-k:]
                least = max(least, int(found.min()))
            new_a, new_b = np.concatenate([a[now], p + hit]), np.concatenate([p, b[now]])
            best, place = self.most(new_a, new_b)
            a, b = np.concatenate([a[later], new_a]), np.concatenate([b[later], new_b])
            bound = np.r_[bound[later], best.sum(axis=1)]
            split = np.r_[split[later], place[np.arange(len(place)), best.argmax(axis=1)]]
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= least
        return docs[good], scores[good]


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, id) pairs: highest score first, then the smallest id."""
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _searched(table: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int,
              group: int) -> DataFrame:
    """(item, doc_id, score): of every task the k best documents of each query."""
    shipped = table.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shipped.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]

        def search(rows: list[pa.RecordBatch]) -> None:
            part = pa.Table.from_batches(rows).combine_chunks()
            ids = part.column("doc_id").fill_null(_NO_ID).to_numpy()
            n = part.column("n").to_numpy()
            # documents of one length and equal copies stand together, which keeps the bounds of intervals low
            order = np.lexsort((ids, n))
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            sizes = part.column("terms").combine_chunks().value_lengths().to_numpy()
            term, tf = (part.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes)))
            some = impact > 0
            if not some.any():
                return
            lists = Lists(term[some], np.repeat(number, sizes)[some], impact[some], len(order))
            ids = ids[order]
            for q, terms in enumerate(queries):
                docs, scores = lists.search(terms, k, best[q][-1][0] if len(best[q]) == k else 1)
                if len(docs):
                    best[q] = _best(best[q] + list(zip(scores.tolist(), ids[docs].tolist(), strict=True)), k)

        rows, size = [], 0
        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:  # a batch is cut where a group is full; a document is never cut
                room = int(np.searchsorted(np.cumsum(sizes[at:]), group - size, side="right"))
                end = min(batch.num_rows, at + max(room, 0 if rows else 1))
                rows.append(batch.slice(at, end - at))
                size += int(sizes[at:end].sum())
                at = end
                if at < batch.num_rows:
                    search(rows)
                    rows, size = [], 0
        if rows:
            search(rows)
        item = np.repeat(np.arange(len(best)), [len(x) for x in best])
        flat = [x for b in best for x in b]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([d for _, d in flat], pa.int64()),
                                          pa.array([s for s, _ in flat], pa.int64())], names=["item", "doc_id", "score"])

    return table.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, group: int = GROUP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each row of ``items`` (item_id,
    text): ``item_id, rank, doc_id, score``, equal scores by ascending doc_id.

    Terms are maximal runs of ASCII letters, digits and characters above U+007F, only A-Z lower-cased.  With N documents that
    hold a term, L terms in all, n terms in a document, df documents of a term and tf occurrences: w = floor(1000 *
    ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, score = sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the
    distinct terms of the item.  All of it is counted over all documents and whole texts.

    A null or empty text has no term: such a document is not counted or found, such an item finds nothing.  A null doc_id
    comes last among equal scores.  Repeated rows are documents of their own.  Rows of one item_id (null is one) make one
    item with the terms of all.  Very long texts are cut into terms piece by piece.  Other columns are ignored.  Empty tables
    give an empty result."""
    spark = docs.sparkSession
    terms = written(query_terms(items), "query-terms")
    passes = max(1, math.ceil(terms.count() / pass_terms))
    dealt = terms.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    results = []
    for p in range(passes):
        rows = dealt.filter(F.col("pass") == p).select("item_id", "term").toArrow()
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(rows.column("term").to_pylist()))}
        members: dict = {}
        for item, term in zip(rows.column("item_id").to_pylist(), rows.column("term").to_pylist(), strict=True):
            members.setdefault(item, []).append(vocabulary[term])
        if not members:
            continue
        table = written(postings(docs, vocabulary), "postings")
        total = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        df = table.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        held = dict(zip(df.column("t").to_pylist(), df.column("count").to_pylist(), strict=True))
        weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * held[i] + 1))) if i in held else 0
                            for i in range(len(vocabulary))], np.int64)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(members)],
                                      f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _searched(table, [np.sort(np.array(x)) for x in members.values()], weights, total.n, total.l or 1, k, group)
        part = F.spark_partition_id() % 64  # few rows of many tasks meet before all meet
        for by in (["item", "part"], ["item"]):
            order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id")
            found = found.withColumn("part", part).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = written(found.join(F.broadcast(names), "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"),
            F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score"), "best")
        discard(table)
        results.append(best)
    discard(terms)
    if not results:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, "
                                         "doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
