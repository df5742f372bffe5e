"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: for every context of up to ``order`` bytes, how often each byte
followed it in that language's training texts.  A byte is coded in the longest known context; a byte new to a context
costs an escape and is coded in the next shorter one, among the bytes that the longer context has not ruled out.  The
statistics are frozen, so the code length of a byte depends on its last ``order`` bytes only: training turns the trees
of each language into a table of code lengths (context x byte) and one of successor contexts, and a whole column of
texts is scored with a few table look-ups for each byte and language.

The sum of a text's code lengths is exact: the look-ups walk from the root through the last ``order`` bytes, which ends
in the longest known context, as in a tree with suffix links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import empty_as, text_runs

UNDECIDED = "und"
#: Longest context in bytes.
ORDER = 4
#: Bound of the training sample: so many documents of each language, those with the least hash of their id.
TRAIN_DOCS = 400
#: A context needs so many occurrences in its language's sample to be kept, and so many contexts of each language are kept
#: at most, by their frequency in it.
LEAST_SEEN = 3
MAX_CONTEXTS = 12000
#: Code-length differences count as if a text had at most so many bytes, so that a score says how clear a text is.
EVIDENCE_BYTES = 200


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _folded(column: pa.Array) -> pa.Array:
    """Texts in lower case."""
    return pc.utf8_lower(column)


def training_sample(docs: DataFrame, docs_per_language: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of the bounded training sample: rows with a known language, not held out, not empty.

    A first pass counts the languages; with these, only about one and a half times the wanted rows, by the hash of their
    id, are compared at all, so what is shuffled does not grow with the input."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), empty_as("text").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 1))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    key = F.xxhash64(F.col("doc_id").cast("string"))
    share = docs.sparkSession.createDataFrame(
        [(r.lang, min(1.0, (1.5 * docs_per_language + 20) / r.n)) for r in counts], "lang string, _share double")
    rows = rows.join(F.broadcast(share), "lang")  # a row for each language
    near = (F.length("text") > 0) & (F.shiftrightunsigned(key, 12) / F.lit(float(1 << 52)) < F.col("_share"))
    order = Window.partitionBy("lang").orderBy(key, "doc_id", "text")
    kept = (rows.filter(near).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= docs_per_language))
    return kept.select("lang", "text")


def count_contexts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): counts of all byte runs of 1 to ``order`` + 1 bytes of the sample; ``gram`` holds the run's
    bytes and its length as one number.  Texts are led in by ``order`` line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            for i, j, data, bounds in text_runs(_folded(batch.column(1))):
                for lang in dict.fromkeys(langs[i:j]):
                    own = [x for x in range(j - i) if langs[i + x] == lang]
                    gap = np.full(order, 10, np.uint8)
                    text = np.concatenate([x for r in own for x in (gap, data[bounds[r]:bounds[r + 1]])])
                    value = np.zeros(len(text), np.int64)
                    for k in range(1, order + 2):
                        value[k - 1:] = value[k - 1:] | (text[:len(text) - k + 1].astype(np.int64) << (8 * (k - 1)))
                        grams, n = np.unique((value[k - 1:] << 3) | k, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))],
                            names=["lang", "gram", "n"])

    return sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tree(gram: np.ndarray, n: np.ndarray, order: int, least_seen: int, max_contexts: int) -> tuple:
    """The frozen tables of one language: ``symbol`` byte -> symbol (0: never seen in training); ``follow``
    [context, symbol] -> context, ``cost`` [context, symbol] in bits, both flat."""
    byte, context = (gram >> 3) & 255, ((gram >> 11) << 3) | ((gram & 7) - 1)
    seen = np.unique(byte[gram & 7 == 1]).tolist()
    symbol = np.zeros(256, np.uint8 if len(seen) < 256 else np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    known, place = np.unique(context, return_inverse=True)
    total = np.bincount(place, n)
    size = known & 7
    # By frequency; a context is kept only with its suffix, which is at least as frequent.
    ranked = np.lexsort((known, size, -total, size > 0))
    ranked = ranked[(total[ranked] >= least_seen) | (size[ranked] == 0)][:max_contexts]
    kept: dict[bytes, int] = {}
    row = np.full(len(known), -1)
    for i in ranked.tolist():
        c = int(known[i] >> 3).to_bytes(8, "big")[8 - int(size[i]):]
        if not c or c[1:] in kept:
            row[i] = kept[c] = len(kept)
    table = np.zeros((max(len(kept), 1), width), np.float32)
    kept = kept or {b"": 0}
    used = row[place] >= 0
    table[row[place][used], symbol[byte[used]]] = n[used]
    # Symbol 0 stands for all bytes never seen: it has the weight of that many bytes.
    weight = np.ones(width)
    weight[0] = max(256 - len(seen), 1)
    p = np.zeros_like(table)
    uniform = np.full(width, 1 / 256)
    follow = np.zeros((len(kept), width), np.int32)
    for c, at in sorted(kept.items(), key=lambda x: len(x[0])):
        shorter = uniform if not c else p[kept[c[1:]]]
        own = table[at].astype(np.float64)
        known = own > 0
        kinds, count = known.sum(), own.sum()
        escape = kinds / (count + kinds) if count > 0 else 1.0
        rest = (shorter * weight * ~known).sum()
        p[at] = np.where(known, own / max(count + kinds, 1), escape * shorter / max(rest, 1e-300))
        for b in seen:
            longer = (c + bytes([b]))[-order:] if order else b""
            while longer not in kept:
                longer = longer[1:]
            follow[at, symbol[b]] = kept[longer]
    return symbol, follow.reshape(-1) * np.int32(width), -np.log2(np.maximum(p, np.float32(1e-30))).reshape(-1)


class Trees:
    """The frozen tables: ``languages``, and for each its own ``symbol``, ``follow`` and ``cost`` (see ``_tree``)."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER,
                 least_seen: int = LEAST_SEEN, max_contexts: int = MAX_CONTEXTS):
        """``lang`` (a place in ``languages``), ``gram`` and ``n``: the rows of ``count_contexts``."""
        self.order, self.languages = order, languages
        by_lang = np.argsort(lang, kind="stable")
        edge = np.searchsorted(lang[by_lang], np.arange(len(languages) + 1))
        self.trees = [_tree(gram[own], n[own], order, least_seen, max_contexts)
                      for own in (by_lang[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))]

    def tables(self) -> tuple:
        """The tables as plain values, to send to the tasks."""
        return self.order, self.languages, self.trees

    @classmethod
    def of(cls, tables: tuple) -> Trees:
        """Trees of the values of ``tables``."""
        t = cls.__new__(cls)
        t.order, t.languages, t.trees = tables
        return t

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of every row in every language."""
        rows, order = len(bounds) - 1, self.order
        size = np.diff(bounds)
        lead = np.arange(rows, dtype=np.int64) * order
        spot = np.arange(len(data)) + np.repeat(lead + order, size)
        out = np.zeros((rows, len(self.languages)))
        full = np.flatnonzero(size)
        for i, (symbol, follow, cost) in enumerate(self.trees if len(full) else ()):
            text = np.full(len(data) + rows * order, symbol[10], np.int32)
            text[spot] = symbol[data]
            state = np.zeros(len(text), np.int32)
            for back in range(order, 0, -1):
                state[order:] = follow[state[order:] + text[order - back:len(text) - back]]
            out[full, i] = np.add.reduceat(cost[state[spot] + text[spot]].astype(np.float64), bounds[:-1][full])
        return out


def fit(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, order: int = ORDER) -> Trees | None:
    """Train on ``docs`` (doc_id, text, lang).  The counts that reach the driver are bounded by the sample.  None where
    no row can be learned from."""
    # A long gram seen once or twice adds a leaf that an escape covers almost as well; the shortest ones are all kept.
    found = count_contexts(training_sample(docs, docs_per_language), order).filter("n > 2 or gram % 8 <= 2").toArrow()
    gram, n = (found.column(c).to_numpy() for c in ("gram", "n"))
    names = found.column("lang").combine_chunks().dictionary_encode()
    languages, lang = names.dictionary.to_pylist(), names.indices.to_numpy()
    if not languages:
        return None
    by_name = np.argsort(np.array(languages, object))
    rank = np.empty(len(languages), np.int64)
    rank[by_name] = np.arange(len(languages))
    return Trees(sorted(languages), rank[lang], gram, n, order)


def identify(docs: DataFrame, trees: Trees | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (text and the columns to ``keep``): these columns, ``lang_pred, score, bits_per_byte``.

    ``lang_pred`` is the language with the least code length of the whole text (ties: the first by name); ``score`` is
    its share of the likelihoods, with the evidence of a long text counted as that of EVIDENCE_BYTES bytes.  A null
    text, or one without a letter, gets ``und`` and score 0; so does every text if nothing was learned.  A null doc_id
    stays null; repeated rows stay; kept columns with the name of a new one are replaced."""
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    kept = docs.select(*[c for c in keep if c not in added.names])
    if trees is None:
        return kept.select("*", F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits_per_byte"))
    letter = empty_as("text").rlike(r"\p{L}")
    rows = docs.select(empty_as("text").alias("_text"), letter.alias("_letter"), *kept.columns)
    model = docs.sparkSession.sparkContext.broadcast(trees.tables())  # MAX_CONTEXTS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trees.of(model.value)
        names = np.array([*t.languages, UNDECIDED], object)
        for batch in batches:
            for i, j, data, bounds in text_runs(_folded(batch.column(0))):
                bits = t.code_lengths(data, bounds)
                size = np.maximum(np.diff(bounds), 1)
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                gap = (bits - least[:, None]) * np.minimum(1.0, EVIDENCE_BYTES / size)[:, None]
                score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
                known = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                best[~known] = len(t.languages)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[2:], pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)),
                     pa.array(np.where(known, least / size, np.nan), from_pandas=True)],
                    names=[*batch.schema.names[2:], *added.names])

    return rows.mapInArrow(run, T.StructType(kept.schema.fields + added.fields))
