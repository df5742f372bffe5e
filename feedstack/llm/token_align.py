"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers A and B cut the same bytes.  Their tokens end at ascending byte offsets; where both end, a *group* of A
tokens and B tokens that cover the same bytes ends.  The walk over the two end arrays keeps the shift between the two
token indices:

1. Exponential probing compares the end arrays at that shift, 8, 16, 32, ... entries at a time, as memory; the lowest bit
   that differs in the last probe tells where a stretch of one-to-one groups ends, and the walk jumps there.
2. Where the ends differ, the group is resolved locally: the side that ends first moves on until both end together;
   the shift is updated and probing begins again.

Texts are worked on in runs of about 256 KB; both tokenizers give the same number of bytes for each text that is kept, so
the end of every text is a common end and one walk serves all texts of a run.  Overlapping tokens of a group are its
*links*: a stretch links each A token with one B token; an irregular group of x and y tokens has x + y - 1 links.

A written table holds the distinct links of each text with their numbers.  The corpus-wide count of an (A id, B id) pair is a
partial aggregate of it; its size is bounded by the pairs of ids that touch, not by the texts.  It is counted, and joined
by broadcast up to ``BROADCAST_PAIRS`` rows, beyond that by a shuffle whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_as, list_column, text_runs, written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Rows (three numbers) of the pair table up to which it is broadcast.
BROADCAST_PAIRS = 2_000_000
#: Distinct words whose ids a task remembers.
WORDS = 300_000
#: Entries of the first probe.
PROBE = 8
#: The pre-tokenization that byte-level BPE files name by ``use_regex``; fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE file.  Where its ids follow the order of its merges, the same vocabulary runs as ranks, which is
    several times faster; any other file runs as it is."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in text)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        ordered = (all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
                   and sorted(vocab[c] for c in letters) == list(range(256)) and spec["normalizer"] is None
                   and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.ordered = bool(ordered)
        if ordered:
            import tiktoken
            self.model = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, special_tokens={},
                                           mergeable_ranks={p: i for i, p in enumerate(self.pieces)})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of a space and each text; None where they do not give it back."""
        if self.ordered:  # ranks cut the bytes of a text and lose none
            return [self.model.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]
        out = []
        for t, e in zip(texts, self.model.encode_batch([" " + t for t in texts], add_special_tokens=False), strict=True):
            same = b"".join(map(self.pieces.__getitem__, e.ids)) == (" " + t).encode()
            out.append(np.array(e.ids, np.int64) if same else None)
        return out


class PieceBpe:
    """A sentence-piece BPE model, which puts a space before a text.  Where no piece holds a space after another
    character, no merge crosses such a place: the words between single spaces are then encoded on their own, and each
    distinct word once while it is remembered."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.by_words = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.by_words &= re.search("[^▁]▁", piece) is None
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

        self.known: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text as 32-bit numbers; None where they do not give back a space and the text."""
        piece = self.pieces.__getitem__
        return [array("i", x).tobytes() if b"".join(map(piece, x)) == (" " + t).encode() else None
                for t, x in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        # a space beside another one or at an end of the text may share a piece with it
        cut = [None if not self.by_words or "▁" in t or "  " in t or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        words = {w for ws in cut if ws is not None for w in ws}
        if len(self.known) + len(words) > WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self._ids(new), strict=True))
        whole = iter(self._ids([t for t, ws in zip(texts, cut, strict=True) if ws is None]))
        out, word = [], self.known.__getitem__
        for ws in cut:
            ids = [next(whole)] if ws is None else list(map(word, ws))
            out.append(None if None in ids else np.frombuffer(b"".join(ids), np.int32).astype(np.int64))
        return out


@lru_cache(maxsize=2)
def _load(byte_bpe: str, piece_bpe: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(byte_bpe), PieceBpe(piece_bpe)


def walk(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (first a, first b, length) of one-to-one groups and irregular groups (first a, end a, first b, end b) of
    two end arrays with the same last end, below 2^31."""
    raw_a, raw_b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
    at_a, at_b = memoryview(raw_a).cast("i"), memoryview(raw_b).cast("i")
    n, i, j, irregular = len(ends_a), 0, 0, []
    while i < n:
        step, x, y = 4 * PROBE, 4 * i, 4 * j
        while (here := raw_a[x:x + step]) == (there := raw_b[y:y + step]) and x < 4 * n:
            x += step
            y += step
            step *= 2
        if x >= 4 * n:
            break
        # the lowest bit that differs lies in the first entry that differs
        differ = int.from_bytes(here, "little") ^ int.from_bytes(there, "little")
        first_a = x // 4 + ((differ & -differ).bit_length() - 1) // 32
        j += first_a - i
        i, first_b = first_a, j
        end_a, end_b = at_a[i], at_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = at_a[i]
            else:
                j += 1
                end_b = at_b[j]
        i += 1
        j += 1
        irregular += (first_a, i, first_b, j)
    irregular = np.array(irregular, np.int64).reshape(-1, 4)
    # a stretch lies before each irregular group and after the last
    first_a, first_b = np.r_[0, irregular[:, 1]], np.r_[0, irregular[:, 3]]
    return np.stack([first_a, first_b, np.r_[irregular[:, 0], n] - first_a], axis=1), irregular


def _fill(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... ``count`` numbers of each, one after the other."""
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))


def _texts(pairs: dict[int, str], keys: np.ndarray, width: int) -> list[str]:
    """The text of each one-to-one group, from its key.  Both tokens are the same bytes, so there are few distinct."""
    try:
        return list(map(pairs.__getitem__, keys.tolist()))
    except KeyError:
        pairs.update((k, "%d|%d" % divmod(k, width)) for k in set(keys.tolist()) if k not in pairs)
        return list(map(pairs.__getitem__, keys.tolist()))


def _aligned(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, pairs: dict[int, str], width: int):
    """The groups as texts in order with the end of each, and the links' keys with an end inside each."""
    stretches, irregular = walk(ends_a, ends_b)
    one_a, one_b = _fill(stretches[:, 0], stretches[:, 2]), _fill(stretches[:, 1], stretches[:, 2])
    one_keys, one_ends = a[one_a] * width + b[one_b], ends_a[one_a]
    in_a = _fill(irregular[:, 0], irregular[:, 1] - irregular[:, 0])
    in_b = _fill(irregular[:, 2], irregular[:, 3] - irregular[:, 2])
    text_a, text_b = list(map(str, a[in_a].tolist())), list(map(str, b[in_b].tolist()))
    cut_a = np.cumsum(irregular[:, 1] - irregular[:, 0]).tolist()
    cut_b = np.cumsum(irregular[:, 3] - irregular[:, 2]).tolist()
    odd = [",".join(text_a[w:x]) + "|" + ",".join(text_b[y:z])
           for w, x, y, z in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b, strict=False)]
    straight, groups = _texts(pairs, one_keys, width), []
    cut = np.cumsum(stretches[:, 2]).tolist()
    for x, y, group in zip([0, *cut], cut, [*odd, None], strict=False):
        groups += straight[x:y]
        groups.append(group)
    groups.pop()
    ends = np.sort(np.r_[one_ends, ends_a[irregular[:, 1] - 1]])
    # links of irregular groups: for every end of either side inside them, the tokens that hold the byte before it
    inner = np.sort(np.r_[ends_a[in_a], ends_b[in_b]])
    inner = inner[np.r_[True, inner[1:] != inner[:-1]]] if len(inner) else inner
    odd_keys = (a[in_a][np.searchsorted(ends_a[in_a], inner)] * width
                + b[in_b][np.searchsorted(ends_b[in_b], inner)])
    return groups, ends, np.r_[one_keys, odd_keys], np.r_[one_ends, inner]


def tokenized(docs: DataFrame, byte_bpe: str, piece_bpe: str, by: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` (``by``, text): ``n_a, n_b, n_groups, n_links`` (long), ``groups`` (sha256 of the groups as
    ``a1,a2|b1;a3|b2,b3``, empty without tokens), and the distinct links: ``pairs`` (A id * 2^32 + B id) with ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_model, b_model = _load(byte_bpe, piece_bpe)
        len_a = np.array([len(x) for x in a_model.pieces], np.int64)
        len_b = np.array([len(x) for x in b_model.pieces], np.int64)
        width, pairs = len(len_b), {}
        for batch in batches:
            for first, end, _, _ in text_runs(batch.column(1)):
                texts = batch.column(1).slice(first, end - first).to_pylist()
                at = [i for i, t in enumerate(texts) if t]
                some = [texts[i] for i in at]
                found = [(i, x, y) for i, x, y in zip(at, a_model.encode(some), b_model.encode(some), strict=True)
                         if x is not None and y is not None]
                n = np.zeros((4, len(texts)), np.int64)
                digest = [""] * len(texts)
                row = key = times = np.zeros(0, np.int64)
                if found:
                    place = np.array([i for i, _, _ in found])
                    a, b = np.concatenate([x for _, x, _ in found]), np.concatenate([y for _, _, y in found])
                    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
                    n[0, place], n[1, place] = [len(x) for _, x, _ in found], [len(y) for _, _, y in found]
                    last = ends_a[np.cumsum(n[0, place]) - 1]
                    groups, ends, keys, inside = _aligned(a, b, ends_a, ends_b, pairs, width)
                    cut = [0, *np.searchsorted(ends, last, side="right").tolist()]
                    for p, x, y in zip(place.tolist(), cut, cut[1:], strict=False):
                        digest[p] = hashlib.sha256(";".join(groups[x:y]).encode()).hexdigest()
                    n[2, place] = np.diff(cut)
                    n[3] = n[0] + n[1] - n[2]
                    # one number for text and link, so that one sort brings equal ones together
                    span = len(len_a) * width
                    link = np.sort(np.searchsorted(last, inside) * span + keys)
                    new = np.flatnonzero(np.r_[True, link[1:] != link[:-1]])
                    times = np.diff(np.r_[new, len(link)])
                    row, key = np.divmod(link[new], span)
                    row, key = place[row], (key // width << 32) + key % width
                per_row = np.bincount(row, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *(pa.array(x) for x in n), pa.array(digest),
                     list_column(key, per_row, pa.int64()), list_column(times, per_row, pa.int64())],
                    names=[by, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = docs.schema[by].dataType.simpleString()
    return docs.select(F.col(by), empty_as("text").alias("text")).mapInArrow(
        run, f"`{by}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
             "pairs array<bigint>, times array<bigint>")


def align(docs: DataFrame, byte_bpe: str = f"{TOKENIZERS}/{BYTE_BPE}", piece_bpe: str = f"{TOKENIZERS}/{PIECE_BPE}",
          by: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Aligns every text of ``docs`` (``by``, text; other columns are ignored).  Returns two tables:

    - texts: ``by, n_a, n_b, n_groups, n_links, groups`` as in ``tokenized``, ``n_best`` (links whose count is the highest
      of their B id in all texts, ties included) and ``count_sum`` (of the counts of its links);
    - pairs: ``a, b, count, best``: how many links hold two ids linked, and whether that is the highest of ``b``.

    A is read by its space and the text, B by the text, before which it puts a space.  A text that is null, empty, or that a
    tokenizer does not give back byte by byte has no tokens: zeros and an empty digest.  Strings of special tokens are
    plain text.  Repeated rows and rows that share ``by`` (null too) are separate texts with a row each; all count.  A very
    long text is a run of its own.  An empty table gives empty results.  The tokenizer files are read by every task."""
    rows = written(tokenized(docs, byte_bpe, piece_bpe, by).withColumn("_row", F.monotonically_increasing_id()), "tokenized")
    link = F.explode(F.arrays_zip("pairs", "times"))
    counts = rows.select(link.alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = Window.partitionBy("b")
    pairs = written(counts.withColumn("b", b).withColumn("best", F.col("count") == F.max("count").over(best)), "pairs")
    known = pairs.select("pair", "count", "best")
    if pairs.count() <= broadcast_pairs:
        known = F.broadcast(known)
    sums = (rows.select("_row", link.alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
            .join(known, "pair").groupBy("_row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    texts = (rows.drop("pairs", "times").join(sums, "_row", "left")
             .select(by, "n_a", "n_b", "n_groups", "n_links", "groups",
                     *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]))
    return texts, pairs.select(F.shiftright("pair", 32).alias("a"), "b", "count", "best")
