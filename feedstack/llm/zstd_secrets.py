"""Secret scan by dictionary-primed zstandard novelty.

Strings in a sensitive context, of a shape that words don't have, are candidates.  Each is measured by its marginal compressed bytes: how many more bytes its
surroundings take with it than without it, for a compressor primed with a dictionary of code vocabulary and of the corpus's
own most frequent identifiers.  Words, names and repeated text cost little after such a dictionary; keys and passwords cannot
be compressed and are reported.  Three base patterns (assignments, access keys, long hex) are always reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_as, rows_of

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words that an assignment holds, as a cheap test before the pattern.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate of the method: a string of SHORT characters or more whose shape is unlike a word's.
SHORT, LONG = 8, 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_=~-]{8,}")
#: The parts of a candidate between its equals signs (those at its end are padding): what stands before counts as context.
PIECE = re.compile(r"[A-Za-z0-9+/_~-]{8,}(?:=+\Z)?")
#: Shapes: a change of class (digit, lower, upper), a lower-case letter before a capital, letters that no word has in a row.
_CHANGE = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
_RISE = re.compile(r"[a-z][A-Z]")
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{6}", re.I)
_DIGIT = re.compile(r"[0-9]")
#: Changes of class in a short candidate, and rises in a long one without digits, from which on it is measured.
CHANGES, RISES = 4, 4
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|"
                       r"client.?id|\bkey\b|\bpwd\b|\bsalt\b|session|cookie", re.I)
#: Code points around a candidate that count as its context, and its surroundings for the compressor.
CONTEXT, AROUND = 48, 160
#: Marginal compressed bytes for each byte of a candidate from which on it is reported.
NOVELTY = 0.62
#: Identifiers of the corpus in the dictionary, and a dictionary's bytes.
IDENTIFIERS, DICTIONARY_BYTES = 6000, 60_000
_IDENTIFIER = re.compile(r"[A-Za-z_]{3,32}")
#: A task gives its counts on when it has so many words.
FLUSH = 300_000
CODE_WORDS = ("password secret token api_key apikey access_key private_key client_secret credential authorization bearer "
              "import from return class function public static void string const let var def self this new null none true "
              "false if else for while try except catch finally raise throw http https www com org net json config setting "
              "default value name type id user username email host port path file data index count size length list map "
              "key session cookie request response header content version service account example test sample changeme "
              "placeholder your_token_here xxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ").split()


def identifier_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the identifiers of all texts: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            items = [(w, n) for w, n in seen.items() if _IDENTIFIER.fullmatch(w)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in items], pa.string()),
                                               pa.array([n for _, n in items], pa.int64())], names=["word", "n"])

        for (text,) in rows_of(batches, "text"):
            seen.update(text.split())
            if len(seen) > FLUSH:
                yield out()
        yield out()

    return (docs.select(empty_as("text").alias("text")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def dictionary(docs: DataFrame, identifiers: int = IDENTIFIERS) -> bytes:
    """The compressor's dictionary: code vocabulary and the corpus's most frequent identifiers, the most frequent last,
    where matches are cheapest."""
    top = identifier_counts(docs).orderBy(F.col("n").desc(), "word").limit(identifiers).collect()
    words = [r.word for r in top][::-1] + CODE_WORDS
    return " ".join(words).encode()[-DICTIONARY_BYTES:]


class Novelty:
    """Marginal compressed bytes against a dictionary."""

    def __init__(self, prime: bytes):
        primed = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False,
                                                    write_checksum=False, write_dict_id=False)

    def __call__(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds, for each byte of it; 0 at least."""
        b, c, a = before.encode(), candidate.encode(), after.encode()
        # Literals are only entropy-coded when a frame has enough of them; both frames get the same surroundings.
        more = len(self._compressor.compress(b + c + a)) - len(self._compressor.compress(b + a))
        return max(more, 0) / max(len(c), 1)


def unlike_words(c: str) -> bool:
    """Whether a candidate's shape lets it be a key: a long one has a digit beside other characters, capitals inside it or
    consonants in a row as words don't; a short one has a digit and several changes between digits, capitals and others."""
    if c.isdigit():
        return False
    if _DIGIT.search(c):
        return len(c) >= LONG or sum(1 for _ in _CHANGE.finditer(c)) >= CHANGES
    return len(c) >= LONG and (sum(1 for _ in _RISE.finditer(c)) >= RISES or _CONSONANTS.search(c) is not None)


def scan(text: str, novelty: Novelty) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, novelty) of a text's secrets by start, then kind."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    out = [(k, a, b, novelty(text[max(0, a - AROUND):a], text[a:b], text[b:b + AROUND])) for k, a, b in found]
    taken = sorted((a, b) for _, a, b in found)
    place = 0
    for m in CANDIDATE.finditer(text) if SENSITIVE.search(text) else ():
        if len(m[0]) < LONG and not unlike_words(m[0]) and "=" not in m[0]:  # most words
            continue
        whole = m.span()
        while place < len(taken) and taken[place][1] <= whole[0]:
            place += 1
        near = list(takewhile(lambda s, end=whole[1]: s[0] < end, taken[max(0, place - 2):]))
        pieces = [x.span() for x in PIECE.finditer(text, *whole)]
        long = [x for x in pieces if x[1] - x[0] >= LONG]
        reported: list[tuple[int, int]] = []
        for a, b in dict.fromkeys([*long, whole, *pieces]):
            if any(s < b and a < e for s, e in reported):  # a part of it is reported, or a string that holds it
                continue
            c = text[a:b]
            if not unlike_words(c) or not SENSITIVE.search(text, max(0, a - CONTEXT), a):
                continue
            if any(s < b and a < e for s, e in near):
                continue
            n = novelty(text[max(0, a - AROUND):a], c, text[b:b + AROUND])
            if n >= NOVELTY:
                out.append(("novel", a, b, n))
                reported.append((a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"


def find(docs: DataFrame, prime: bytes | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, spans``: an array of (kind, start, end, novelty) by start, then kind
    (KINDS in order); code points, end exclusive.

    Base kinds are leftmost and non-overlapping within their kind, each with its check; ``novel`` spans overlap none of
    them.  ``prime``: the dictionary (default: made from all texts of ``docs``).  Null and empty texts have no spans; a
    null doc_id stays null, repeated rows stay, other columns are ignored, an empty table gives an empty result."""
    prime = dictionary(docs) if prime is None else prime
    shared = docs.sparkSession.sparkContext.broadcast(prime)  # at most DICTIONARY_BYTES
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shared.value)
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in scan(t.as_py(), novelty)]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], names=["doc_id", "spans"])

    return docs.select("doc_id", empty_as("text").alias("text")).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")
