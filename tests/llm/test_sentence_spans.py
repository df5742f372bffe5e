"""Sentence-span dedup against a brute-force version."""

import random
import re

from feedstack.llm import sentence_spans as S
from feedstack.llm.hashing import mix, span_hashes

import numpy as np


def pieces(text):
    """Sentences as lists of (word, start, end)."""
    data = text.encode()
    out = []
    for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", data):
        new = not out or re.search(rb"[.!?\n]", data[out[-1][-1][2]:m.start()])
        if new:
            out.append([])
            n = 0
        elif n >= S.LONG:
            raw = np.frombuffer(last.lower(), np.uint8)
            if int(mix(span_hashes(raw, np.array([0]), np.array([len(raw)])))[0]) % S.CUT == 0:
                out.append([])
        last = m[0]
        n += 1
        out[-1].append((m[0].lower(), m.start(), m.end()))
    return data, out


def brute(rows):
    first, docs = {}, {}
    keyed = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for doc in keyed:
        data, sents = pieces(doc[1])
        docs[doc] = (data, sents, set())
        for i in range(len(sents)):
            j, words = i, []
            while j < len(sents) and (j - i < S.SENTENCES or len(words) < S.WORDS):
                words += [w for w, _, _ in sents[j]]
                j += 1
            if j - i < S.SENTENCES or len(words) < S.WORDS:
                continue
            if first.setdefault(tuple(words), (doc, i)) != (doc, i):
                docs[doc][2].update(range(i, j))
    out = []
    for d, t in rows:
        data, sents, gone = docs[(d, t or "")]
        if gone:
            edge = [s[0][1] for s in sents] + [len(data)]
            data = data[:edge[0]] + b"".join(data[edge[k]:edge[k + 1]] for k in range(len(sents)) if k not in gone)
        out.append((d, len(sents), len(gone), data.decode()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]

    def prose(n, stop=0.2):
        return " ".join(rnd.choice(words) + (rnd.choice(".!?\n") if rnd.random() < stop else "") for _ in range(n))

    shared, bare = prose(60), prose(80, 0)
    rows = [(1, None), (2, ""), (3, "..."), (4, "a. b. c."), (None, shared), (5, "x " * 3000)]
    for d in range(10, 60):
        text = prose(rnd.randrange(5, 200))
        if d % 3 == 0:
            text += " " + shared.upper() + " " + prose(20)
        if d % 4 == 0:
            text = prose(7) + " " + bare + " " + text
        if d % 10 == 0:
            text += "\n" + text
        rows.append((d, text))
    rows += [rows[10], rows[11], (70, rows[12][1])]
    df = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, marks string")
    got = S.dedup_spans(df.repartition(6))
    assert got.columns == ["doc_id", "n_sentences", "n_removed", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_bare_passage_is_caught_and_clean_text_left(spark):
    rnd = random.Random(9)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(d, f"{'lead ' * d}{d}a {d}b {passage} end of {d}.") for d in range(1, 5)] + [(9, "nothing. is repeated here. at all. " * 1)]
    got = {r.doc_id: r for r in S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[9].n_removed == 0 and got[9].text == rows[-1][1]
    assert all(got[d].n_removed > 0 and passage not in got[d].text for d in (2, 3, 4))
    assert S.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
