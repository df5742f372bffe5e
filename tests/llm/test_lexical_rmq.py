"""Range-maximum search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
from feedstack.llm import lexical_rmq as X

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in {i for i, _ in items}:
        query, scored = {t for i, x in items if i == item for t in _terms(x)}, []
        for d, c in counts:
            m, score = 50 + (50 * sum(c.values()) * n_docs) // n_terms, 0
            for t in query & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def _search(spark, docs, items, k, **how):
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in docs], "doc_id long, text string, n int, rank string")
    items = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double")
    return sorted(map(tuple, X.search(docs.repartition(3), items, k, **how).collect()), key=str)


def _corpus(n, seed):
    rnd = random.Random(seed)
    words = ["Ärger", "foo-bar", "x1", "the", "THE", "naïve", "don't", "日本 語"] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(rnd.choice(words[: rnd.randint(4, len(words))]) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


def test_equals_scoring_every_document(spark):
    docs = _corpus(400, 1)
    docs += [(1000 + i, docs[3][1]) for i in range(80)] + [(None, docs[5][1]), (5, docs[5][1]), (2000, None), (2001, ""), (2002, "--")]
    items = [(1, docs[3][1]), (2, "w1 w2 W3 the unknown"), (3, None), (4, "nowhere"), (5, "w5"), (5, "w6 w7"), (None, "ärger Ärger x1")]
    for k, group in ((50, 1 << 20), (7, 300), (1, 1)):
        assert _search(spark, docs, items, k, group=group) == brute(docs, items, k)


def test_more_terms_than_one_pass_holds(spark):
    docs, items = _corpus(120, 2), [(i, f"w{i} w{i + 1} the x1") for i in range(30)]
    assert _search(spark, docs, items, 10, pass_terms=25) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = _corpus(5, 3), [(1, "the")]
    assert _search(spark, [], items, 5) == [] and _search(spark, docs, [], 5) == []
    assert _search(spark, [(1, "the")], items, 5) == brute([(1, "the")], items, 5)


def test_range_maxima_and_few_visits():
    rng = np.random.default_rng(4)
    doc = np.concatenate([np.sort(rng.choice(2000, 900, replace=False)) for _ in range(5)])
    impact = rng.integers(1, 1000, len(doc))
    lists = X.Lists(np.repeat(np.arange(5), 900), doc, impact, 2000)
    a = rng.integers(0, 900, 300)
    b = a + rng.integers(0, 900 - a + 1)
    most, place = lists.most(a, b)
    for x, y, m, p in zip(a, b, most, place, strict=True):
        assert m == (lists.impact[x:y].max() if y > x else 0) and (y == x or lists.impact[p] == m)
    total = np.zeros(2000, np.int64)
    np.add.at(total, doc, impact)
    found, scores = lists.search(np.arange(5), 10, 1)
    assert sorted(scores)[-10:] == sorted(total)[-10:] and (total[found] == scores).all() and len(found) < 2000


def test_a_long_text_is_cut_at_terms(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 5)
    text = "Alpha beta,gamma  Straße " * 20 + "x"
    assert X.term_counts(text) == Counter(t.encode() for t in _terms(text))
