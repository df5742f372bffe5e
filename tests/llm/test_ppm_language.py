"""PPM language identification: exact code lengths, edge cases, held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from feedstack.llm import ppm_language as P

SAMPLE = {"aa": ["the cat sat on the mat", "the hat"], "bb": ["le chat est là", "la lettre et le lit"]}
ORDER = 2


def brute(texts, other, order=ORDER):
    """A direct PPM coder: escape to the next shorter context among the bytes not yet ruled out."""
    counts = defaultdict(Counter)
    kept = Counter()
    for own, group in ((True, texts), (False, other)):
        for t in group:
            data = b"\n" * order + t.encode()
            for i in range(len(data)):
                for k in range(min(order, i) + 1):
                    kept[data[i - k:i]] += 1
                    if own:
                        counts[data[i - k:i]][data[i]] += 1

    def p(context, byte):
        shorter = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        if not kept[context]:
            return shorter(byte)
        c = counts[context]
        total, kinds = sum(c.values()), len(c)
        if byte in c:
            return c[byte] / (total + kinds)
        rest = sum(shorter(b) for b in range(256) if b not in c)
        return (kinds / (total + kinds) if total else 1.0) * shorter(byte) / rest

    def bits(text):
        data = b"\n" * order + text.encode()
        return sum(-math.log2(p(data[i - order:i], data[i])) for i in range(order, len(data)))

    return bits


def trees():
    rows = Counter()
    names = sorted(SAMPLE)
    for lang, texts in SAMPLE.items():
        for t in texts:
            data = b"\n" * ORDER + t.encode()
            for k in range(1, ORDER + 2):
                for i in range(len(data) - k + 1):
                    rows[(names.index(lang), int.from_bytes(data[i:i + k], "big") << 3 | k)] += 1
    lang, gram, n = (np.array(x, np.int64) for x in zip(*((a, b, c) for (a, b), c in rows.items()), strict=True))
    return P.Trees(names, lang, gram, n, ORDER, least_seen=1)


def test_code_lengths_equal_a_direct_coder():
    t = trees()
    texts = ["the cat", "la là", "", "zzz €", "mat le"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0] + [len(x.encode()) for x in texts])
    got = t.code_lengths(np.frombuffer(data, np.uint8), bounds)
    for i, lang in enumerate(t.languages):
        bits = brute(SAMPLE[lang], SAMPLE["bb" if lang == "aa" else "aa"])
        assert np.allclose(got[:, i], [bits(x) for x in texts], rtol=1e-4), lang


def test_edge_cases(spark):
    rows = [(i, ("the of and to in " if i % 2 else "le la de et une ") * 5, "en" if i % 2 else "fr", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !?", "en", "x"), (None, "le la de", "fr", "x"),
             (103, "the of " * 30000, None, "x"), (103, "the of " * 30000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = P.identify(docs.repartition(3), P.fit(docs)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by_id[100].score == 0
    assert by_id[None].lang_pred == "fr" and by_id[103].lang_pred == "en"
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "fr") and 0 <= by_id[i].score <= 1 for i in range(60))
    none = docs.filter("lang = 'xx'")
    assert P.fit(none) is None and {r.lang_pred for r in P.identify(docs, None).collect()} == {"und"}
    assert P.identify(none, P.fit(docs)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trained = docs.select("doc_id", "text", "lang")
    rows = P.identify(docs, P.fit(trained)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_every_language_is_learned(spark):
    """70 languages, each with words and counts of its own; the last ones are the rarest."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}ro " for i in range(70)]
    rows = [(i * 100 + j, words[i] * 8, f"l{i:02}") for i in range(70) for j in range(12 if i < 64 else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = P.fit(docs.repartition(2))
    assert trees.languages == [f"l{i:02}" for i in range(70)]
    got = P.identify(docs, trees, ("doc_id", "lang")).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)


def test_a_rare_language_keeps_its_contexts():
    """The bound of contexts counts for each language: a large language leaves a small one its own."""
    grams = {"big": Counter(), "small": Counter()}
    for lang, text, times in (("big", "abcdefghijklmnopqrstuvwxyz" * 2, 1000), ("small", "zyxwvutsrqponmlkjihgfedcba" * 2, 3)):
        data = b"\n" * ORDER + text.encode()
        for k in range(1, ORDER + 2):
            for i in range(len(data) - k + 1):
                grams[lang][int.from_bytes(data[i:i + k], "big") << 3 | k] += times
    rows = [(i, g, n) for i, lang in enumerate(("big", "small")) for g, n in grams[lang].items()]
    lang, gram, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    text = np.frombuffer(b"zyxwvutsrq", np.uint8)
    bounds = np.array([0, len(text)])
    both = P.Trees(["big", "small"], lang, gram, n, ORDER, max_contexts=60).code_lengths(text, bounds)[0, 1]
    alone = P.Trees(["small"], lang[lang == 1] * 0, gram[lang == 1], n[lang == 1], ORDER, max_contexts=60).code_lengths(text, bounds)[0, 0]
    assert abs(both - alone) < 1e-6
