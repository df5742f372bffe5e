"""Alignment of two tokenizers against a comparison of all token pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from feedstack.llm import token_align as T
from tokenizers import Tokenizer

A_FILE, B_FILE = f"{T.TOKENIZERS}/{T.BYTE_BPE}", f"{T.TOKENIZERS}/{T.PIECE_BPE}"


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def _bytes(models):
    a, b = models
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    return (lambda i: bytes(letters[c] for c in a.id_to_token(i)),
            lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def _tokens(models, text):
    a, b = models
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of = _bytes(models)
    raw = (" " + text).encode()
    return ids if text and all(b"".join(map(f, x)) == raw for f, x in zip(of, ids, strict=True)) else ([], [])


def brute(models, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), and the counts of all id pairs."""
    of, rows, count = _bytes(models), [], Counter()
    for text in texts:
        ids = _tokens(models, text or "")
        spans = []
        for f, x in zip(of, ids, strict=True):
            ends = np.cumsum([len(f(i)) for i in x]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, (_, e) in zip(x, s, strict=True) if low < e <= high)
                           for x, s in zip(ids, spans, strict=True)) for low, high in zip([0, *common], common, strict=False)]
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0], strict=True)
                 for y, (u, v) in zip(ids[1], spans[1], strict=True) if s < v and u < e]
        count.update(links)
        rows.append((len(ids[0]), len(ids[1]), groups, links))
    best = {}
    for (_, y), c in count.items():
        best[y] = max(best.get(y, 0), c)
    return [(a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, x in rows], count, best


def _texts():
    rnd = random.Random(5)
    words = ["the", "Straße", "naïve", "日本語", "x" * 40, "3.1415", "<|endoftext|>", "</s>", "<s>", "<0x41>", "é", "😀",
             "internationalisation", "don't", "\t", "\n\n", "a b", "　", "ﬁ", "\x00", "Ünïcödé", "foo_bar(baz)"]
    return ["", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "x▁y", "▁", "▁ a", "word", *[
        rnd.choice([" ", "  ", " ", " "]).join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(60)]]


def test_equals_all_pairs(spark, models):
    texts = _texts()
    want, count, best = brute(models, texts)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    rows, pairs = T.align(docs)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows.collect()}
    assert got == dict(enumerate(want))
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (c, c == best[p[1]]) for p, c in count.items()}


def test_without_broadcast_repeated_rows_and_null_ids(spark, models):
    texts = ["the same text twice", "the same text twice", "another one", None]
    want, _, _ = brute(models, texts)
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, None)], "doc_id long, text string")
    rows, _ = T.align(docs, broadcast_pairs=0)
    got = sorted([(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows.collect()])
    assert got == sorted(want)


def test_empty_table(spark):
    rows, pairs = T.align(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0 and pairs.count() == 0


def test_a_long_text(spark):
    text = "many words and inter-nationalisation 123456 " * 20_000
    r = T.align(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert r.n_links == r.n_a + r.n_b - r.n_groups > 100_000


def test_walk_on_random_ends():
    rng = np.random.default_rng(6)
    for size in (1, 2, 9, 500, 5000):
        ends = [np.sort(np.r_[rng.choice(np.arange(1, 4 * size), min(size, 4 * size - 1), replace=False), 4 * size]) for _ in "ab"]
        if size == 500:
            ends[1] = ends[0].copy()
        stretches, irregular = T.walk(*ends)
        groups = [((i + x, i + x + 1), (j + x, j + x + 1)) for i, j, n in stretches.tolist() for x in range(n)]
        groups = sorted(groups + [((w, x), (y, z)) for w, x, y, z in irregular.tolist()])
        common = np.intersect1d(*ends)
        at = [np.searchsorted(e, common) + 1 for e in ends]
        assert groups == list(zip(*[zip([0, *x.tolist()], x.tolist(), strict=False) for x in at], strict=True))


def test_ranks_equal_the_tokenizer_file(models):
    """The vocabulary as ranks, and remembered words, give the ids of the libraries on whole texts."""
    texts = [t for t in _texts() if t]
    a, b = T.ByteBpe(A_FILE), T.PieceBpe(B_FILE)
    assert a.ordered and b.by_words
    assert [x.tolist() for x in a.encode(texts)] == [models[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    for t, x in zip(texts, b.encode(texts), strict=True):
        assert x is None or x.tolist() == models[1].encode(t)
