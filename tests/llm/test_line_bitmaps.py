"""Line dedup against a plain count over lines, its keep bitmaps, and a key that holds most rows."""

import random

from feedstack.llm import line_bitmaps as L

WHITE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least_docs, keep_first, least_chars=1):
    """{(doc_id, text): (n_lines, n_dropped, kept text)}; equal rows are one document."""
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    holders = {}
    for r in order:
        for k in {_key(x) for x in r[1].split("\n")}:
            holders.setdefault(k, []).append(r)
    out = {}
    for r in order:
        lines, kept, seen = r[1].split("\n"), [], set()
        for x in lines:
            k = _key(x)
            first = keep_first and holders[k][0] == r and k not in seen
            seen.add(k)
            if len(k) < least_chars or len(holders[k]) < least_docs or first:
                kept.append(x)
        out[r] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def _run(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_lines_in int")
    done = L.apply(docs, L.keep_bitmaps(docs, **how)).collect()
    return [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done]


def _expected(rows, **how):
    found = brute(rows, **how)
    return [(d, found[(d, t or "")][2], *found[(d, t or "")][:2]) for d, t in rows]


ROWS = [(i, "\n".join(random.Random(i).choice(["Alpha ", " alpha", "BETA", "ß", "É", "é", "", "  ", "own %d" % i, "gamma\r"])
                      for _ in range(i % 9 + 1))) for i in range(60)]


def test_all_lines_of_common_keys_go(spark):
    rows = [*ROWS, (100, None), (101, ""), (102, "\n"), (None, "alpha\nno id"), (100, "alpha\nsame id"), ROWS[7], ROWS[7]]
    for least in (2, 10, 30):
        got = _run(spark, rows, least_docs=least, keep_first=False)
        assert sorted(got, key=str) == sorted(_expected(rows, least_docs=least, keep_first=False), key=str)


def test_first_occurrences_stay(spark):
    rows = [(i, t) for i, t in enumerate({t for _, t in ROWS})]
    for least in (2, 1):
        got = _run(spark, rows, least_docs=least, keep_first=True)
        assert sorted(got) == sorted(_expected(rows, least_docs=least, keep_first=True))
    keys = [_key(x) for _, t, n, d in got if n != d for x in t.split("\n") if _key(x)]
    assert len(keys) == len(set(keys))


def test_shorter_keys_stay(spark):
    got = _run(spark, ROWS, least_docs=2, keep_first=False, least_chars=3)
    assert sorted(got) == sorted(_expected(ROWS, least_docs=2, keep_first=False, least_chars=3))


def test_a_key_that_holds_most_rows_is_dealt_over_partitions(spark):
    rows = [(i, f"hot line\nown {i}\n{'HOT line' if i % 2 else 'x%d' % i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for first in (False, True):
        out = L.apply(docs, L.keep_bitmaps(docs, 10, first)).collect()
        want = brute(rows, 10, first)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out} == {d: want[(d, t)] for d, t in rows}


def test_bitmaps_are_bounds_of_dropped_runs(spark):
    docs = spark.createDataFrame([(1, "a\nb\nx\na\nb"), (2, "b\na\ny"), (3, "z")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.bounds) for r in L.keep_bitmaps(docs, 2, False).collect()}
    assert got == {1: (5, 4, [0, 2, 3, 5]), 2: (3, 2, [0, 2]), 3: (1, 0, [])}


def test_a_long_text_takes_linear_time(spark):
    text = "\n".join(["same"] * 200_000 + [f"l{i}" for i in range(100_000)])
    docs = spark.createDataFrame([(1, text), (2, "same\nother")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.apply(docs, L.keep_bitmaps(docs, 2, False)).collect()}
    assert got == {1: (300_000, 200_000), 2: (2, 1)}


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.apply(empty, L.keep_bitmaps(empty)).count() == 0
    docs = spark.createDataFrame([(1, "a", "u", 5), (2, "a", "v", 6)], "doc_id long, text string, lang string, bounds int")
    got = sorted(map(tuple, L.apply(docs, L.keep_bitmaps(docs, 2, False)).collect()))
    assert got == [(1, "", "u", 5, 1, 1), (2, "", "v", 6, 1, 1)]


def test_plan_has_no_python_worker(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = L.apply(docs, L.keep_bitmaps(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
