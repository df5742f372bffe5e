"""Multi-index hashing against brute force."""

import random

import pytest

from feedstack.llm import multi_index as M


def brute(codes, queries, k):
    out = []
    for q, c in set(queries):
        near = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in set(codes) if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("n", "k"), [(3, 10), (400, 5)])
def test_exact(spark, n, k):
    rnd = random.Random(n)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    codes = []
    for i in range(n):
        c = rnd.choice(centres)
        for _ in range(rnd.choice((0, 0, 1, 3, 8))):
            c ^= 1 << rnd.randrange(64)
        codes.append((i, c - (1 << 64) if c >= 1 << 63 else c))
    codes += codes[:3]  # repeated rows
    rows = spark.createDataFrame([(*c, "x") for c in codes] + [(None, 5, "x"), (9999, None, "x")], "id long, code long, rank string")
    asked = rows.filter("id % 10 = 0 or id is null")
    got = M.search(rows.repartition(3), asked, k)
    assert got.columns == ["query_id", "rank", "neighbor_id", "distance"]
    assert sorted(map(tuple, got.collect())) == brute(codes, [c for c in codes if c[0] % 10 == 0], k)


def test_encode_and_empty(spark):
    vectors = spark.createDataFrame([(1, [1.0, -1.0, 2.0]), (2, None), (None, [1.0]), (3, []), (4, [float("nan"), None, 1.0]),
                                     (5, [0.5] * 80), (5, [0.5] * 80)], "vec_id long, embedding array<float>")
    got = M.encode(vectors).collect()
    assert sorted((r.id, r.code) for r in got)[:3] == [(1, 5), (3, 0), (4, 4)] and len(got) == 5
    none = M.encode(vectors.filter("vec_id > 99"))
    assert M.search(none, none).count() == 0 and M.search(M.encode(vectors), none).count() == 0
