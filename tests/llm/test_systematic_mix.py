"""Mixing to target weights: targets, copies, edge cases."""

import random

from feedstack.llm import systematic_mix as M


def levels(sizes):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def rows():
    rnd = random.Random(4)
    out = [(None, "no id", "b"), (1, None, "a"), (2, "", None), (3, " \t", "empty"), (4, "w " * 30000, "c")]
    for i in range(10, 1500):
        source = rnd.choice(["a", "a", "a", "a", "b", "c", "d", None, "", "é"])
        out.append((i, "word " * (7 if i % 3 == 0 else rnd.randrange(1, 400)), source))
    return out + [(20, "twin " * 9, "b")] * 3


def test_mix(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 7, "kept") for r in data], "doc_id long, text string, source string, size int, n string")
    mixed = M.mix(docs.repartition(7))
    assert mixed.columns == ["doc_id", "text", "source", "n", "size", "source_size", "target", "copies", "taken"]
    got = mixed.collect()
    assert len(got) == len(data)
    sizes, taken, target = {}, {}, {}
    for r in got:
        n = len((r.text or "").split())
        assert r.size == n and r.taken == r.copies * n and 0 <= r.copies <= 2 and r.n == "kept"
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = levels(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(want[s], 1), s
        if s != "c":  # one document of c holds a third of its words
            assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 400, s
    again = M.mix(docs.repartition(3)).select("doc_id", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed.select("doc_id", "size", "copies").collect()))
    assert M.emit(mixed).count() == sum(r.copies for r in got)


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    assert [r.copies for r in M.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()] == [0, 0]
