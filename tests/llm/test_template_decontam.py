"""Benchmark decontamination: planted exact, re-parameterised and inconsistent questions, and a brute-force version."""

import random
import re

from feedstack.llm import template_decontam as D

ITEM = ("A train leaves the old station at 40 km per hour while Anna walks along the river for 3 hours and then Anna "
        "returns to the station at 40 km per hour before night falls on the quiet town.")
SHORT = "Which metal is liquid here?"


def tables(spark):
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(500)]

    def prose(n):
        return " ".join("".join(chr(97 + int(c)) for c in rnd.choice(words)[1:]) for _ in range(n))

    docs = [(1, f"{prose(50)}. {ITEM} {prose(30)}"), (2, f"{prose(20)} {ITEM.upper()}"),
            (3, prose(9) + ". " + ITEM.replace("40", "65").replace("Anna", "Maria").replace("3 hours", "7 minutes")),
            (4, prose(9) + ". " + ITEM.replace("at 40 km", "at 65 km", 1).replace("Anna returns", "Boris returns")),
            (5, prose(300)), (6, ""), (7, None), (8, " ".join(ITEM.split()[:9])), (9, "x " * 30000 + ITEM), (None, ITEM),
            (10, f"so: {SHORT.lower()}"), (1, docs1 := "again " + ITEM), (1, docs1)]
    benchmark = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, prose(40)), (None, prose(30)), (6, "7 8 9")]
    return (spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, words string"),
            spark.createDataFrame([(i, t, 1) for i, t in benchmark], "item_id long, text string, doc_id int"))


def test_planted(spark):
    docs, benchmark = tables(spark)
    got = D.find(docs.repartition(3), benchmark).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}, key=str) == sorted(
        [(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (None, 1), (10, 2)], key=str)
    by_doc = {r.doc_id: r for r in got if r.doc_id != 1}
    # The slots of document 4 contradict each other, but two stretches of 14 and 15 words are verbatim.
    assert by_doc[4].words >= 13
    assert by_doc[9].changed == 0 and by_doc[3].changed >= 5 and by_doc[3].slots >= by_doc[3].changed
    kept = D.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8]


def test_passes_cover_a_larger_benchmark(spark, monkeypatch):
    docs, benchmark = tables(spark)
    want = sorted(map(str, D.find(docs, benchmark).collect()))
    monkeypatch.setattr(D, "PASS_WINDOWS", 20)
    assert sorted(map(str, D.find(docs, benchmark).collect())) == want


def test_empty(spark):
    docs, benchmark = tables(spark)
    assert D.find(docs.filter("doc_id > 99"), benchmark).count() == 0
    assert D.find(docs, benchmark.filter("item_id > 99")).count() == 0
    assert D.clean(docs, benchmark.filter("item_id > 99")).count() == docs.count()


def _find(spark, docs, items):
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"),
                 spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.words, r.slots, r.changed) for r in got}


def test_copies_of_items_full_of_slots_and_names(spark):
    sums = " ".join(f"{i} + {i + 7} = {2 * i + 7}." for i in range(1, 31))
    title = "The Quick Brown Fox Jumps Over The Lazy Dog Near The Old River Bank Every Day"
    long = "Box 5 " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(110)) + " holds 5 of the 5 keys"
    anna = "Anna has nine apples. Anna eats two apples. Then Anna has seven apples left. How many apples did Anna eat?"
    dense = "Take 5 plums and 5 pears and 5 figs and 5 dates and 5 nuts and 5 beans and 5 peas and 5 limes now"
    items = [(1, sums), (2, title), (3, long), (4, anna), (5, dense)]
    other = dense
    for i in range(8):
        other = other.replace(" 5 ", f" {11 + i} ", 1)
    docs = [(1, "see " + sums), (2, title.lower() + " ok"), (3, title.upper()), (4, long.replace("of the 5", "of the 7")),
            (5, "intro. " + anna.replace("Anna", "Boris")), (6, other), (7, dense.replace(" 5 ", " 9 ")), (8, anna.lower()),
            (9, "a b c " * 50)]
    got = _find(spark, docs, items)
    assert got.keys() == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (7, 5), (8, 4)}
    assert got[5, 4] == (20, 4, 4) and got[7, 5][2] == 8 and got[8, 4][2] == 0


def _template(text):
    """(literal, placeholder or None) of each word."""
    out, end = [], 0
    for m in re.finditer(r"(?:[0-9A-Za-z]|(?<=[0-9])[.,](?=[0-9]))+", text):
        w, low = m.group(), m.group().lower()
        start = not out or re.search(r"[.!?\n]", text[end:m.start()]) is not None
        if w[0].isdigit():
            kind = "number"
        elif out and out[-1][1] == "number" and low in D.UNITS:
            kind = "unit"
        else:
            kind = "name" if w[0].isupper() and len(w) > 1 and not w[1].isupper() and not (start and low in D.STARTERS) else None
        out.append((low, kind))
        end = m.end()
    return out


def _brute(doc, item):
    """(words, -changed, slots) of the best alignment, word by word."""
    d, q = _template(doc), _template(item)
    size, least, best = min(D.WINDOW, len(q)), min(D.RUN_WORDS, len(q)), None
    for shift in range(-len(q), len(d)) if q else ():
        matched, same = set(), set()
        for p in range(len(q) - size + 1):
            if p + shift < 0 or p + shift + size > len(d):
                continue
            x, y = q[p:p + size], d[p + shift:p + shift + size]
            words = set(range(p, p + size))
            if [w for w, _ in x] == [w for w, _ in y]:
                matched |= words
                same |= words
            elif [k or w for w, k in x] == [k or w for w, k in y] and 2 * sum(k is not None for _, k in x) <= size:
                matched |= words
        at = sorted(matched)
        # a slot is seen where a template window covers it
        slot = {p: (q[p][0], d[p + shift][0]) for s in range(len(q) - size + 1) if 0 <= s + shift <= len(d) - size
                and [k or w for w, k in q[s:s + size]] == [k or w for w, k in d[s + shift:s + shift + size]]
                and 2 * sum(k is not None for _, k in q[s:s + size]) <= size
                for p in range(s, s + size) if q[p][1]}
        found = [(len(same), 0, len(same & slot.keys()))] if len(same) >= least else []
        long = (0, 0, 0)
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                pairs = {slot[p] for p in at[i:j] if p in slot}
                if j - i > long[0] and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    inside = [slot[p] for p in at[i:j] if p in slot]
                    long = (j - i, -sum(a != b for a, b in inside), len(inside))
        if long[0] >= least and 2 * long[0] >= len(at):
            found.append(long)
        best = max([*found, *([best] if best else [])], default=None)
    return best


def test_equals_a_brute_force_version(spark):
    rnd = random.Random(5)
    words = ["red", "box", "the", "holds", "old", "cat", "runs", "far", "Then", "What"]
    names, numbers = ["Anna", "Boris", "Carl", "Dora"], ["4", "5", "6", "7.5", "1,000"]

    def some(n):
        out = []
        for _ in range(n):
            x = rnd.random()
            out.append(rnd.choice(words if x < 0.7 else names if x < 0.82 else numbers))
            if x > 0.94:
                out.append(rnd.choice(["km", "kg", "hours"]))
            if rnd.random() < 0.1:
                out[-1] += "."
        return out

    def changed(item):
        swap = {w: rnd.choice(names if w in names else numbers) for w in names + numbers}
        p = rnd.choice([0, 0, 0.1, 0.4])
        out = [swap.get(w, w) if rnd.random() >= p else w for w in item]
        if rnd.random() < 0.3:
            out[rnd.randrange(len(out))] = "other"
        return out

    items = [(i, some(rnd.choice([3, 5, 9, 16, 30]))) for i in range(25)]
    docs = []
    for i in range(90):
        own = changed(rnd.choice(items)[1])
        text = " ".join(some(rnd.randrange(6)) + own + some(rnd.randrange(6)))
        docs.append((i, rnd.choice([text, text, text, text.lower(), text.upper()])))
    items = [(i, " ".join(t)) for i, t in items]
    want = {(d, q): (b[0], b[2], -b[1]) for d, x in docs for q, y in items if (b := _brute(x, y)) is not None}
    assert len(want) > 40 and len({v[2] > 0 for v in want.values()}) == 2
    got = _find(spark, docs, items)
    assert got.keys() == want.keys()
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
