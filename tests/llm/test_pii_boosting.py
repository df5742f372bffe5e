"""Personal data: base kinds against a brute-force version, proposals, redaction, native plan."""

import random
import re

from pyspark.sql import functions as F

from feedstack.llm import pii_boosting as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [None, "", "a@b.c_d@e.f.g @x.y q@r. é@ä.de mail é.x@y.z", "1.2.3.4.5 256.1.1.1 001.002.003.004 1.2.3 99999999999999999999.1.1.1",
         "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4 1  1", "+1 (212) 555-0100 +12 + 1 +123456789012345678 +1-2",
         "😀 x@y.zz 😀 10.0.0.1 😀 4111111111111111 😀 +49 30 1234567", "a.b@c.d,e@f.g;h@i.j" * 40, "1 " * 9000, "z" * 40000 + "@q.r",
         "9" * 30000, "1.1.1.1 " * 700, "<EMAIL> 10.1.1.1@a.b +1.1.1.1.1.1.1.1"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(digits) <= 15
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (4, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, email string, spans int")
    found = P.detect(docs)
    got = [(r.doc_id, [(s.kind, s.start, s.end) for k in P.BASE for s in r[k]]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(((i, brute(t or "")) for i, t in rows), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert P.detect(docs.filter("doc_id > 99")).count() == 0


def test_proposals(spark):
    texts = [(1, "her SSN is 123-45-6789 on file"), (2, "write to jane [at] mail [dot] org now"), (3, "ISBN 978-3-16-148410-7 paperback"),
             (4, "call 212-555-0147 today"), (5, "invoice 20240117001 is due"), (6, "IBAN DE89 3704 0044 0532 0130 00 bank"),
             (7, "we met at home. it was in version 10.2.33.2000")]
    got = {r.doc_id: [(s.kind, s.match) for s in r.spans] for r in P.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == [("number", "123-45-6789")] and got[4] == [("number", "212-555-0147")]
    assert got[2] == [("address", "jane [at] mail [dot] org")] and got[6] == [("account", "DE89 3704 0044 0532 0130 00")]
    assert got[3] == got[5] == got[7] == []


def test_redaction(spark):
    texts = [(1, "mail a@b.cc or +1 212 555 0100!", 5), (2, None, None), (3, "clean text", 3), (4, "a@10.1.1.1 x", 9)]
    got = P.redact(spark.createDataFrame(texts, "doc_id long, text string, n_chars long"))
    assert got.columns == ["doc_id", "text", "n_chars"]
    assert sorted(map(tuple, got.collect())) == [
        (1, "mail <EMAIL> or <PHONE>!", 24), (2, None, None), (3, "clean text", 3), (4, "<EMAIL> x", 9)]


def _spans(rnd, kinds, count):
    """Random spans that don't overlap within their kind."""
    out = []
    for kind in kinds:
        at = rnd.randrange(9)
        for _ in range(count):
            end = at + rnd.choice((1, 2, 5, 30))
            out.append((kind, at, end, "m"))
            at = end + rnd.randrange(12)
    return out


def _meet(a, b):
    return a[1] < b[2] and b[1] < a[2]


def test_sweeps_equal_all_pairs(spark):
    rnd = random.Random(4)
    rows = []
    for i, n in enumerate((0, 1, 2, 3, 20, 300, 700)):
        base, proposed = _spans(rnd, P.BASE, n // 2), _spans(rnd, P.GENERATORS, n)
        rated = [(s, k, e, rnd.choice((0.5, 1.5)), e - s, -s, (k, s, e, m)) for k, s, e, m in proposed]
        rows.append((i, base, proposed, rated))
    table = spark.createDataFrame(rows, f"i int, base {P.SPAN}, proposed {P.SPAN}, rated array<struct<start:int,kind:string,"
                                        f"end:int,score:double,length:int,first:int,x:{P.SPAN[6:-1]}>>")
    got = {r.i: r for r in table.select("i", P._free(F.col("base"), F.col("proposed")).alias("free"),
                                        P._winners(F.col("rated")).alias("won")).collect()}
    for i, base, proposed, rated in rows:
        free = [x for x in proposed if not any(_meet(x, b) for b in base)]
        won = [y[6] for y in rated if not any(_meet(y[6], z[6]) and (*z[3:6], z[1]) > (*y[3:6], y[1]) for z in rated)]
        assert sorted(map(tuple, got[i].free)) == sorted(free)
        assert sorted(map(tuple, got[i].won)) == sorted(won)


def test_many_spans_in_one_text(spark):
    one = "é call 212-555-0147 or a1@b.cc, +1 212 555 0100 😀 "
    text = one * 1500
    docs = spark.createDataFrame([(1, text, 0), (2, one, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.spans for r in P.detect(docs).collect()}
    assert len(got[1]) == 1500 * len(got[2]) == 4500
    assert all(text[s.start:s.end] == s.match for s in got[1])
    clean = {r.doc_id: r.text for r in P.redact(docs).collect()}
    assert clean[2] == "é call <NUMBER> or <EMAIL>, <PHONE> 😀 " and clean[1] == clean[2] * 1500
