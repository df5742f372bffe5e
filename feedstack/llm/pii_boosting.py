"""Personal data by candidate gradient boosting, in column expressions only.

Two layers give spans of a text:

* the base kinds (email, ip, card, phone) with their fixed checks;
* high-recall generators that propose further spans, also overlapping ones.  Boosted trees of depth two score each
  proposal by its format and context; a threshold calibrated on out-of-fold scores selects those to redact.

The trees are trained on a small labelled table of snippets.  Its features come from the same expressions as those of
the corpus; the boosting itself runs over the few rows of that table.  The trees are applied as CASE expressions.

Patterns use possessive repeats where a greedy one could only give up the same characters, so they don't recurse deeply
in long texts.  Spans are compared in sweeps in order of their starts, so a text with many spans takes near linear time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_as

BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further spans: groups of digits, bracketed area codes, spelled-out addresses, account numbers.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])(?:\([0-9]{2,5}\)[\x20-]?)?[0-9](?:[\x20./-]?[0-9]){6,}+(?![0-9A-Za-z])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+"
               r"(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+)++",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
}
KINDS = BASE + tuple(GENERATORS)
#: Code points of context on either side.
CONTEXT = 32
#: Greater than every position in a text.
FAR = 2_147_483_647
#: Values of one running result are taken in groups of so many; a text is cut into chunks of so many code points.
GROUP, CHUNK = 256, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, also where the body uses it inside further lambdas."""
    return F.transform(F.array(value), body)[0]


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _scan(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """Exclusive running results of an associative ``step`` with the neutral element ``zero`` over an array of integers,
    in two levels so that the work stays near linear."""
    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(zero)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def of(xs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / GROUP).cast("int")),
                             lambda g: F.slice(xs, g * GROUP + 1, GROUP))
        return _let(groups, lambda gs: F.flatten(F.zip_with(
            gs, F.slice(running(F.transform(gs, lambda g: F.aggregate(g, F.lit(zero), step))), 1, F.size(gs)),
            lambda g, s: F.slice(F.transform(running(g), lambda x: step(s, x)), 1, F.size(g)))))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, of(xs)).otherwise(F.array().cast("array<int>")))


def _excerpt(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text cut into chunks, without walking over what stands before."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(1))), "")
    return F.substring(near, start % CHUNK + 1, end - start)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def find_spans(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches as an array of (kind, start, end, match); code points, end exclusive."""
    def spans(found: Column, between: Column) -> Column:
        starts = _scan(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b)),
                       0, lambda a, b: a + b)
        return F.transform(
            F.arrays_zip(starts.alias("s"), F.slice(between, 1, F.size(found)).alias("b"), found.alias("m")),
            lambda x: F.struct(F.lit(kind).alias("kind"), (x["s"] + F.length(x["b"])).alias("start"),
                               (x["s"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("match")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, _let(F.split(text, pattern, -1), lambda between: spans(found, between)))
        .otherwise(F.array().cast(SPAN)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _checked(kind: str, m: Column) -> Column:
    """The base kinds' check of a match."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


#: What must be in a text for a pattern to match at all; a cheap test before the pattern.
_NEEDS = {"email": "@", "phone": "+", "ip": "."}


def base_spans(text: Column, kind: str) -> Column:
    """The spans of a base kind after its check."""
    spans = F.filter(find_spans(text, kind, PATTERNS[kind]), lambda s: _checked(kind, s["match"]))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), spans).otherwise(F.array().cast(SPAN)) if kind in _NEEDS else spans


#: Features of a proposal: (name, expression of match and context).  Words are looked for in lower-cased context.
def _features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    near, digits = F.lower(F.concat(before, F.lit(" | "), after)), _digits(m)
    last = F.lower(before)
    n = F.length(digits)
    return {
        "address": F.lower(m).rlike(r"at[\])\x20]"),
        "dotted": F.lower(m).rlike(r"dot[\])\x20]|\.[a-z]"),
        "account": m.rlike(r"^[A-Z]{2}[0-9]{2}"),
        "social": m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "area": m.rlike(r"^\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}$"),
        "local": m.rlike(r"^[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4}$"),
        "date": m.rlike(r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})$"),
        "quads": m.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$"),
        "thirteen": n.between(13, 19),
        "ten": n.between(9, 12),
        "short": n < 9,
        "luhn": F.when(n > 0, luhn(digits)).otherwise(F.lit(False)),
        "grouped": m.rlike(r"[0-9][\x20-][0-9]"),
        "points": m.rlike(r"[0-9][./][0-9]"),
        "says_phone": near.rlike(r"phone|tel\b|call|mobile|cell|fax|whatsapp|sms|dial"),
        "says_card": near.rlike(r"card|visa|master|amex|credit|debit|cvv|expires"),
        "says_id": near.rlike(r"ssn|social security|passport|licen[cs]e|national id|tax id|insurance"),
        "says_account": near.rlike(r"iban|account|bank|swift|bic|routing|wire"),
        "says_birth": near.rlike(r"born|birth|\bdob\b"),
        "says_mail": near.rlike(r"e-?mail|mail|contact|write to|reach"),
        "says_other": near.rlike(r"version|order|invoice|isbn|page|fig|table|build|serial|ticket|total|doi|article|sku|part no"
                                 r"|case|chapter|timestamp|id:|hash|commit"),
        "after_equals": last.rlike(r"[=:#]\s*$"),
        "money": F.concat(before, F.lit("|"), after).rlike(r"[$€£]\s?$|[$€£]\s?\||\|\s?(?:USD|EUR|GBP|%)"),
    }


FEATURES = ("address dotted account social area local date quads thirteen ten short luhn grouped points says_phone says_card "
            "says_id says_account says_birth says_mail says_other after_equals money").split()

#: Labelled snippets: the text before, the span, the text after, and whether it is personal data.
LABELLED = (
    ("you can call me at ", "555-213-8890", " after six", 1), ("phone: ", "(212) 555-0188", ", ask for Ann", 1),
    ("my mobile is ", "0171 5558 9234", " in case", 1), ("reach us by tel ", "030 5559 8812", " on weekdays", 1),
    ("fax no. ", "415.555.0132", " or by mail", 1), ("cell ", "917 555 0111", " text me", 1),
    ("", "(305) 555-7781", " is her number", 1), ("write him or ring ", "646-555-0199", ".", 1),
    ("her SSN is ", "078-05-1120", " on file", 1), ("social security number ", "219-09-9999", "", 1),
    ("applicant ", "457-55-5462", " was approved", 1), ("passport no ", "512345678", " issued in", 1),
    ("national id ", "8001015009087", " of the holder", 1), ("tax id ", "12 345 678 901", " for the return", 1),
    ("driver license ", "9988776655", " expires soon", 1), ("paid with visa ", "4111 1111 1111 1112", " yesterday", 1),
    ("card number ", "5500-0000-0000-0005", ", cvv", 1), ("credit card ", "4929123456781234", " was charged", 1),
    ("the card ", "3782 822463 10006", " expires 09/27", 1), ("debit card ", "6011000990139425", " stolen", 1),
    ("mastercard ", "5105105105105101", " in her name", 1), ("IBAN ", "DE89 3704 0044 0532 0130 00", " at the bank", 1),
    ("wire it to ", "GB29NWBK60161331926819", " please", 1), ("account ", "FR1420041010050500013M02606", " holder", 1),
    ("bank account ", "12345678901", " routing", 1), ("routing and account ", "021000021 1234567", " wire", 1),
    ("she was born ", "12/03/1981", " in Leeds", 1), ("date of birth: ", "1979-11-23", ", male", 1),
    ("dob ", "01.02.1990", " patient", 1), ("born on ", "23.07.1964", " and raised", 1),
    ("e-mail ", "john.doe [at] example [dot] com", " for details", 1), ("contact ", "anna (at) mail.example.org", " today", 1),
    ("write to ", "sales at example dot net", " now", 1), ("mail me: ", "bob_99 [at] host.example.com", ".", 1),
    ("reach ", "k.lee (at) uni (dot) edu", " instead", 1), ("", "mary [at] example [dot] org", "", 1),
    ("order ", "20240117001", " was shipped", 0), ("invoice no ", "100-200-3000", " is due", 0),
    ("version ", "10.15.7.2019", " is out", 0), ("ISBN ", "978-3-16-148410-0", " paperback", 0),
    ("ISBN ", "9783161484100", "", 0), ("see page ", "112-118 2009", " for more", 0), ("build ", "20230914123055", " passed", 0),
    ("timestamp ", "1694692800000", " utc", 0), ("the total was ", "1000000", " units", 0), ("serial ", "0004512367891234", " tag", 0),
    ("about $", "12.500.000", " in sales", 0), ("sold for € ", "1.250.000", " last year", 0), ("doi ", "10.1000/1822015", " article", 0),
    ("meeting on ", "2024-01-17", " at noon", 0), ("released ", "17/01/2024", " worldwide", 0), ("since ", "01.01.2000", " the law", 0),
    ("ticket ", "445566778", " closed", 0), ("commit ", "1234567890123", " merged", 0), ("population ", "8 336 817", " people", 0),
    ("fig ", "2001 2002 2003", " shows", 0), ("id: ", "99887766554433", " in the table", 0), ("sku ", "885909950805", " in stock", 0),
    ("ran from ", "1998-2004 2006", " on air", 0), ("part no ", "123-45-6789", " fits", 0), ("a distance of ", "149 597 870", " km", 0),
    ("the number ", "31415926535", " begins", 0), ("we met ", "at 5 at home.then", " again", 0),
    ("article ", "1234-5678 2019", " journal", 0), ("he arrived ", "late at night.But", " slept", 0),
    ("look ", "at once.It", " works", 0), ("serial ", "GB12ABCD1234EFGH5678", " of the part", 0), ("case ", "2019/1234567", " in court", 0),
    ("", "3141592653589793", " digits", 0), ("", "1234567890", "", 0), ("code ", "7000-123-4567", " table", 0),
    ("good ", "at chess.He", " won", 0), ("meet ", "me at noon.We", " talk", 0), ("values ", "1/2/3/4/5/6/7", " in order", 0),
)
TREES, RATE, FOLDS, PRECISION = 24, 0.4, 6, 0.95


def _grow(rows: list[tuple[tuple[bool, ...], int]], trees: int = TREES) -> tuple[float, list[tuple]]:
    """Boosted trees of depth two for logistic loss: (start, [(feature, left, right)]), where a side is a
    (feature, value if false, value if true)."""
    mean = min(max(sum(y for _, y in rows) / len(rows), 0.01), 0.99)
    start = math.log(mean / (1 - mean))
    score, out = [start] * len(rows), []
    width = len(rows[0][0])
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [y - q for (_, y), q in zip(rows, p, strict=True)], [q * (1 - q) for q in p]

        def leaf(at: list[int]) -> tuple[float, float]:
            a, b = sum(g[i] for i in at), sum(h[i] for i in at) + 1.0
            return a * a / b, RATE * a / b

        def cut(at: list[int]) -> tuple[float, int, float, float]:
            best = (-1.0, 0, 0.0, 0.0)
            for f in range(width):
                no, yes = [i for i in at if not rows[i][0][f]], [i for i in at if rows[i][0][f]]
                (x, v), (y, w) = leaf(no), leaf(yes)
                if x + y > best[0] + 1e-12:
                    best = (x + y, f, v, w)
            return best

        top = max(range(width), key=lambda f: (cut([i for i in range(len(rows)) if not rows[i][0][f]])[0]
                                               + cut([i for i in range(len(rows)) if rows[i][0][f]])[0], -f))
        no, yes = (cut([i for i in range(len(rows)) if rows[i][0][top] == side]) for side in (False, True))
        out.append((top, no[1:], yes[1:]))
        for i, (x, _) in enumerate(rows):
            f, v, w = yes[1:] if x[top] else no[1:]
            score[i] += w if x[f] else v
    return start, out


def _score(model: tuple[float, list[tuple]], x: tuple[bool, ...]) -> float:
    s = model[0]
    for top, no, yes in model[1]:
        f, v, w = yes if x[top] else no
        s += w if x[f] else v
    return s


def train(spark: SparkSession) -> tuple[tuple[float, list[tuple]], float]:
    """The trees and the calibrated threshold: the least out-of-fold score from which on PRECISION is kept."""
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b"), F.lit(m).alias("m"), F.lit(a).alias("a"))
                      for i, (b, m, a, _) in enumerate(LABELLED)])
    table = spark.range(1).select(F.inline(lines))
    made = _features(F.col("m"), F.col("b"), F.col("a"))
    rows = table.select("i", *[made[f].alias(f) for f in FEATURES]).orderBy("i").collect()
    return _fit(tuple(tuple(bool(v) for v in r[1:]) for r in rows))


@lru_cache(maxsize=4)
def _fit(features: tuple[tuple[bool, ...], ...]) -> tuple[tuple[float, list[tuple]], float]:
    data = [(x, label) for x, (_, _, _, label) in zip(features, LABELLED, strict=True)]
    scores = []
    for fold in range(FOLDS):
        model = _grow([d for i, d in enumerate(data) if i % FOLDS != fold])
        scores += [(_score(model, x), y) for i, (x, y) in enumerate(data) if i % FOLDS == fold]
    scores.sort(reverse=True)
    good, threshold = 0, scores[0][0]
    for n, (s, y) in enumerate(scores, 1):
        good += y
        if good / n >= PRECISION:
            threshold = s
    return _grow(data), threshold


def score(model: tuple[float, list[tuple]], features: dict[str, Column]) -> Column:
    """The trees as a column expression."""
    total = F.lit(float(model[0]))
    for top, no, yes in model[1]:
        def side(t: tuple[int, float, float]) -> Column:
            return F.when(features[FEATURES[t[0]]], F.lit(float(t[2]))).otherwise(F.lit(float(t[1])))

        total = total + F.when(features[FEATURES[top]], side(yes)).otherwise(side(no))
    return total


def _free(base: Column, proposed: Column) -> Column:
    """The proposals that overlap no base span, by start: one sweep over both in order of their starts, with the furthest
    base end before each proposal and the next base start after it."""
    def event(x: Column, is_proposal: int) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(is_proposal).alias("proposal"), x["end"].alias("end"),
                        x["kind"].alias("kind"), x["match"].alias("match"))

    def kept(events: Column) -> Column:
        ends = _scan(F.transform(events, lambda e: F.when(e["proposal"] == 0, e["end"]).otherwise(F.lit(-1))), -1, _most)
        starts = F.reverse(_scan(F.reverse(F.transform(
            events, lambda e: F.when(e["proposal"] == 0, -e["start"]).otherwise(F.lit(-FAR)))), -FAR, _most))
        sweep = F.arrays_zip(events.alias("e"), ends.alias("before"), starts.alias("after"))
        return F.transform(
            F.filter(sweep, lambda x: (x["e"]["proposal"] == 1) & (x["before"] <= x["e"]["start"])
                     & (-x["after"] >= x["e"]["end"])),
            lambda x: F.struct(*[x["e"][f].alias(f) for f in ("kind", "start", "end", "match")]))

    events = F.concat(F.transform(base, lambda x: event(x, 0)), F.transform(proposed, lambda x: event(x, 1)))
    return _let(F.array_sort(events), kept)


def _winners(rated: Column) -> Column:
    """Of proposals (start, kind, end, score, length, first, x), those that no better one overlaps, by start.

    Spans of one kind don't overlap, so of two overlapping spans the one that starts first is the last of its kind before
    the other.  So each span is compared with one span of each kind, and the lesser of two overlapping ones is out."""
    def rank(y: Column) -> Column:
        return F.struct(y["score"], y["length"], y["first"], y["kind"])

    def kept(ys: Column) -> Column:
        def last(kind: str) -> Column:
            return _scan(F.transform(ys, lambda y, i: F.when(y["kind"] == kind, i).otherwise(F.lit(-1))), -1, _most).alias(kind)

        def lesser(at: Column, i: Column) -> Column:
            y, out = ys[i], []
            for k in GENERATORS:
                z = ys[F.greatest(at[k], F.lit(0))]
                out.append(F.when((at[k] >= 0) & (z["end"] > y["start"]), F.when(rank(z) > rank(y), i).otherwise(at[k]))
                           .otherwise(F.lit(-1)))
            return F.array(*out)

        out = F.flatten(F.transform(F.arrays_zip(*[last(k) for k in GENERATORS]), lesser))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(ys) - 1), out), lambda i: ys[i]["x"])

    return _let(F.array_sort(rated), lambda ys: F.when(F.size(ys) > 0, kept(ys)).otherwise(F.array().cast(SPAN)))


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``spans``: array of (kind, start, end, match) by kind (KINDS in order), then start; and
    ``email``, ``ip``, ``card``, ``phone``: the base spans of each kind in the same form.

    Base kinds are those of the contract, each leftmost and non-overlapping within its kind.  A proposal is added where
    its score reaches the threshold, it overlaps no base span, and no better proposal (score, then length, then start)
    overlaps it.  Null and empty texts have no spans; every row stays, with all its columns (columns of these names are
    replaced)."""
    model, threshold = train(docs.sparkSession)
    text = empty_as("text")
    out = docs.select(*[c for c in docs.columns if c not in (*BASE, "spans", "_chosen")])
    out = out.withColumns({k: base_spans(text, k) for k in BASE})

    def placed(x: Column, chunks: Column) -> Column:
        return F.struct(x.alias("x"), _excerpt(chunks, F.greatest(x["start"] - CONTEXT, F.lit(0)), x["start"]).alias("before"),
                        _excerpt(chunks, x["end"], x["end"] + CONTEXT).alias("after"))

    def rated(p: Column) -> Column:
        made = _features(p["x"]["match"], p["before"], p["after"])
        return F.struct(F.array(*[made[f] for f in FEATURES]).alias("f"), p["x"].alias("x"))

    def scored(y: Column) -> Column:
        made = {f: y["f"][i] for i, f in enumerate(FEATURES)}
        return F.struct(y["x"]["start"].alias("start"), y["x"]["kind"].alias("kind"), y["x"]["end"].alias("end"),
                        score(model, made).alias("score"), (y["x"]["end"] - y["x"]["start"]).alias("length"),
                        (-y["x"]["start"]).alias("first"), y["x"].alias("x"))

    base = F.concat(*BASE)
    proposed = F.concat(
        F.when(text.rlike("[0-9]"), F.concat(find_spans(text, "number", GENERATORS["number"]),
                                             find_spans(text, "account", GENERATORS["account"]))).otherwise(F.array().cast(SPAN)),
        F.when(text.rlike(r"at[\])\x20]"), find_spans(text, "address", GENERATORS["address"])).otherwise(F.array().cast(SPAN)))

    def chosen(free: Column) -> Column:
        return F.when(F.size(free) > 0, _let(_chunks(text), lambda chunks: _winners(F.filter(
            F.transform(F.transform(F.transform(free, lambda x: placed(x, chunks)), rated), scored), lambda y: y["score"] >= threshold)))
        ).otherwise(F.array().cast(SPAN))

    out = out.withColumn("_chosen", _let(proposed, lambda some: F.when(
        F.size(some) > 0, _let(_free(base, some), chosen)).otherwise(F.array().cast(SPAN))))

    def of_kind(kind: str) -> Column:
        return F.filter("_chosen", lambda s: s["kind"] == kind)

    by_kind = [of_kind(k) for k in GENERATORS]
    return out.withColumn("spans", F.concat(base, *by_kind)).drop("_chosen")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each stretch of overlapping spans of its texts replaced by ``<KIND>`` of its first span, and
    ``n_chars`` (where there is such a column) set to the new length of a text that changed.  A null text stays null."""
    found = detect(docs)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def stretches(spans: Column) -> Column:
        def cut(before: Column) -> Column:  # before: the furthest end of all spans before each
            news = F.filter(F.transform(spans, lambda s, i: F.when(before[i] <= s["start"], i)), lambda i: i.isNotNull())
            return _let(news, lambda new: F.transform(new, lambda i, k: F.struct(
                spans[i]["start"].alias("start"),
                F.when(k + 1 < F.size(new), F.get(before, F.get(new, k + 1))).otherwise(
                    F.array_max(F.transform(F.slice(spans, i + 1, F.size(spans)), lambda s: s["end"]))).alias("end"),
                spans[i]["kind"].alias("kind"))))

        return _let(_scan(F.transform(spans, lambda s: s["end"]), 0, _most), cut)

    found = found.withColumn("_cut", _let(ordered, stretches))

    def cleaned(chunks: Column, cut: Column) -> Column:
        pieces = F.transform(cut, lambda s, i: F.concat(
            _let(F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(F.lit(0)), lambda at: _excerpt(chunks, at, s["start"])),
            F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.element_at(cut, -1)["end"] + 1, F.length("text")))

    clean = F.when(F.size("_cut") > 0, _let(_chunks(F.col("text")), lambda chunks: cleaned(chunks, F.col("_cut")))
                   ).otherwise(F.col("text"))
    found = found.withColumn("_clean", clean)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_clean").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.size("_cut") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars").cast("long")).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(*columns)
