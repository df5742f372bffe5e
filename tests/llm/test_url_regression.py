"""URL filter: parts and rules against a brute-force version, the model on urls it has not seen."""

from feedstack.llm import url_regression as U

URLS = [None, "", "no scheme.com/en/", "http://www.EXAMPLE.com/en/x?y#z", "https://a.example.com/en/", "http://example.com/en",
        "http://xample.com/EN/", "ftp://b.net/es/1", "http://net/fr/", "http://b.net?q=/fr/", "http://b.net#/fr/", "a://b://c.com/x",
        "http://user.com:80/p", "://com/", "http://dotcom/", "http://www.example.com/en/1\n2", "http://é.net/fr/é", "x://" + "a" * 20000 + "/b"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, _ in U.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_rules(spark):
    rows = [(i, u, "r") for i, u in enumerate(URLS)] + [(None, URLS[3], "r"), (3, URLS[3], "r")]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i, *brute(u)) for i, u, _ in rows), key=str)
    for r in got:
        assert r.verdict == (dict(U.RULES)[r.rule] if r.rule else "block" if r.score >= U.BLOCK_FROM else "allow")
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_model(spark):
    bad = ["http://casino-bets.example.org/x", "http://cheap-viagra-pills.example.net/buy", "http://m.spam-farm.example.org/fr/2"]
    good = ["http://blog.thander.example.org/en/5", "http://library.example.org/book/2", "http://ontion.example.net/de/8"]
    rows = [(i, u) for i, u in enumerate(bad + good)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3
