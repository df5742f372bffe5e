"""URL filter: rules for hosts and paths, and logistic regression on hashed character n-grams for all other urls.

The model is trained on a small labelled table of urls.  Host and path give n-grams of their own; each is hashed into one of
BUCKETS weights.  A rule fits its host with all subdomains and the paths that start with its own; the longest rule that fits
decides, else the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
EPOCHS, RATE, DECAY = 300, 0.5, 1e-3
#: The model blocks from this probability on: hosts unlike any labelled one lie near one half and are let through.
BLOCK_FROM = 0.7
#: (rule, verdict); the host ends at the first slash.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
#: Labelled urls: host and path, 1 for unwanted.
LABELLED = (
    ("www.spam-farm.example.org", "/en/7", 1), ("spamfarm.example.net", "/buy/1.html", 1), ("cheap-pills.example.org", "/en/33", 1),
    ("cheap-meds.example.net", "/shop/pills", 1), ("casino-win.example.org", "/en/9", 1), ("www.best-casino.example.net", "/slots", 1),
    ("free-bets.example.net", "/de/3", 1), ("m.free-bets.example.org", "/bet/now", 1), ("ads-track.example.org", "/en/58", 1),
    ("track.ads.example.net", "/click?id=", 1), ("adserver.example.org", "/banner/3", 1), ("xxx-video.example.net", "/hot", 1),
    ("hot-girls.example.org", "/cams", 1), ("win-money-fast.example.net", "/prize", 1), ("loans-now.example.org", "/apply/fast-cash", 1),
    ("viagra-store.example.net", "/order", 1), ("lottery-winner.example.org", "/claim", 1), ("download-crack.example.net", "/keygen", 1),
    ("free-iphone.example.org", "/win", 1), ("clickbait-news.example.net", "/you-wont-believe", 1), ("poker-bonus.example.org", "/join", 1),
    ("replica-watches.example.net", "/cheap", 1), ("seo-links.example.org", "/backlinks/buy", 1), ("weight-loss-pills.example.net", "/en/1", 1),
    ("blog.therand.example.org", "/en/12", 0), ("www.thening.example.net", "/de/420", 0), ("thetion.example.org", "/fr/3.html", 0),
    ("m.ounder.example.net", "/en/88", 0), ("news.example.org", "/2023/05/story.html", 0), ("docs.example.net", "/guide/install", 0),
    ("wiki.example.org", "/article/water", 0), ("library.example.net", "/catalog/77", 0), ("university.example.org", "/courses", 0),
    ("school.example.net", "/math/lesson-3", 0), ("recipes.example.org", "/bread", 0), ("garden.example.net", "/roses", 0),
    ("history.example.org", "/rome", 0), ("science.example.net", "/physics/light", 0), ("forum.example.org", "/thread/991", 0),
    ("blog.ondern.example.net", "/es/6", 0), ("travel.example.org", "/spain", 0), ("music.example.net", "/bach", 0),
    ("photos.example.org", "/album/4", 0), ("city.example.net", "/events", 0), ("weather.example.org", "/today", 0),
    ("health.example.net", "/sleep", 0), ("code.example.org", "/repo/readme", 0), ("archive.example.net", "/1998", 0),
)


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_for(hosts: Column, paths: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        name, _, rest = text.partition("/")
        fits = ((hosts == name) | F.endswith(hosts, F.lit("." + name))) & F.startswith(paths, F.lit("/" + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def buckets(host_text: str, path_text: str) -> np.ndarray:
    """The hashed n-grams of a url, each once."""
    out = set()
    for kind, text in (("h", host_text), ("p", path_text)):
        text = f"^{text}$"
        for n in GRAMS:
            out.update(zlib.crc32(f"{kind}{text[i:i + n]}".encode()) % BUCKETS for i in range(len(text) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def train(labelled: tuple[tuple[str, str, int], ...] = LABELLED) -> np.ndarray:
    """Weights (the last is the bias) by gradient descent on the labelled table; a url's n-grams share one unit."""
    rows = [(buckets(h, p), y) for h, p, y in labelled]
    w = np.zeros(BUCKETS + 1)
    for _ in range(EPOCHS):
        step = np.zeros_like(w)
        for at, y in rows:
            x = 1 / np.sqrt(max(len(at), 1))
            error = y - 1 / (1 + np.exp(-(w[at].sum() * x + w[-1])))
            step[at] += error * x
            step[-1] += error
        w += RATE * (step / len(rows) * 4 - DECAY * w)
    return w.astype(np.float32)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): ``page_id, host, path, rule, verdict, score``; ``score`` is the model's
    probability that the url is unwanted, and decides (block from BLOCK_FROM on) where no rule fits.

    A null url, or one without ``://``, has an empty host and path and fits no rule; the model allows it, since it has no
    n-grams to speak against it.  Repeated rows and null page_ids stay; other columns are ignored."""
    weights = pages.sparkSession.sparkContext.broadcast(train())  # BUCKETS + 1 numbers

    @F.pandas_udf("double")
    def unwanted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = weights.value.astype(np.float64)
        for hosts, paths in parts:
            out = np.zeros(len(hosts))
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                if h or p:
                    at = buckets(h, p)
                    out[i] = 1 / (1 + np.exp(-(w[at].sum() / np.sqrt(len(at)) + w[-1])))
            yield pd.Series(out)

    rows = pages.select("page_id", host().alias("host"), path().alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return (rows.withColumn("score", unwanted("host", "path")).withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))))
            .select("page_id", "host", "path", "rule", "verdict", "score"))
