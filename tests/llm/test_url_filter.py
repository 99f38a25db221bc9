import numpy as np
from pyspark.sql import functions as F

from dasyspark.llm import url_filter as U
from dasyspark.llm.queries import RULES, SITES


def test_levels_decide_every_key_of_the_universe_exactly():
    rng = np.random.default_rng(3)
    keys = [f"site{i}.example/{i * 7}" for i in range(20_000)]
    for share in (0.0, 0.001, 0.3, 0.9, 1.0):
        listed = rng.random(len(keys)) < share
        levels = U.build_levels(keys, listed)
        assert (U.is_listed(levels, keys) == listed).all()
    # Odd levels hold listed keys, even ones false positives: sizes fall quickly.
    sizes = [len(x.bits) for x in U.build_levels(keys, rng.random(len(keys)) < 0.1)]
    assert len(sizes) > 2 and sizes[0] > 4 * sizes[3]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def judged(url, sites):
    host, path = parts(url)
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    return host, path, None, "block" if any(s in host.split(".") for s in sites) else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Spam-Farm.example.ORG/es/1?x#y", "https://a.example.org", "https://org/",
    "https://x.org/z://w/", "ftp://k.example.com/fr/2", "ftp://k.example.com/de/2", "http://example.org/en/1", "http://a.example.org/en/12#t",
    "http://xexample.org/es/", "http://adult-x.example.net/q\nr", "http://ÄB.example.net?x", "http://free-bets.example.net#/x", "http://ads-track.example.net/",
    "http://ads-track.example.net/",
]


def test_filter_matches_plain_rules_for_broadcast_and_for_shuffled_filters(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 3)], "page_id long, url string, shard string")
    listed = F.col("host").rlike(f"(^|[.])({'|'.join(SITES)})[.]")
    want = [judged(u, SITES) for u in URLS * 3]
    for broadcast in (True, False):
        if not broadcast:
            monkeypatch.setattr(U, "small", lambda *a: False)
        monkeypatch.setattr(U, "KEYS_PER_SHARD", 5)
        rows = U.filter_urls(pages, listed, RULES).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == want


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(pages, F.lit(True), RULES).count() == 0
