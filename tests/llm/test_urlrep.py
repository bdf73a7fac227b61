import re

from spindrift.llm import urlrep

URLS = [None, "", "no scheme/en/", "http://Example.COM/en/7?x#y", "https://a.example.com/en/8", "x://example.net/de/81", "x://example.net/de/7", "x://netde/de/", "http://org/es/a#b", "http://h.org?es/", "http://a://b.com/en/1", "http://COM/en/", "http://é.com/en/\n7", "http://myexample.com/en/7"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlrep.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(None, "http://q.de/", "z")], "page_id long, url string, host string")
    got = urlrep.verdicts(df, spark.createDataFrame([(1, None), (None, 1)], "page_id long, good int")).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = brute(URLS[r.page_id])
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urlrep.verdicts(df.limit(0), spark.createDataFrame([], "page_id long, good int")).count() == 0
    assert urlrep.verdicts(df, spark.createDataFrame([(1, 1)], "page_id long, good int"), rules=()).where("rule is not null").count() == 0


def test_reputation(spark):
    pages, good = [], []
    for h, rate in ((0, 10), (1, 10), (2, 9), (3, 0), (4, 0)):
        for i in range(40 if h != 4 else 1):
            pages.append((len(pages), f"http://h{h}.site{h % 3}.xy/{i}"))
            good.append((len(good), int(i % 10 < rate)))
    got = {r.host: r for r in urlrep.verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int")).collect()}
    assert got["h3.site0.xy"].verdict == "block" and got["h0.site0.xy"].verdict == "allow" and got["h2.site2.xy"].verdict == "allow"
    assert got["h4.site1.xy"].verdict == "allow"  # one bad page of a good domain is shrunk


def test_repeated_pages_and_long_urls(spark):
    long = "http://h.com/en/" + "a" * 1_000_000
    rows = [(1, long), (1, long), (2, "http://" + "b." * 100_000 + "org/es/x"), (3, "http://h.com/")]
    got = urlrep.verdicts(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 1), (1, 0)], "page_id long, good int")).collect()
    assert sorted((r.page_id, len(r.host), len(r.path), r.rule) for r in got) == [(1, 5, 1_000_004, "com/en/"), (1, 5, 1_000_004, "com/en/"), (2, 200_003, 5, "org/es/"), (3, 5, 1, None)]


def test_domains(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("",), ("co.uk",)], "h string").select(urlrep.domain_of(F.col("h")), urlrep.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", ""), ("co.uk", "co.uk")]


def test_hosts_of_different_rates_separate(spark):
    """Forty hosts with a good rate of 0.9 and ten with 0.5, each with 60 outcomes: every one of the ten is blocked, none of the forty. With rates that differ by chance only, none is."""
    def judged(rate):
        pages = [(h * 1000 + k, f"https://h{h}.site{h}.com/p{k}") for h in range(50) for k in range(60)]
        outcomes = [(h * 1000 + k, int((k * 37 + h * 11) % 60 < rate(h) * 60)) for h in range(50) for k in range(60)]
        got = urlrep.verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int"))
        return {r.host for r in got.collect() if r.verdict == "block" and r.rule is None}

    assert judged(lambda h: 0.5 if h % 5 == 0 else 0.9) == {f"h{h}.site{h}.com" for h in range(0, 50, 5)}
    assert judged(lambda h: 0.85) == set()
