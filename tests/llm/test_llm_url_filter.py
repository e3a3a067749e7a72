"""Rules, features and the learned verdict of urls."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from llm import url_filter as U
from llm.queries import QUERIES


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q=1#f", "https://example.com/en/", "https://example.com/en", "https://a.www.example.com/en/1",
        "https://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://a.net?x/fr/", "http://a.com#/", "http://a.com", "http://a.b.org/en/?u=http://c.com/",
        "http://ünï.com/é?a&b&c", "http://a.com/" + "x" * 5000, "ftp://a.net/es/", "http://a.com/", "http://a.com/"]


def test_rules_on_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, label string")
    got = {r.page_id: r for r in U.judge(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in (U.ALLOW, U.BLOCK)
    assert U.judge(df.limit(0)).count() == 0


def test_features(spark):
    df = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    host, path = U.host_and_path(F.col("url"))
    for r in U.lexical(df.withColumn("host", host).withColumn("path", path)).collect():
        c = Counter(r.url)
        assert abs(r.entropy + sum(n / len(r.url) * math.log2(n / len(r.url)) for n in c.values())) < 1e-9
        assert abs(r.digit_ratio - sum(x.isascii() and x.isdigit() for x in r.url) / len(r.url)) < 1e-12
        assert r.depth == len([x for x in r.path.split("/") if x]) and r.hyphens == r.url.count("-")


def test_every_page_and_its_rule(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op6_url_filter"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_verdicts_of_unlabelled_hosts(spark):
    """Blocked urls are long and full of digits; urls of a host without a rule are judged by their form."""
    rows = []
    for i in range(600):
        host = ("a.good.org", "b.bad.org", "c.new.net")[i % 3]
        bad = i % 3 == 1 or (i % 3 == 2 and i % 2 == 0)
        path = "/".join(f"{(i * 7919 + j * 104729) % 10**7}" for j in range(5)) + "?p=1&q=2" if bad else "news/" + "abcdefgh"[: 2 + i % 6]
        rows.append((i, f"https://{host}/{path}", bad))
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), [(U.ALLOW, "good.org", "/"), (U.BLOCK, "bad.org", "/")]).collect()}
    test = [(got[i], bad) for i, _, bad in rows if i % 3 == 2]
    assert all(r.rule is None and 0 <= r.block_probability <= 1 for r, _ in test)
    assert sum((r.verdict == U.BLOCK) == bad for r, bad in test) / len(test) > 0.95
