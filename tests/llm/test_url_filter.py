import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import queries, url_filter
from tallyframe.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org", "http://example.org/", "http://example.org/es", "http://example.org/es/", "http://x.example.org/en/12?q=/es/#f", "http://notexample.org/es/x",
    "http://org/es/", "http://com/de/", "http://fooorg/de/", "https://É.com/fr/a", "http://ÉX.Com/de/x#", "a://b.com://c/de/", "http://b.com?x=/de/", "http://b.com#/de/", "x\nhttp://b.com/de/\n?", "http://user@b.com:80/de/", "http://b.com:80/de/",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(t, v) for v, t in RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def brute_scores(pages):
    """Dense matrices: trust over links, distrust against them, until nothing moves."""
    links, seeds = Counter(), defaultdict(lambda: [0.0, 0.0])
    hosts = set()
    for url, html in pages:
        host, path = parse(url)
        hosts.add(host)
        v = rule_of(host, path)[1]
        if v and host:
            seeds[host][v == "block"] += 1
        for b in re.findall(url_filter.LINK, html or ""):
            b = b.lower()
            hosts.add(b)
            if host and b != host:
                links[host, b] += 1
    for h in list(hosts):
        parts = h.split(".")
        for i in range(len(parts) - 2):
            a, b = ".".join(parts[i:]), ".".join(parts[i + 1 :])
            hosts |= {a, b}
            links[a, b] = max(links[a, b], 0)
    pairs = {(".".join(h.split(".")[i:]), ".".join(h.split(".")[i + 1 :])) for h in hosts for i in range(len(h.split(".")) - 2)}
    for a, b in pairs:
        links[a, b] += 1
        links[b, a] += 1
    names = sorted(hosts)
    at = {h: i for i, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        w[at[a], at[b]] += n
    forward = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    backward = (w / np.maximum(w.sum(axis=0, keepdims=True), 1e-300)).T
    s = np.array([seeds[h] if h in seeds else [0, 0] for h in names])
    t, d, total = (1 - 0.7) * s[:, 0], (1 - 0.7) * s[:, 1], np.zeros((len(names), 2))
    for _ in range(200):
        total += np.stack([t, d], axis=1)
        t, d = 0.7 * t @ forward, 0.7 * d @ backward
    return {h: total[i] for h, i in at.items()}


def check(got, pages):
    scores = brute_scores(pages.values())
    assert len(got) == len(pages)
    for r in got:
        host, path = parse(pages[r.page_id][0])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        trust, distrust = scores[host]
        assert abs((r.trust or 0) - trust) < 0.02 and abs((r.distrust or 0) - distrust) < 0.02
        if verdict:
            assert r.verdict == verdict
        elif abs(distrust - 0.75 * (trust + distrust)) > 0.02 or not distrust:
            assert r.verdict == ("block" if distrust > 0 and distrust >= 0.75 * (trust + distrust) else "allow")


def test_query_on_pages(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    check(queries.op6_url_filter(spark, SF).collect(), pages)


def test_odd_urls(spark):
    pages = {i: (u, None if i % 3 else f"<a href='//x{i}.net/a'>") for i, u in enumerate(URLS)}
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, (u, h) in pages.items()], "page_id long, url string, html string, host string, trust int")
    check(url_filter.filter_urls(df).collect(), pages)


def test_distrust_goes_to_those_that_link_to_blocked_hosts(spark):
    spam = [(f"http://spam{i}.net/", "<A class=x HREF=\"https://bad.com/de/1\">") for i in range(3)]
    good = [("http://good.net/", "<a href='http://fine.net/'>"), ("http://fine.net/", ""), ("http://x.org/", "<a href=//friend.net/>"), ("http://friend.net/a", None)]
    rows = [("http://bad.com/de/1", "<a href='http://victim.net/'>"), ("http://victim.net/", ""), *spam, *good]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.filter_urls(df).collect()}
    assert {got[f"spam{i}.net"].verdict for i in range(3)} == {"block"}
    assert {got[h].verdict for h in ("good.net", "fine.net", "friend.net", "victim.net")} == {"allow"}
    assert got["friend.net"].trust > 0
    check(got.values(), dict(enumerate(rows)))


def test_repeats_and_no_pages(spark):
    schema = "page_id long, url string, html string"
    twice = spark.createDataFrame([(1, "http://a.com/de/", None), (1, "http://a.com/de/", None), (None, None, None)], schema)
    assert Counter(r.verdict for r in url_filter.filter_urls(twice).collect()) == {"block": 2, "allow": 1}
    assert url_filter.filter_urls(spark.createDataFrame([], schema)).collect() == []
    assert [r.verdict for r in url_filter.filter_urls(twice, (Rule("allow", "a.com/"),)).filter("host = 'a.com'").collect()] == ["allow"] * 2


def test_a_hot_host_does_not_end_what_a_small_seed_starts(spark):
    """All hosts of a chain to a blocked one are blocked, with or without a host that has most pages and no links."""
    chain = [("http://bad.com/de/1", "")] + [(f"http://s{i}.net/", f"<a href='http://{'bad.com' if i == 0 else f's{i - 1}.net'}/'>") for i in range(5)]
    rows = chain + [("http://hot.com/fr/", "")] * 5000
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.filter_urls(df).filter("host like 's%'").collect()}
    assert {got[f"s{i}.net"].verdict for i in range(5)} == {"block"}


def test_domains_above_a_host(spark):
    hosts = {"a.b.com": ["b.com"], "b.com": [], "com": [], "a.b.com:8080": ["a.b.com", "b.com"], "me@x.org": ["x.org"], "10.7.3.4": [], "10.7.3.4:80": ["10.7.3.4"], "[::1]": [], "[::1]:80": ["[::1]"],
             "shop.example.co.uk": ["example.co.uk"], "a.com.au": [], "": [], "a..b.net": ["b.net"]}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.parents_of(F.col("host")).alias("p")).collect()
    assert {r.host: r.p for r in rows} == {h: ([h] if h else []) + above for h, above in hosts.items()}


def test_addresses_share_nothing(spark):
    """10.7.3.4 and 99.1.3.4 end alike and are strangers; a port is the same host."""
    pages = [(1, "http://10.7.3.4/x", None), (2, "http://99.1.3.4/x", None), (3, "http://a.bad.com/de/x", None), (4, "http://bad.com:8080/x", None)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), (url_filter.Rule("block", "10.7.3.4/x"), url_filter.Rule("block", "a.bad.com/de"))).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block"}
