"""Url rules against a test of every rule on every url."""

import random
from collections import Counter

import pytest

from loanward.llm.urls import domains, judge_urls, stated_rules
from tests.llm.conftest import table

_LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)]
    tail = rest[ends[0]:]
    stops = [i for i, c in enumerate(tail) if c in "?#"] or [len(tail)]
    return rest[:ends[0]].translate(_LOW), tail[:stops[0]]


def _plain(urls, rules, default="allow"):
    out = Counter()
    for page, url in urls:
        host, path = _parts(url)
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in ((h.translate(_LOW), p, v) for h, p, v in rules)
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out[page, host, path, best[2], best[3]] += 1
    return out


def _got(spark, urls, rules, **options):
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' AS rule", "1 AS host", "2 AS part", "3 AS key")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    return Counter(tuple(r) for r in judge_urls(pages, frame, **options).collect())


def test_domains_are_limited_by_the_rules():
    assert list(domains("a.b.c", 3)) == ["c", "c.b", "c.b.a"]
    assert list(domains("a.b.c", 2)) == ["c", "c.b", "c.b.a"]
    assert list(domains("w.a.b.c", 2)) == ["c", "c.b", "c.b.a.w"]
    assert list(domains("a", 0)) == ["a"]
    assert len(list(domains("." * 5000, 4))) == 5


@pytest.mark.parametrize("range_keys", [40, 100_000])
def test_random_rules_and_urls(spark, range_keys):
    r = random.Random(4)
    labels, parts = ["a", "b", "C", "aa", "", "é"], ["/", "/a", "/a/", "/ab", "", "/é", "/A"]

    def host():
        return ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))

    rules = [(host(), "".join(r.choice(parts) for _ in range(r.randint(0, 2))), r.choice(["allow", "block"])) for _ in range(80)]
    urls = [(i % 300, f"http://{host()}{''.join(r.choice(parts) for _ in range(r.randint(0, 3)))}{r.choice(['', '?q=://x', '#f/?'])}")
            for i in range(600)]
    urls += [(7, "http://a.b/hot/a")] * 300 + [(8, "http://a.b/hot/a"), (None, "http://a.b/hot/a")]
    assert _got(spark, urls, sorted(set(rules)), range_keys=range_keys) == _plain(urls, sorted(set(rules)))


def test_odd_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "", "block")]
    urls = [(1, None), (2, ""), (3, "www.example.com/en/"), (4, "http://"), (5, "http://WWW.Example.com/en/x"), (6, "http://example.com"),
            (7, "http://notexample.com/en/"), (8, "x\n://m.example.com/en/?a"), (9, "http://example.com:80/en/"), (10, "a://b://example.com/en/"),
            (11, "http://" + "x." * 20_000 + "example.com/en/" + "y" * 100_000), (12, "http://" + "z" * 300_000), (13, "http://\x00.com/\x00")]
    urls += [(1, None), (5, "http://WWW.Example.com/en/x")]
    assert _got(spark, urls, rules) == _plain(urls, rules)
    assert _got(spark, urls, rules, range_keys=3) == _plain(urls, rules)


def test_long_rules_reach_over_range_cuts(spark):
    rules = [("a.b", "/" + "p" * n, v) for n, v in ((10, "block"), (250, "allow"), (600, "block"))]
    urls = [(i, "http://a.b/" + "p" * (i * 7) + ("q" if i % 2 else "")) for i in range(100)]
    assert _got(spark, urls, rules, range_keys=5) == _plain(urls, rules)


def test_empty_tables(spark):
    assert not _got(spark, [], [("com", "/", "block")])
    assert _got(spark, [(1, "http://a.com/")], [], default="block") == Counter({(1, "a.com", "/", None, "block"): 1})


def test_a_rule_with_both_verdicts_blocks(spark):
    rules = [("com", "/", "allow"), ("com", "/", "block"), ("COM", "/", "allow")]
    assert _got(spark, [(1, "http://a.com/")], rules) == Counter({(1, "a.com", "/", "com/", "block"): 1})


def test_whole_table(spark, small):
    urls = [(r.page_id, r.url) for r in table(spark, small, "pages").collect()]
    rules = [tuple(r) for r in stated_rules(spark).collect()]
    got = Counter(tuple(r) for r in judge_urls(table(spark, small, "pages"), stated_rules(spark), range_keys=50).collect())
    assert got == _plain(urls, rules)
