import time

import pytest

from tracewell.llm.queries import URL_RULES
from tracewell.llm.url_rules import judge_urls, rule_table

URLS = [None, "", "no-scheme/x", "http://EXAMPLE.org/en/13?x", "https://a.b.example.org/es/1#f", "ftp://notexample.org/es/1", "http://x.com/fr/", "http://x.com/FR/", "http://com/de/1", "http://a.org", "http://a.org/", "x://?q", "http://é.example.org/en/2", "http://x://y.com/fr/z", "http://a..org/b", "http://x.com/fr/"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for i, c in enumerate(rest):
            if c in "/?#":
                host, rest = rest[:i], rest[i:]
                break
        else:
            host, rest = rest, ""
        for i, c in enumerate(rest):
            if c in "?#":
                rest = rest[:i]
                break
        path = rest
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


@pytest.mark.parametrize("limit", [100, 0])
def test_against_brute_force(spark, limit):
    pages = spark.createDataFrame([(i, u, "h", "own") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "own")], "page_id long, url string, html string, host string")
    got = judge_urls(pages, rule_table(spark, URL_RULES), broadcast_rules=limit).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id], URL_RULES)


def test_no_rules_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = rule_table(spark, URL_RULES).where("false")
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert judge_urls(pages.where("false"), rule_table(spark, URL_RULES)).collect() == []


def test_very_long_urls(spark):
    rules = [*URL_RULES, ("block", "d.c.b.a", "/x"), ("allow", "b.a", "/" + "y" * 300), ("block", "", "/z")]
    urls = ["http://" + "n." * 100_000 + "example.org/es/" + "p" * 100_000, "http://" + "d.c.b.a." * 30_000 + "d.c.b.a/xx", "x://b.a/" + "y" * 301, "x://b.a/" + "y" * 299, "x://" + "." * 50_000 + "/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = judge_urls(pages, rule_table(spark, rules)).collect()
    assert time.time() - began < 20
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules)
