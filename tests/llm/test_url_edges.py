"""Rules that don't parse, long URLs, and the default rules on their own kinds of URLs."""

import time

import pytest

from confluo.llm import url_rules


def test_a_bad_rule_is_left_out(spark):
    pages = spark.createDataFrame([(1, "http://x.example/a(b"), (2, "http://ok.example/")], "page_id long, url string")
    got = {r.page_id: r.blocked for r in url_rules.filter_urls(pages, ["/a(b/", None, "/[/", "||ok.example^"]).collect()}
    assert got == {1: False, 2: True}


def test_long_urls():
    rules = url_rules.parse_all([*url_rules.DEFAULT_RULES, "a***b***c^"])
    m = url_rules.Matcher(rules, *url_rules.build_index(rules, {}))
    began = time.perf_counter()
    assert m.match("http://x.example/" + "a/b-" * 50_000)[0] is None
    assert m.match("http://x.example/" + "q/" * 100_000 + "porn/1")[0] is not None
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("url, blocked", [
    ("http://ads.example.com/x", True), ("https://www.bestcasino.example/", True), ("http://x.example/wp-login.php", True), ("http://x.example/p?affiliate=7", True), ("http://x.example/robots.txt", False), ("http://casino.example/robots.txt", False),
    ("http://cs.some.edu/ads/1", False), ("https://example.org/essex", False), ("https://blog.example.org/adsorption/of/gases", False), ("https://tracker-jacker.example/", False), ("", False),
])
def test_default_rules(url, blocked):
    rules = url_rules.parse_all(url_rules.DEFAULT_RULES)
    assert len(rules) == len(url_rules.DEFAULT_RULES)
    rule, exception = url_rules.Matcher(rules, *url_rules.build_index(rules, {})).match(url)
    assert (rule is not None and exception is None) == blocked
