import random

import pytest

from lexmill.llm.url_filter import RuleTrie, judge_urls

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"), ("block", "a.b", ""), ("allow", "a.b", "/x"), ("block", "a.b", "/x"),
    ("allow", "a.b", "/x/y"), ("block", "", "/wp-admin"),
]


def brute(host, path):
    fits = [
        (len(h), len(p), a == "block", h + p, a)
        for a, h, p in RULES
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else None


def test_trie_equals_all_rules():
    trie, draw = RuleTrie(RULES), random.Random(1)
    labels = ["a", "b", "net", "example", "com", "org", "", "x"]
    parts = ["", "en", "de", "fr", "x", "y", "xy", "wp-admin", "wp-administrator"]
    for _ in range(4000):
        host = ".".join(draw.choices(labels, k=draw.randint(0, 4)))
        path = draw.choice(["", "/"]) and "/" + "/".join(draw.choices(parts, k=draw.randint(1, 3)))
        assert trie.find(host, path) == brute(host, path), (host, path)


@pytest.mark.parametrize("most", [100, 2])
def test_odd_pages(spark, most):
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme/en/"), (3, "http://X.Example.NET/en/q?x=/de/"), (4, "http://net"),
         (5, "http://net/"), (6, "http://example.net/en#a"), (7, "ftp://q.a.b?z"), (8, "http://u.a.b/xx"),
         (9, "://fr.org/fr/\n"), (9, "://fr.org/fr/\n")],
        "page_id long, url string",
    ).selectExpr("*", "'mine' AS host", "'old' AS rule", "7 AS n")
    got = judge_urls(pages, rules, max_trie_rules=most)
    assert sorted(got.columns) == sorted(["page_id", "url", "n", "host", "path", "rule", "verdict"])
    rows = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.na.fill("-").collect())
    assert rows == [
        (1, "", "", "-", "allow"), (2, "", "", "-", "allow"),
        (3, "x.example.net", "/en/q", "example.net/en/", "allow"), (4, "net", "", "-", "allow"),
        (5, "net", "/", "net/", "block"), (6, "example.net", "/en", "net/", "block"),
        (7, "q.a.b", "", "a.b", "block"), (8, "u.a.b", "/xx", "a.b/x", "block"),
        (9, "fr.org", "/fr/\n", "org/fr/", "allow"), (9, "fr.org", "/fr/\n", "org/fr/", "allow"),
    ]
    assert judge_urls(pages.limit(0), rules, max_trie_rules=most).count() == 0
