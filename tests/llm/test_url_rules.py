"""URL rules (11) against a plain loop over all rules."""

import random
import re
from collections import Counter

import pytest

from chalkline.llm import url_rules


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def verdict(url, rules):
    host, path = parts(url)
    fit = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
        if h is not None and p is not None and v in ("allow", "block") and (h in ("", host) or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


ODD = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1", "http://example.com/EN/", "http://a.net/es/?x#y",
    "http://net/es/", "http://x.netx/es/", "http://example.com?/en/", "http://example.com#://com/", "http://u:p@b.com:80/en/", "http://ÄB.com/", "http://.com/en/",
    "http://com./en/", "http://" + "a." * 3000 + "example.com/en/" + "x" * 50_000, "x\n://a.com/\nb?c", "http://日本.net/fr/", "http://..net/fr/1",
]


@pytest.fixture(scope="module")
def urls():
    rnd = random.Random(11)
    labels = ["a", "b", "a-b", "aa", "com", "net", "example"]
    made = ["http://" + ".".join(rnd.choices(labels, k=rnd.randint(1, 5))) + rnd.choice(["", "/", "/en/", "/en/x", "/e", "/es/"]) for _ in range(600)]
    return [(i, u) for i, u in enumerate(ODD + made + ["http://hot.example.com/en/1"] * 300)] + [(None, "http://a.com/"), (7, "http://a.com/"), (7, "http://a.com/")]


GIVEN = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MANY = [
    *GIVEN, ("a.com", "/en/", "block"), ("a.com", "/en/", "allow"), ("a.com", "/en/x", "allow"), ("COM", "/e", "block"), ("a.a.com", "", "block"), ("", "/es", "block"),
    ("", "/en/xyz", "block"), ("a-b.com", "/", "block"), (None, "/", "block"), ("b", None, "block"), ("b", "/", None), ("b", "/", "other"), ("b.net", "/en/", "block"), ("a.b.net", "/", "allow"),
]


@pytest.mark.parametrize("rules", [GIVEN, MANY, []])
@pytest.mark.parametrize("ranges", ["8", "61"])
def test_verdicts(spark, urls, rules, ranges):
    pages = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in urls], "page_id long, url string, host string, rule string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = Counter(map(tuple, url_rules.filter_urls(pages, table).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lowered = [(None if h is None else h.lower(), p, v) for h, p, v in rules]
    assert got == Counter((i, *verdict(u, lowered)) for i, u in urls)


def test_a_hot_host_is_split(spark):
    pages = spark.range(20_000).selectExpr("id AS page_id", "'http://hot.example.com/en/1' AS url")
    table = spark.createDataFrame(GIVEN, "host string, path string, verdict string")
    rows = url_rules.filter_urls(pages, table)
    sizes = [r["count"] for r in rows.selectExpr("spark_partition_id() AS p", "verdict").groupBy("p", "verdict").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2.5 * 20_000 / 8


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.filter_urls(pages, spark.createDataFrame(GIVEN, "host string, path string, verdict string")).collect() == []
