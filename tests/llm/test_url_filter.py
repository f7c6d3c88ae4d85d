"""The cascade says of every key of the universe what the list says; URLs get the rule that plain search finds."""

import random

import pytest
from pyspark.sql import functions as F

from mixolve.llm.url_filter import build, judge, key_hashes


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in ((v, h.lower() if h else h, p or "") for v, h, p in rules) if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("listed,others", [(300, 20000), (5000, 5000), (3000, 10), (1, 1), (7, 0), (0, 20)])
def test_every_key_of_the_universe_is_told_right(spark, listed, others):
    keys = [f"k{i}" for i in range(listed)]
    universe = keys[::2] + [f"o{i}" for i in range(others)] + keys[:1]
    frame = lambda k: spark.createDataFrame([(x,) for x in k], "key string")
    cascade = build(frame([*keys, None]), frame([*universe, None]))
    h1, h2 = key_hashes(F.col("key"))
    asked = frame(universe).select("key", h1.alias("h1"), h2.alias("h2")).toPandas()
    assert cascade.listed(asked.h1.to_numpy("int64"), asked.h2.to_numpy("int64")).tolist() == [k.startswith("k") for k in asked.key]
    if listed and others:
        assert len(cascade.levels) > 1 or others < 50
        assert cascade.size < 64 * len(cascade.levels) + 4 * (listed + others)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "Example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.org", None), ("allow", None, "/"), ("block", "", "/"), ("block", "org", "/fr/"), ("block", "com", "/d")]


@pytest.mark.parametrize("how", [{}, {"block_rows": 2, "default": "block"}])
def test_urls_as_by_plain_search(spark, how):
    rng = random.Random(2)
    hosts = ["net", "x.net", "example.net", "WWW.Example.NET", "notexample.net", "example.com", "b.example.com", "org", "a.org", "z.a.org", ".net", "a..net", "net.", "user@net:80", "ex\u00c4.org", ""]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/de/", "/de/1#/en/", "/fr/", "/FR/", "?q=/en/", "#top", "/d", "/en/\u00e9\n/x", "/" + "long/" * 3000]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "", "a:/", "http://http://") for h in hosts for p in paths] + [None, "", "://", "http:/net/"]
    rng.shuffle(urls)
    rows = [(i, u, i, "v", None) for i, u in enumerate([*urls, *urls[:20]])]
    frame = spark.createDataFrame(rows, "page_id long, url string, _best int, verdict string, host string")
    got = judge(frame, spark.createDataFrame(RULES, "verdict string, host string, path string"), **how)
    assert got.columns == ["page_id", "url", "_best", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, RULES, how.get("default", "allow")), r.url
    assert got.count() == len(rows)


def test_empty_tables_and_too_many_shapes(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    rules = spark.createDataFrame(RULES, none.schema)
    urls = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert judge(urls.limit(0), rules).count() == 0
    assert [(r.rule, r.verdict) for r in judge(urls, none).collect()] == [(None, "allow")]
    with pytest.raises(ValueError):
        judge(urls, rules, most_shapes=2)
