import random

import pytest
from pyspark.sql import functions as F

from envlattice.llm import urlfilter
from tests.llm.oracle import assert_same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    assert_same(spark, "op7_url_filter", f"/root/testdata/{sf}")


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0,), (len(rule), len(h), rule, verdict))
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("bits", [urlfilter.MAX_BITS, 400])
def test_many_rules(spark, monkeypatch, bits):
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)
    rng = random.Random(0)
    label = lambda: rng.choice("abcd") * rng.randint(1, 2)
    rules = {}
    for _ in range(300):
        rule = ".".join(label() for _ in range(rng.randint(1, 3))) + "/" + "".join(label() + "/" for _ in range(rng.randint(0, 2)))
        rules[rule] = rng.choice(["block", "allow"])
    urls = [f"{rng.choice(['http', 'X', ''])}://{'.'.join(label() for _ in range(rng.randint(1, 5)))}{rng.choice(['', '?', '#', '/', '/x'])}"
            + "/".join(label() for _ in range(rng.randint(0, 4))) + rng.choice(["", "?a=/b/", "#/", "/"]) for _ in range(3000)]
    urls += [None, "", "x", "a.b/c", "://", "http://", "http:///a/", "http://A.B/a/b/", "http://b\n/a/", "http://" + "a." * 50_000 + "b/" + "c/" * 50_000, "http://é.a/b/"]
    df = spark.createDataFrame([(i, u, "x", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    found = urlfilter.judge(df, spark.createDataFrame(list(rules.items()), "rule string, verdict string"))
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: brute(u, list(rules.items())) for i, u in enumerate(urls)}


def test_thousands_of_rules_in_parts(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BITS", 1 << 15)
    rules = [(f"h{i}.x{i % 7}/" + "abc/" * (i % 3), "block" if i % 2 else "allow") for i in range(6000)]
    urls = [(i, f"http://www.h{i}.x{i % 7}/abc/abc/q") for i in range(12_000)]
    urls += urls[:500]  # repeated rows
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = sorted(((r.row.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()), key=str)
    fits = dict(enumerate(rules))
    assert got == sorted(((i, *fits.get(i, (None, "allow"))) for i, _ in urls), key=str)


def test_cascade_is_exact(spark):
    universe = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0").unionAll(spark.createDataFrame([("elsewhere",)], "key string"))
    cascade = urlfilter.Cascade.of(listed, universe, 200_000)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.holds(F.col("key")) != F.expr("hash(key) % 7 = 0"))
    assert wrong.count() == 0


def test_no_rules_no_urls(spark):
    df = spark.createDataFrame([(1, "http://a/b/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    some = spark.createDataFrame([("a/", "block")], "rule string, verdict string")
    assert [tuple(r)[1:] for r in urlfilter.judge(df, none).collect()] == [("a", "/b/", None, "allow")]
    assert urlfilter.judge(df.limit(0), some).count() == 0
    for bad in ("a", "/a/", "a/b", None):
        with pytest.raises(ValueError, match="slash"):
            urlfilter.judge(df, spark.createDataFrame([(bad, "block")], "rule string, verdict string"))
