import duckdb
import pytest
from pyspark.sql import functions as F

from foldspark.llm import registry, url_filter

URLS = ["http://a.net/x", "http://NET/", "https://net", "http://xnet/", "http://www.Example.NET/en/1?q#f", "http://example.net/EN/", "http://example.com/de/", "http://de.example.com/de", "http://b.org/fr/x", "http://b.org/fr",
        "http://b.org?x=/fr/", "mailto:x", None, "", "://", "http://a.net:80/x", "http:///p", "http://a.b.c.d.net/en/", "x://y://z.net/q", "http://ünï.NET/é?", "http://example.net./en/", "HTTP://a.net\\/x", "http://a.net\n/x", "http://a.net/\n"]


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@pytest.mark.parametrize("n_blocks", [None, 1, 64])
@pytest.mark.parametrize("most", [0, 100])
def test_by_plain_rules(spark, monkeypatch, n_blocks, most):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS extra")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string"), n_blocks=n_blocks).collect()}
    assert got == {k: plain(u, RULES) for k, u in enumerate(URLS)}


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) AS key")
    bloom = url_filter.bloom_filter(keys, 256)
    assert keys.select(F.explode(url_filter.possible(F.array("key"), bloom))).count() == 2000
    others = spark.range(5000).selectExpr("concat('other', id) AS key")
    assert others.select(F.explode(url_filter.possible(F.array("key"), bloom))).count() < 150


def test_a_thousand_shapes_and_long_urls(spark):
    """Rules of 1000 (labels, path characters), URLs of 30 000 characters and repeated rows."""
    rules = [(".".join(["a"] * (1 + k % 10)), "/" + "x" * (k // 10), "block" if k % 3 else "allow") for k in range(1000)]
    urls = [f"http://{'.'.join(['a'] * n)}/{'x' * m}" for n, m in ((1, 0), (3, 7), (12, 55), (10, 99), (4, 120))] + ["http://b/x", "http://" + "a." * 15_000 + "b/", "http://a/" + "x" * 30_000, "http://a/" + "x" * 30_000]
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() if r.rule)
    want = sorted((k, *plain(u, rules)[2:]) for k, u in enumerate(urls) if plain(u, rules)[2])
    assert got == want and len(want) == 7


def test_no_rules_and_no_rows(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(df, none).collect()} == {"allow"}
    odd = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("net", "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    assert {r.rule for r in url_filter.judge(df, odd).collect()} == {None, "net/"}
    assert url_filter.judge(df.limit(0), odd).count() == 0


def test_query_is_its_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = registry.op7_url_filter(spark, sf_dir)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == sorted(c.execute(registry.OP7_SQL).fetchall(), key=str)
