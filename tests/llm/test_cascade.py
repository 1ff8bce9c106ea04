import pytest
from pyspark.sql import functions as F

from martlet.llm import cascade


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_membership_is_exact_over_the_universe(spark):
    universe = [f"host{i}.example" for i in range(5000)]
    listed = universe[::37] + ["elsewhere.example", None]
    fitted = cascade.Cascade.fit(keys(spark, listed), keys(spark, universe))
    assert len(fitted.levels) > 1
    got = keys(spark, universe).withColumn("m", fitted.holds(F.col("key"))).collect()
    assert {r["key"] for r in got if r["m"]} == set(universe[::37])


def test_nothing_listed_and_empty_universe(spark):
    none = cascade.Cascade.fit(keys(spark, []), keys(spark, ["a"]))
    assert not keys(spark, ["a"]).select(none.holds(F.col("key"))).first()[0]
    alone = cascade.Cascade.fit(keys(spark, ["a"]), keys(spark, []))
    assert keys(spark, ["a"]).select(alone.holds(F.col("key"))).first()[0]


def test_a_list_beyond_the_bound_is_refused():
    with pytest.raises(ValueError):
        cascade.Bloom(1, 10**9, 0.001)


def test_rules_hosts_and_malformed_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block")], "host string, path string, verdict string")
    urls = ["http://A.example.NET/en/x?q", "http://example.net", "https://xexample.net/en/", "http://a.example.com/de/", "http://example.com/dex", None,
            "no scheme", "http://my-casino.org/", "a://b://net/", "http://net/"]
    pages = spark.createDataFrame([(i, u, "extra", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, listed string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in cascade.judge(pages, rules, ["casino"]).collect()}
    assert got == {0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"), 2: ("xexample.net", "/en/", "net/", "block"),
                   3: ("a.example.com", "/de/", "example.com/de/", "block"), 4: ("example.com", "/dex", None, "allow"), 5: ("", "", None, "allow"),
                   6: ("", "", None, "allow"), 7: ("my-casino.org", "/", None, "block"), 8: ("b:", "//net/", None, "allow"), 9: ("net", "/", "net/", "block")}
    assert cascade.judge(pages.limit(0), rules, ["casino"]).collect() == []
