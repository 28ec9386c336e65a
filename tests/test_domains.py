"""Registered domains by suffix rules."""

import pytest

from tidings.operators.domains import registered_domains, suffix_table

RULES = ["com", "pl", "com.pl", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "// a comment", "", " CO.NZ "]
HOSTS = {
    "a.com.pl": "a.com.pl", "x.a.com.pl": "a.com.pl", "com.pl": None, "b.pl": "b.pl", "www.News.co.UK": "news.co.uk", "news.co.uk.": "news.co.uk",
    "x.y.ck": "x.y.ck", "z.x.y.ck": "x.y.ck", "y.ck": None, "www.ck": "www.ck", "a.www.ck": "www.ck", "c.kobe.jp": None, "d.c.kobe.jp": "d.c.kobe.jp",
    "city.kobe.jp": "city.kobe.jp", "e.city.kobe.jp": "city.kobe.jp", "shop.co.nz": "shop.co.nz", "un.listed": "un.listed", "a.un.listed": "un.listed",
    "localhost": None, "10.0.0.1": None, "": None, None: None, "[::1]": None,
}


@pytest.mark.parametrize("hot_rows", [2_000_000, 2])
def test_rules(spark, hot_rows):
    hosts = [*HOSTS, "a.com.pl", None]
    df = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(hosts)], "i int, host string, domain string")
    rules = spark.createDataFrame([(r,) for r in RULES] + [(None,), ("com",)], "rule string")
    got = {r.i: r.domain for r in registered_domains(df, "host", rules, hot_rows=hot_rows).collect()}
    assert got == {i: HOSTS[h] for i, h in enumerate(hosts)}


def test_empty_tables(spark):
    rules = spark.createDataFrame([("com",)], "rule string")
    df = spark.createDataFrame([(1, "a.b.com")], "i int, host string")
    assert registered_domains(df.limit(0), "host", rules).collect() == []
    assert registered_domains(df, "host", rules.limit(0)).first()["domain"] == "b.com"
    assert suffix_table(rules.limit(0), "rule").collect() == []
