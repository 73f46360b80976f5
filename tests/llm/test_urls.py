import random

import duckdb
import pytest

from tidemark.llm import urls
from tidemark.llm.urls import OP5_SQL, RULES, judge_urls, op5_url_filters


def plain(url, rules=RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "http:///x", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/",
        "https://a.example.com/en", "https://example.com/EN/", "http://xexample.com/en/", "http://www.example.com/en/1", "http://m.www.example.com/en/1",
        "x://net/es/1", "x://a.net/fr/", "x://a.net/fr", "x://net?/es/", "x://net#/es/", "http://u:p@www.example.com/en/", "http://example.com:80/en/",
        "http://a..com/", "http://.com/", "http://ÄB.com/Ä/", "a://b://net/es/", "http://x.com/a//b/", "http://x.com\n/en/", "http://" + "a." * 300 + "net/es/" + "d/" * 300]


@pytest.mark.parametrize("limit", [urls.BROADCAST_RULES, -1])
def test_same_as_the_plain_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    r = random.Random(4)
    some = [f"{r.choice(['http', 'x'])}://{'.'.join(r.choices(['www', 'example', 'com', 'net', 'a'], k=r.randint(1, 4)))}"
            f"{r.choice(['', '/', '/en/', '/es/', '/fr/q', '/en/es/'])}{r.choice(['', '?a=/en/', '#x'])}" for _ in range(150)]
    rules = RULES + [("block", "a.com", "/en"), ("allow", "a.com", "/en"), ("allow", "", "/"), ("block", None, "/"), ("block", "EXAMPLE.net", "/q/r")]
    rows = [(i // 2, u, "h", "p") for i, u in enumerate(URLS + some + some[:5])]  # keys and rows repeat
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    got = sorted(map(tuple, judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()), key=str)
    known = [(v, h.lower(), p) for v, h, p in rules if h is not None]
    assert got == sorted(((i, *plain(u, known)) for i, u, *_ in rows), key=str)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/es/")], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert tuple(judge_urls(pages, rules).first()) == (1, "net", "/es/", None, "allow")
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want = sorted(con.execute(OP5_SQL).fetchall(), key=str)
    assert sorted(map(tuple, op5_url_filters(spark, folder).collect()), key=str) == want
