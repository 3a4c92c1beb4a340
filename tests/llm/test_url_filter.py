import duckdb

from skyframe.llm import url_filter
from skyframe.llm.common import ORACLES, QUERIES

PAGES = [
    (1, None), (2, "no scheme"), (3, "http://Example.ORG/es/x?y"), (4, "https://a.example.org/en/17#t"), (5, "https://a.example.org/en/27"), (6, "http://b.org"), (7, "http://x.com/de/3"),
    (8, "http://x.com/fr/3"), (9, "http://x.com/it/3"), (9, "http://x.com/it/3"), (10, ""), (11, "http://co.uk/1://2"), (12, "http://a.b.co.uk:80/en/1"), (13, "http://notorg/"), (14, "http://net.net/en/6"),
]


def test_rules_and_parts(spark, tables):
    labels = [(3, 1, 0), (6, 0, 0), (17, 1, 1), (None, 1, 0), (27, None, 0)]
    root = tables(pages=spark.createDataFrame([(*p, "h") for p in PAGES], "page_id long, url string, html string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = QUERIES["op4_url_filter"](spark, root).collect()
    got = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == got[2] == ("", "", None) and got[3] == ("example.org", "/es/x", "example.org/es/")
    assert got[4][2] == "example.org/en/1" and got[5][2] == "org/" and got[6] == ("b.org", "", None)
    assert got[7][2] == "com/de/" and got[8][2] == "com/fr/" and got[9][2] is None and got[13][2] is None
    verdicts = {r.page_id: r.verdict for r in rows}
    assert verdicts[3] == verdicts[4] == verdicts[7] == "block" and verdicts[5] == verdicts[8] == "allow"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet/*.parquet'")
    res = con.execute(ORACLES["op4_url_filter"])
    names = [d[0] for d in res.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(res.fetchall(), key=key)


def test_reputation_shrinks_along_the_chain(spark):
    hosts = [("bad.site.net", 60, 3), ("new.site.net", 0, 0), ("good.fine.net", 80, 78), ("other.fine.net", 1, 0), ("big.org", 500, 450)] + [(f"h{i}.d{i % 7}.com", 40, 30 + i % 10) for i in range(40)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(hosts, "host string, n long, s long")).collect()}
    assert got["bad.site.net"].bound < 0.5 < got["good.fine.net"].bound
    assert got["bad.site.net"].rate < got["new.site.net"].rate < got["good.fine.net"].rate
    assert got["other.fine.net"].rate > 0.3
    assert all(r.bound < r.rate for r in got.values())


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([], "host string, good int")).count() == 0
