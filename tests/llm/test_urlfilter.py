import duckdb
import pytest

from pvloss.llm import urlfilter, urlfilter_queries

ROWS = [
    (1, "http://a.example.net/x", '<link href="https://B.com/de/9" rel=canonical>'),  # alias of a blocked url
    (2, "https://a.example.net/x/?utm_source=q#t", None),  # alias of 1 by form
    (3, "http://c.example.net/y", "<META http-equiv='Refresh' content='0; url=/x2'>"),
    (4, "http://c.example.net/x2", '<link rel="canonical" href="//a.example.net/x">'),
    (5, "http://free.org/z", '<link rel="canonical" href="http://a.example.net/x">'),  # own allow rule wins
    (6, "http://d.example.net/q?ref=1&a=2", ""),
    (7, "no scheme", '<link rel="canonical" href="http://a.example.net/x">'),
    (8, None, None),
    (None, "HTTP://Sub.EXAMPLE.org/en/17?x#y", None),
    (10, "x://example.org", None),
    (11, "http://org/es/", None),
    (12, "http://notexample.org/es/1", None),
    (6, "http://d.example.net/q?ref=1&a=2", ""),
    (13, "http://e.example.net/" + "l" * 90_000, None),
    # Pages of one host that have nothing to do with each other: one is an alias of a blocked url.
    (20, "http://h.example.net/bad", '<link rel="stylesheet" href="a.css"><link class=x rel="alternate canonical" href=\'http://s.com/de/7\'>'),
    (21, "http://h.example.net/good", '<meta http-equiv=refresh content="5"><a href="http://s.com/de/7">'),
    (22, "http://h.example.net/zzz", None),
    (23, "http://h.example.net/?q=x", '<link rel=canonical data-href="http://s.com/de/7" href="#top"><link rel=canonical href="mailto:a@b.c">'),
    (24, "http://h.example.net", None),
    # A second tag counts, relative targets are resolved, chains go over hosts.
    (25, "http://i.example.net/a/b/c?x", '<link rel=canonical><LINK REL="Canonical" HREF="../p/./q?k=1&amp;j=2">'),
    (26, "http://i.example.net/a/p/q?k=1&j=2#f", '<meta content="0;URL=\'?go=1\'" http-equiv="refresh">'),
    (27, "http://i.example.net/a/p/q?go=1", '<link rel="canonical" href="r">'),
    (28, "https://I.example.net/a/p/r/", '<link rel="canonical" href="//h.example.net/bad">'),
    (29, "http://i.example.net/a/p/q?go=2", None),
    (30, "http://i.example.net/a/p/q", '<link rel="canonicality" href="r">'),
]
WANT = {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", None: "block", 10: "allow", 11: "allow", 12: "allow", 13: "allow", **dict.fromkeys([20, 25, 26, 27, 28], "block"), **dict.fromkeys([21, 22, 23, 24, 29, 30], "allow")}


@pytest.mark.parametrize("inline", [500, 0])
def test_aliases_and_rules(spark, monkeypatch, tmp_path, inline):
    monkeypatch.setattr(urlfilter, "INLINE_RULES", inline)
    spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, key string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urlfilter_queries.op9_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS) and {r.page_id: r.verdict for r in got} == WANT
    assert {r.page_id: r.rule for r in got if r.rule} == {5: "org/", None: "example.org/en/1", 11: "org/", 12: "org/"}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, con.execute(urlfilter_queries.ORACLE).fetchall()), key=key) == sorted(map(tuple, got), key=key)


def test_redirect_table_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://q.net/a", None)], "page_id long, url string, html string")
    rules = spark.createDataFrame(urlfilter_queries.RULES, "verdict string, host string, path string")
    to = spark.createDataFrame([("http://q.net/a", "http://r.net/b"), ("http://r.net/b", "http://s.com/de/1"), (None, "http://t.net")], "url string, target string")
    assert [r.verdict for r in urlfilter.judge(pages, rules, to).collect()] == ["block"]
    assert [r.verdict for r in urlfilter.judge(pages, rules.limit(0)).collect()] == ["allow"]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
