import re
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import site_lines as sl

PAGES = "page_id long, url string, html string"


def by_sql(spark, rows, tmp_path, query="op5_site_lines"):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{path}/*.parquet'")
    rel = duck.sql(sl.SQL[query])
    return rel.columns, sorted(rel.fetchall(), key=str)


def test_boilerplate_goes(spark):
    page = lambda i: f"<html><nav>Menu &amp; more</nav><script>var t='</p>';</script><p>text {i} of <b>its</b> own</p><!-- no --><footer>(c)  host</footer></html>"
    rows = [(i, f"HTTP://Shop.example.com:80/p/{i}", page(i)) for i in range(6)] + [(None, "http://small.example.com/", page(9)), (7, None, None), (7, "nonsense", ""), (8, "http://shop.example.com/x", "<p>Menu & more</p>" * 3)]
    got = {(r.page_id, r.host): r for r in sl.site_lines(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 9
    one = got[(3, "shop.example.com")]
    assert (one.n_lines, one.n_dropped, one.text) == (3, 2, "text 3 of its own")
    assert got[(None, "small.example.com")].n_dropped == 0 and got[(8, "shop.example.com")].text == "" and got[(8, "shop.example.com")].n_dropped == 3
    assert got[(7, "")].n_lines == 0


def test_ratio_is_a_strict_limit(spark):
    """On 10 pages, a line on 3 of them is at the ratio of 0.3 and stays, one on 4 goes."""
    rows = [(i, "http://h.example/", f"<p>own {i}</p>" + "<p>three</p>" * (i < 3) + "<p>four</p>" * (i < 4)) for i in range(10)]
    got = {r.page_id: r.text.split("\n") for r in sl.site_lines(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(("three" in got[i]) == (i < 3) and "four" not in got[i] and f"own {i}" in got[i] for i in range(10))


@pytest.mark.parametrize("limit", [sl.BROADCAST_BYTES, 1200, -1])
def test_ways_to_join_agree(spark, monkeypatch, limit):
    """All hosts broadcast, heavy ones only, none: always what a plain count says; clashing columns are ignored."""
    monkeypatch.setattr(sl, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(sl, "HEAVY_HOSTS", 3)  # the first host has more than a third of the pages
    rows = [(i, f"http://h{0 if i % 2 else i % 14}.example/{i}", f"<li>own {i}<li>all<li>mod {i % 3}") for i in range(200)] + [(5, None, "<p>x</p>")] * 2
    docs = spark.createDataFrame([(*r, "clash", 1, "h") for r in rows], f"{PAGES}, host string, pages long, lines string")
    pages, on = defaultdict(int), defaultdict(int)
    lines = [[x for x in re.split("<.*?>", h) if x] for _, _, h in rows]
    host = lambda u: u.split("/")[2] if u else ""
    for (_, u, _), ls in zip(rows, lines, strict=True):
        pages[host(u)] += 1
        for x in set(ls):
            on[host(u), x] += 1
    bad = lambda u, x: on[host(u), x] >= 2 and on[host(u), x] > 0.3 * pages[host(u)]
    want = sorted((i, host(u), "\n".join(x for x in ls if not bad(u, x))) for (i, u, _), ls in zip(rows, lines, strict=True))
    assert sorted((r.page_id, r.host, r.text) for r in sl.site_lines(docs).collect()) == want


def test_hostile_pages_equal_sql(spark, tmp_path):
    """Unclosed tags, scripts and comments of a megabyte take no longer than any others."""
    long = ["<" * 1_000_000, "<script>" * 120_000, "<!-- " * 200_000, "<p " * 300_000, "word " * 200_000 + "</p>", "<style>" * 9 + "</style>tail", "a < b <b>c</b> > d <i", "&amp;lt; \t x\x0by  "]
    rows = [(i, "http://h.example/", h) for i, h in enumerate(long)] + [(None, None, None), (9, "ftp://u:p@Host:21/x", "<P>one<br/>two<hr>")] * 2
    columns, want = by_sql(spark, rows, tmp_path)
    got = sl._digests(sl.site_lines(spark.createDataFrame(rows, PAGES))).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_empty_table(spark):
    assert sl.site_lines(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0
