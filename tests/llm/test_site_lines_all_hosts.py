import duckdb

from tidemark.llm import site_lines as sl


def test_small_hosts_lose_their_boilerplate(spark):
    rows = [(10 * n + i, f"http://h{n}.example.com/{i}", f"<p>own {i}</p><p>footer</p>" + "<p>twice here</p>" * 2 * (i == 0)) for n in (1, 2, 3, 4, 5, 7) for i in range(n)]
    got = {r.page_id: (r.n_dropped, r.text) for r in sl.site_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in (1, 2, 3, 4, 5, 7):
        for i in range(n):
            text = [f"own {i}"] + ["footer"] * (n == 1) + ["twice here"] * 2 * (i == 0)
            assert got[10 * n + i] == (int(n > 1), "\n".join(text))


def test_query_equals_sql_and_drops_on_small_hosts(spark, sf):
    sf = sf.replace("0.001", "0.01")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = duck.sql(sl.SQL["op5_site_lines_all_hosts"])
    got = sl.op5_site_lines_all_hosts(spark, sf).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rel.fetchall(), key=str)
    pages = {}
    for r in got:
        pages.setdefault(r.host, []).append(r.n_dropped)
    assert any(len(v) < 5 and sum(v) for v in pages.values())
