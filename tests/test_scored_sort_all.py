from tidemark.operators import scoring
from tidemark.plans import catalogue


def test_every_customer_has_its_place(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").collect()
    want = sorted(((min(1.0, max(0.0, (r.c_acctbal + 1000.0) / 11000.0)), r.c_custkey) for r in customers), key=lambda x: (-x[0], x[1]))
    got = sorted(catalogue.queries()["scored_sort_all"](spark, sf).collect())
    assert len(want) > 100 and [(r.place, r.c_custkey) for r in got] == [(i + 1, k) for i, (_, k) in enumerate(want)]


def test_places_over_partitions(spark):
    rows = spark.range(5000).selectExpr("id as k", "(id * 7919 % 50) / 50.0D as p").repartition(7)
    want = sorted(((r.p, r.k) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    got = sorted((r.place, r.p, r.k) for r in scoring.placed(rows, "p", "k").collect())
    assert got == [(i + 1, p, k) for i, (p, k) in enumerate(want)]
    assert scoring.placed(rows.limit(0), "p", "k").count() == 0
