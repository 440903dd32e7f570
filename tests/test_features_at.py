import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import skew

START = dt.datetime(2024, 1, 1)
SCHEMA = "customer string, occurred_at timestamp_ntz, event_type string, value double"
OPTIONS = dict(customer="customer", timestamp="occurred_at", type_column="event_type", value_column="value", windows=(2, 7, 30))


def log(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = "A" if rng.random() < 0.5 else rng.choice("BCD")
        t = START + dt.timedelta(hours=rng.choice([rng.randrange(0, 24 * 80), 24 * rng.randrange(80)]), microseconds=rng.choice([0, 0, 1]))
        rows.append((c, t, rng.choice(["login", "buy"]), rng.choice([None, 1.5, 20.0])))
    return rows + [("A", None, "login", 1.0), (None, START, "buy", 1.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_running_sums_equal_the_join(spark, seed):
    """Instants at events, at window edges, before and after all events, of customers without events, and repeated."""
    rows = log(seed)
    events = spark.createDataFrame(rows, SCHEMA)
    rng = random.Random(seed)
    some = [(c, t) for c, t, *_ in rows if c and t][:60] + [(c, t + dt.timedelta(days=rng.choice([2, 7, 30]))) for c, t, *_ in rows if c and t][60:90] + [("Z", START), ("A", START - dt.timedelta(days=9)), ("B", START + dt.timedelta(days=200)), ("A", START)]
    instants = spark.createDataFrame([*some, some[0]], "customer string, as_of timestamp_ntz")
    got = ft.features_at(events, instants, **OPTIONS)
    want = ft.build_features(events, as_of=instants.distinct(), groups=ft.RUNNING_GROUPS, check=False, **OPTIONS).features
    assert set(got.columns) == set(want.columns) - {"source_ts"}
    of = lambda df: {(r.customer, r.as_of): r.asDict() for r in df.select(*got.columns).collect()}
    a, b = of(got), of(want)
    assert a.keys() == b.keys() == set(some)
    for k in b:
        for name in set(got.columns) - {"customer", "as_of"}:
            assert a[k][name] == pytest.approx(b[k][name]), (k, name)


def test_empty_and_unknown(spark):
    events = spark.createDataFrame(log(3, 20), SCHEMA)
    none = spark.createDataFrame([], "customer string, as_of timestamp_ntz")
    assert ft.features_at(events, none, **OPTIONS).count() == 0
    one = spark.createDataFrame([("A", START)], "customer string, as_of timestamp_ntz")
    assert ft.features_at(events.limit(0), one, types=["buy"], **OPTIONS).first().events_buy_7d == 0
    with pytest.raises(ValueError, match="gaps"):
        ft.features_at(events, one, groups=("counts", "gaps"), **OPTIONS)


def naive_gap(times, as_of, w):
    ages = sorted(a for t in times if 0 < (a := (as_of - t).total_seconds() / 86400) <= w)
    edges = [0.0, *ages, float(w)]
    return max(b - a for a, b in zip(edges, edges[1:], strict=False))


def test_gaps_by_hours(spark):
    rng = random.Random(8)
    as_of = START + dt.timedelta(days=40)
    exact = [as_of - dt.timedelta(days=k) for k in (0, 2, 7, 30)] + [as_of - dt.timedelta(hours=k) for k in (1, 2, 3, 47, 49)] + [as_of - dt.timedelta(days=7, microseconds=1)]
    people = {"exact": exact, "none": [], "late": [as_of + dt.timedelta(days=1)], "old": [as_of - dt.timedelta(days=31)], "one": [as_of - dt.timedelta(days=3)]}
    people |= {f"r{i}": [as_of - dt.timedelta(seconds=rng.uniform(-1e5, rng.choice([1e4, 1e6, 4e6]))) for _ in range(rng.randrange(60))] for i in range(12)}
    events = spark.createDataFrame([(c, t, "x", 1.0) for c, ts in people.items() for t in ts], SCHEMA)
    asked = spark.createDataFrame([(c, as_of) for c in people], "customer string, as_of timestamp_ntz")
    out = ft.build_features(events, as_of=asked, groups=("gaps",), **OPTIONS).features.collect()
    assert {r.customer for r in out} == set(people)
    for r in out:
        for w in (2, 7, 30):
            assert r[f"longest_gap_{w}d"] == pytest.approx(naive_gap(people[r.customer], as_of, w)), (r.customer, w)


def test_heavy_customer_is_dealt_to_several_tasks(spark, monkeypatch):
    """A customer with half the log, in a population too large to broadcast: no task has all its rows."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(skew, "HEAVY", 10)
    rows = spark.range(8000).select(F.when(F.col("id") % 2 == 0, "A").otherwise(F.concat(F.lit("c"), F.col("id") % 300)).alias("customer"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"), F.lit(True).alias("hit"))
    rows = rows.repartition(8)
    people = spark.createDataFrame([("A",), *((f"c{i}",) for i in range(400))], "customer string").withColumn("as_of", F.lit("2024-02-01").cast("timestamp_ntz"))
    joined = skew.join_skewed(rows, people, "customer")
    by_task = joined.where("customer = 'A'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 4000 and max(r["count"] for r in by_task) < 1500
    assert joined.count() == 8000
