import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitoring as mo

START = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def plain_label(events, customer, as_of, end, horizon, lookback):
    if customer is None or as_of is None:
        return None, None, "no_instant"
    times = [t for c, t in events if c == customer and t is not None and t <= end]
    last, nxt = max((t for t in times if t <= as_of), default=None), min((t for t in times if t > as_of), default=None)
    if as_of > end:
        return last, nxt, "after_observation"
    if last is None:
        return last, nxt, "never_active"
    if lookback is not None and last < as_of - lookback:
        return last, nxt, "already_inactive"
    if nxt is not None and nxt <= as_of + horizon:
        return last, nxt, "active"
    return last, nxt, "censored" if as_of + horizon > end else "inactive"


@pytest.mark.parametrize("lookback", [None, 3 * DAY])
def test_inactivity_equals_definition(spark, lookback):
    rng = random.Random(6)
    events = [("A" if rng.random() < 0.5 else rng.choice("BC"), START + rng.randrange(60) * DAY / 2) for _ in range(40)] + [("A", None), (None, START), ("D", START + 25 * DAY)]
    instants = [(rng.choice("ABCDE"), START + rng.randrange(-2, 70) * DAY / 2) for _ in range(120)] + [(None, START), ("A", None), ("B", START + 20 * DAY), ("B", START + 20 * DAY)]
    end, horizon = START + 20 * DAY, 2 * DAY
    log, asked = spark.createDataFrame(events, "who string, t timestamp_ntz"), spark.createDataFrame(instants, "customer string, as_of timestamp_ntz")
    rows = mo.label_inactivity(log, asked, customer="who", timestamp="t", horizon=horizon, observation_end=end, lookback=lookback).collect()
    assert len(rows) == len(set(instants))
    for r in rows:
        assert (r.last_event, r.next_event, r.outcome) == plain_label(events, r.customer, r.as_of, end, horizon, lookback), r
        assert r.label == {"active": 0, "inactive": 1}.get(r.outcome)
    assert len({r.outcome for r in rows}) == (7 if lookback else 6)


def test_drift(spark):
    rng = np.random.default_rng(2)
    old = spark.createDataFrame([(float(x), 1.0, None) for x in rng.normal(size=500)], "a double, b double, c double")
    new = spark.createDataFrame([(float(x), 1.0, None) for x in rng.normal(size=300)] + [(float("nan"), 2.0, 5.0), (99.0, None, None)], "a double, b double, c double")
    rows = mo.drift(old, new, ["a", "b", "c"]).collect()
    a = sorted((r for r in rows if r.column == "a"), key=lambda r: r.bin)
    assert [r.bin for r in a] == [-1, *range(10)] and [r.n_baseline for r in a] == [0] + [50] * 10 and sum(r.n_current for r in a) == 302
    values = sorted(r.a for r in old.collect())
    assert a[10].n_current == sum(r.a >= values[450] or r.a > values[449] for r in new.collect() if r.a is not None and r.a == r.a)
    assert {(r.bin, r.n_baseline, r.n_current) for r in rows if r.column == "b"} == {(0, 500, 300), (9, 0, 1), (-1, 0, 1)}
    assert {(r.bin, r.n_baseline, r.n_current) for r in rows if r.column == "c"} == {(-1, 500, 301), (0, 0, 1)}
    same = sum(r.psi for r in mo.drift(old, old, ["a", "b", "c"]).collect())
    assert same == 0 and sum(r.psi for r in a) > 0


def test_delayed_labels(spark):
    at = lambda d: START + d * DAY
    predictions = [(1, at(0), 0.1), (1, at(5), 0.2), (1, at(9), 0.3), (2, at(0), 0.4), (2, at(8), 0.5), (None, at(1), 0.6), (3, at(30), 0.7), (1, at(0), 0.1)]
    outcomes = [(1, at(3), 0), (1, at(7), 1), (1, at(12), 0), (1, at(7), 0), (2, None, 1), (2, at(9), None), (3, at(31), 1), (None, at(2), 1)]
    p, o = spark.createDataFrame(predictions, "id long, predicted_at timestamp_ntz, p double"), spark.createDataFrame(outcomes, "id long, known_at timestamp_ntz, y int")
    got = sorted((r.id or 0, r.p, r.known_at, r.y, r.state) for r in mo.matured(p, o, at(10), 5 * DAY).collect())
    assert got == [(0, 0.6, None, None, "unlabelled"), (1, 0.1, at(7), 1, "labelled"), (1, 0.1, at(7), 1, "labelled"), (1, 0.2, at(7), 1, "labelled"), (1, 0.3, None, None, "pending"), (2, 0.4, None, None, "unlabelled"), (2, 0.5, None, None, "pending")]
    later = {(r.id, r.p): r.y for r in mo.matured(p, o, at(40), 5 * DAY).collect()}
    assert later[1, 0.1] == later[1, 0.3] == 0 and later[3, 0.7] == 1


def test_bootstrap_tells_better_from_equal(spark):
    rows = spark.range(1200).select("id", (F.col("id") % 3 == 0).cast("double").alias("y"))
    rows = rows.withColumns({"good": 0.4 + 0.2 * F.col("y"), "bad": F.lit(0.4), "same": F.when(F.col("id") % 2 == 0, F.col("y") * 0.2 + 0.3).otherwise(0.4)})
    better = mo.paired_bootstrap(rows, "id", "y", "bad", "good", n=60)
    v = mo.verdict(better).first()
    assert v.low <= v.gain <= v.high and v.promoted
    worse = mo.verdict(mo.paired_bootstrap(rows, "id", "y", "good", "bad", n=60)).first()
    assert not worse.promoted and worse.gain == pytest.approx(-v.gain)
    again = {r.replicate: r for r in mo.paired_bootstrap(rows.repartition(7), "id", "y", "bad", "good", n=60).collect()}
    first = {r.replicate: r for r in better.collect()}
    assert len(first) == 61 and all(again[k].weight == r.weight and again[k].challenger == pytest.approx(r.challenger) for k, r in first.items())
    weights = np.array([r.weight for k, r in first.items() if k >= 0])
    assert first[-1].weight == 1200 and abs(weights.mean() - 1200) < 25 and 20 < weights.std() < 52
    assert mo.verdict(mo.paired_bootstrap(rows, "id", "y", "bad", "bad", n=10)).first().promoted is False
