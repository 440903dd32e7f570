import random

import pytest

from tidemark.operators import calibration as ca

SCHEMA = "id long, y int, p double"


def plain(rows):
    """score to calibrated score, by the largest of the least means."""
    scores = sorted({p for _, y, p in rows if p is not None and y is not None})
    s = [sum(y for _, y, p in rows if p == x and y is not None) for x in scores]
    n = [sum(p == x and y is not None for _, y, p in rows) for x in scores]
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(scores))) for a in range(i + 1)) for i, x in enumerate(scores)}


@pytest.mark.parametrize("seed, merged", [(1, 250_000), (2, 250_000), (3, 3), (4, 5)])
def test_equals_definition(spark, monkeypatch, seed, merged):
    """Also where blocks are merged a few at a time, by several rounds of other ranges."""
    monkeypatch.setattr(ca, "MERGED", merged)
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < (p if seed % 2 else 1 - p)), p) for i in range(160) for p in [rng.randrange(60) / 60]] + [(900, None, 0.5), (901, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = ca.isotonic(df, "y", "p")
    want = plain(rows)
    got = {r.id: r.calibrated for r in ca.calibrated(df, blocks, "p", "id").collect()}
    assert len(got) == len(rows) and got[901] is None
    assert all(got[i] == pytest.approx(want[p]) for i, y, p in rows if p is not None and y is not None)
    out = blocks.orderBy("low").collect()
    shares = [r.positives / r.n for r in out]
    assert shares == sorted(set(shares)) and sum(r.n for r in out) == 160 and all(a.high < b.low for a, b in zip(out, out[1:], strict=False))


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.4), (3, 0, 0.4), (4, 1, 0.9)], SCHEMA)
    blocks = ca.isotonic(df, "y", "p")
    assert sorted(map(tuple, blocks.collect())) == [(0.2, 0.2, 0.0, 1.0), (0.4, 0.4, 1.0, 2.0), (0.9, 0.9, 1.0, 1.0)]
    other = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.5), (4, 2.0), (5, None)], "id long, p double")
    assert [r.calibrated for r in ca.calibrated(other, blocks, "p", "id").orderBy("id").collect()] == [0.0, 0.0, 0.5, 1.0, None]
    none = ca.isotonic(df.limit(0), "y", "p")
    assert none.count() == 0 and {r.calibrated for r in ca.calibrated(other, none, "p", "id").collect()} == {None}
    assert {(r.bin, r.n, r.positive_share) for r in ca.reliability(df, "y", "p").collect()} == {(2, 1, 0.0), (4, 2, 0.5), (9, 1, 1.0)}
