import pytest

from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import requests as rq
from tidemark.operators import scoring as sc


def test_threshold_prefers_the_lowest_of_equals(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.4), (0, 0.2), (1, None)], "y int, p double")
    best = sc.pick_threshold(df, "y", "p").first()
    want = max(((sum(y == 1 and p is not None and p >= t for y, p in [(1, 0.9), (1, 0.5), (0, 0.4), (0, 0.2)]) * 1200 - sum(p >= t for _, p in [(1, 0.9), (1, 0.5), (0, 0.4), (0, 0.2)]) * 200), -t) for t in sc.thresholds())
    assert (best.profit, best.threshold) == (want[0], pytest.approx(-want[1], abs=1e-4))


def test_average_precision_and_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert sc.average_precision(df, "y", "p").first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert sc.confusion(df, "y", "p", 2.0).first().precision == 0.0


def test_bands_recommendations_reasons(spark):
    df = spark.createDataFrame([(0.66,), (0.33,), (0.32,), (None,)], "p double")
    assert [r[0] for r in df.select(V.risk_band(F.col("p"))).collect()] == ["High", "Medium", "Low", None]
    got = df.select(sc.recommended(F.col("p"), 0.33, [(F.col("p") > 0.5, "call")], "mail")).collect()
    assert [r[0] for r in got] == ["call", "mail", None, None]
    row = spark.range(1).select(sc.top_reasons({"a": F.lit(0.5), "b": F.lit(-0.5), "c": F.lit(2.0), "d": F.lit(0.1)}, 3).alias("r")).first().r
    assert [(x.feature, x.direction) for x in row] == [("c", "increases"), ("a", "increases"), ("b", "decreases")]
    assert sc.resolve_threshold(None, None) == (0.5, "fallback") and sc.resolve_threshold(0.2, 0.3) == (0.2, "override")


def test_model_travels_with_its_card(spark, tmp_path):
    from tidemark.sources.sinks import load_model, save_model

    df = spark.createDataFrame([(float(i), float(i % 3), float(i > 10)) for i in range(30)], "a double, b double, y double")
    model = sc.train_logistic(df, ["a", "b"], "y")
    save_model(model, str(tmp_path / "m"), threshold=0.31, features=["a", "b"])
    loaded, card, path, warnings = load_model(spark, str(tmp_path / "none"), str(tmp_path / "m"))
    assert card["threshold"] == 0.31 and path.endswith("m") and len(warnings) == 1
    p = lambda m: [round(r.churn_probability, 9) for r in sc.scored_by(m, df).collect()]
    assert p(loaded) == p(model)
    assert load_model(spark, str(tmp_path / "none"))[0] is None


def test_requests(spark):
    fields = [rq.Field("tenure", low=0, high=100), rq.Field("plan", "string", values=("a", "b")), rq.Field("total", optional=True)]
    df = rq.validated(rq.frame_of(spark, [{"tenure": 5, "plan": "a"}, {"tenure": -1, "plan": "z", "total": 3}, {}], fields), fields)
    assert [r.faults for r in df.collect()] == ["", "tenure: below 0; plan: unknown value", "tenure: missing; plan: missing"]
    with pytest.raises(ValueError):
        rq.frame_of(spark, [], fields)


def test_scored_csv(spark, tmp_path):
    from tidemark.sources.sinks import write_scored

    df = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.5)], "id long, p double")
    write_scored(df, str(tmp_path / "out"), "p", "id", one_file=True)
    assert [r.id for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == ["2", "3", "1"]


def test_imputing(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, None), (3.0, "y"), (4.0, "x")], "v double, c string")
    got = [r.v_scaled for r in sc.median_scaled(df, ["v"]).collect()]
    assert got[2] == pytest.approx(0.0) and sum(got) == pytest.approx(0.0)
    assert [r.c for r in sc.mode_filled(df, ["c"]).collect()] == ["x", "y", "x", "y", "x"]
