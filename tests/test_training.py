import json
import math

import pytest

from tidemark.operators import training as tr
from tidemark.operators.requests import Field


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 10) if i % 11 else None, "abc"[i % 3] if i % 7 else None, int((i % 10) + 3 * (i % 3 == 0) > 6)) for i in range(200)]
    return spark.createDataFrame(data, "id long, v double, c string, y int")


def test_fit_and_serve(spark, rows):
    model = tr.fit(rows, ["v"], {"c": ("a", "b", "c")})
    assert model.categorical["c"][0] in "abc" and set(model.weights) == {"v", "c_a", "c_b", "c_c"} and model.weights["v"] > 0
    again = tr.Model.from_json(model.to_json())
    assert again == model and json.loads(model.to_json())["version"] == "1"
    got = rows.select("id", "v", "c", again.probability().alias("p")).collect()
    for r in got[:40]:
        median, mean, deviation = model.numeric["v"]
        c = r.c or model.categorical["c"][0]
        x = model.intercept + model.weights["v"] * ((median if r.v is None else r.v) - mean) / deviation + model.weights[f"c_{c}"]
        assert r.p == pytest.approx(1 / (1 + math.exp(-x)))


def test_run(spark, rows):
    model, figures = tr.train_run(rows, "id", ["v"], {"c": ("a", "b", "c")}, folds=2)
    assert figures["n_train"] + figures["n_test"] == 200 and figures["n_test"] == 40
    assert figures["roc_auc"] > 0.9 and figures["threshold"] == model.threshold and 0 < figures["f1"] <= 1


def test_prediction(spark):
    model = tr.Model({"v": (2.0, 1.0, 2.0)}, {"c": (None, ("a",))}, {"v": 1.0, "c_a": -0.5}, 0.0, threshold=0.6)
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "z"), (3, -1.0, None), (4, 1.0, "a")], "id long, v double, c string")
    fields = [Field("v", low=0, optional=True), Field("c", "string", values=("a", "z"), optional=True)]
    got = {r.id: r for r in tr.predict(df, model, fields, labels={"c": "Plan"}).collect()}
    assert got[1].churn_probability == pytest.approx(1 / (1 + math.exp(-1.5)), abs=1e-4) and got[1].will_churn and got[1].risk_band == "High"
    assert got[2].churn_probability == pytest.approx(1 / (1 + math.exp(-0.5)), abs=1e-4) and got[2].will_churn and got[2].faults == ""
    assert got[3].faults == "v: below 0" and got[3].churn_probability is None and got[3].will_churn is None and got[3].top_reasons is None and got[3].retention_recommendation is None
    assert got[4].threshold_source == "model" and got[4].retention_recommendation is None
    assert [(x.feature, x.direction) for x in got[1].top_reasons] == [("v", "increases"), ("Plan: a", "decreases")]
    assert tr.predict(df, model, fields, override=0.9).first().threshold_source == "override"
