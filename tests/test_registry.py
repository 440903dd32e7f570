import pytest

from tidemark.operators.training import Model
from tidemark.sources import registry as rg


def model(threshold=0.4, version="1"):
    return Model({"x": (1.0, 1.0, 2.0)}, {}, {"x": 0.5}, -0.1, threshold=threshold, version=version)


def test_runs_and_stages(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert rg.runs(spark, root).count() == 0 and rg.pointed(spark, root, "churn", "Production") is None
    first = rg.record_run(spark, root, "churn", model(version="1").to_json(), params={"folds": 5}, metrics={"roc_auc": 0.7, "note": "x"}, tags={"threshold": 0.31})
    second = rg.record_run(spark, root, "churn", model(version="2").to_json(), metrics={"roc_auc": 0.8})
    other = rg.record_run(spark, root, "spend", model().to_json())
    assert rg.runs(spark, root).count() == 3 and {r.run_id for r in rg.runs(spark, root, "churn").collect()} == {first, second}
    one = rg.runs(spark, root).where(f"run_id = '{first}'").first()
    assert one.params == {"folds": "5"} and one.metrics == {"roc_auc": 0.7} and one.tags == {"threshold": "0.31"}
    rg.point(spark, root, "churn", "Production", first)
    assert rg.pointed(spark, root, "churn", "Production").run_id == first
    rg.point(spark, root, "churn", "Production", second)
    assert rg.pointed(spark, root, "churn", "Production").run_id == second and rg.pointed(spark, root, "churn", "Staging") is None
    rg.point(spark, root, "churn", "Production", first)
    assert rg.pointed(spark, root, "churn", "Production").run_id == first and rg._read(spark, root, "stages", rg.STAGES).count() == 3
    with pytest.raises(KeyError):
        rg.point(spark, root, "churn", "Production", other)


def test_model_and_cutoff_are_found_in_order(spark, tmp_path):
    root, local = str(tmp_path / "runs"), tmp_path / "model.json"
    local.write_text(model(threshold=0.6, version="local").to_json())
    find = lambda **s: rg.find_model(spark, "churn", rg.Settings(**s), Model.from_json)
    found, threshold, source, warnings = find(runs=root, model=str(local))
    assert (found.version, threshold, source) == ("local", 0.6, "model") and len(warnings) == 1 and "stage Production" in warnings[0]
    run = rg.record_run(spark, root, "churn", model(threshold=0.4, version="7").to_json(), tags={"threshold": 0.31})
    rg.point(spark, root, "churn", "Production", run)
    found, threshold, source, warnings = find(runs=root, model=str(local))
    assert (found.version, threshold, source, warnings) == ("7", 0.31, "model", [])
    assert find(runs=root, threshold=0.9)[1:3] == (0.9, "override")
    none, threshold, source, warnings = find(runs=root, stage="Staging", model=str(tmp_path / "gone.json"))
    assert none is None and (threshold, source) == (0.5, "fallback") and len(warnings) == 2
    bad = rg.record_run(spark, root, "churn", "{not json")
    rg.point(spark, root, "churn", "Production", bad)
    assert find(runs=root, model=str(local))[0].version == "local"


def test_settings_from_environment():
    assert rg.Settings.from_environment(environment={}) == rg.Settings()
    full = {"TIDEMARK_THRESHOLD": " 0.25 ", "TIDEMARK_RUNS": "/runs", "TIDEMARK_STAGE": "Staging", "TIDEMARK_MODEL": ""}
    assert rg.Settings.from_environment(environment=full) == rg.Settings("/runs", "Staging", None, 0.25)
    assert rg.Settings.from_environment(environment={"TIDEMARK_THRESHOLD": "  "}).threshold is None
    for wrong in ("1.5", "-0.1", "high", "nan"):
        with pytest.raises(ValueError):
            rg.Settings.from_environment(environment={"TIDEMARK_THRESHOLD": wrong})
    assert rg.as_params(model())["threshold"] == "0.4"
