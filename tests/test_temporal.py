import datetime as dt

import pytest

from tidemark.operators import temporal as tp

END = dt.datetime(2024, 6, 30)
H = dt.timedelta(days=90)


def test_cutoff(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0), (dt.datetime(2024, 2, 1), 1), (dt.datetime(2024, 3, 1), 1), (None, 0)], "when timestamp_ntz, y int")
    assert sorted((str(r.when), r.split) for r in tp.cutoff_split(df, "when", "2024-02-01").collect())[1] == ("2024-02-01 00:00:00", "eval")
    assert tp.cutoff_split(df, "when", "2024-02-01").where("split = 'undated'").count() == 1
    with pytest.raises(ValueError, match="2024-03-01"):
        tp.cutoff_split(df, "when", "2030-01-01")
    with pytest.raises(KeyError):
        tp.cutoff_split(df, "never", "2024-01-01")
    with pytest.raises(TypeError):
        tp.cutoff_split(df, "y", "2024-01-01")


def test_folds(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1) + dt.timedelta(days=i), i) for i in range(721)], "day timestamp_ntz, i int")
    rows = tp.walk_forward(df, "day", 4, dt.timedelta(days=30)).groupBy("fold", "role").count().collect()
    n = {(r.fold, r.role): r["count"] for r in rows}
    assert [n[k, "train"] for k in range(4)] == [600, 630, 660, 690] and all(n[k, "eval"] == 30 for k in range(4))
    with pytest.raises(ValueError, match="2400"):
        tp.walk_forward(df, "day", 40, dt.timedelta(days=60))


@pytest.fixture
def people(spark):
    d = dt.datetime
    rows = [("A", d(2023, 1, 1), d(2024, 8, 1)), ("B", d(2023, 1, 1), None), ("C", d(2024, 6, 1), d(2024, 8, 1)), ("D", d(2023, 1, 1), d(2024, 6, 30)), ("F", d(2023, 1, 1), d(2024, 12, 1)), ("G", None, None), ("H", d(2024, 7, 5), None)]
    return spark.createDataFrame(rows, "id string, joined timestamp_ntz, left_on timestamp_ntz")


def label(df, **more):
    rows = tp.label_with_censoring(df, start="joined", event="left_on", observation_end=END, horizon=H, min_tenure=dt.timedelta(days=90), **more)
    return {r.id: (r.outcome, r.label) for r in rows.collect()}


def test_labels(people):
    got = label(people, data_end=dt.datetime(2024, 9, 30))
    assert got == {"A": ("positive", 1), "B": ("negative", 0), "C": ("short_tenure", None), "D": ("already_gone", None), "F": ("event_after_window", None), "G": ("no_start", None), "H": ("started_after", None)}
    assert label(people, data_end=dt.datetime(2024, 8, 1))["B"] == ("censored", None) and label(people)["B"] == ("censored", None)


def test_report(people):
    rows = tp.label_with_censoring(people, start="joined", event="left_on", observation_end=END, horizon=H)
    report = {r.reason: (r.n, r["sample"]) for r in tp.excluded(rows, "outcome", "id", ("positive", "negative")).collect()}
    assert sum(n for n, _ in report.values()) + rows.where("label is not null").count() == people.count()
    assert report["censored"] == (1, "B")
