"""Temporal validation: cutoff split, walk-forward folds, labels that keep censored customers apart, and the check that
no feature looks past its prediction date."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TimeTravelError(AssertionError):
    """A feature's source is later than the prediction it serves."""


def _dates(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"no column {column!r}; there are {', '.join(df.columns)}")
    if not isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TypeError(f"column {column!r} is {df.schema[column].dataType.simpleString()}, not a date or timestamp")


def cutoff_split(df: DataFrame, date_column: str, cutoff, *, check: bool = True) -> DataFrame:
    """Add split: `train` before the cutoff, `eval` from it on, `undated` where there is no date.

    With check one job raises ValueError, naming the range of dates, if a side is empty."""
    _dates(df, date_column)
    at = F.lit(cutoff).cast("timestamp_ntz")
    day = F.col(date_column).cast("timestamp_ntz")
    out = df.withColumn("split", F.when(day < at, "train").when(day >= at, "eval").otherwise("undated"))
    if check:
        r = out.agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "eval").alias("e"), F.min(day).alias("lo"), F.max(day).alias("hi")).first()
        if not r.t or not r.e:
            raise ValueError(f"cutoff {cutoff} leaves {'train' if not r.t else 'eval'} empty: dates run from {r.lo} to {r.hi}")
    return out


def split_report(split: DataFrame, label: str | None = None, role: str = "split") -> DataFrame:
    """One row on what cutoff_split() made: n_train, n_eval, n_undated, and with a label the share of ones in train and
    eval (0 where there are no labels) as train_positive_rate and positive_rate. reported_auc_is_temporal is always true:
    nothing here splits at random."""
    side = F.col(role)
    counts = [F.count_if(side == s).alias(f"n_{s}") for s in ("train", "eval", "undated")]
    rate = lambda s: F.coalesce(F.avg(F.when(side == s, F.col(label)).cast("double")), F.lit(0.0))
    rates = [rate("train").alias("train_positive_rate"), rate("eval").alias("positive_rate")] if label else []
    return split.agg(*counts, *rates).withColumn("reported_auc_is_temporal", F.lit(True))


def label_report(labelled: DataFrame) -> DataFrame:
    """One row on what label_with_censoring() made: n_input, n_labelled, n_censored, n_excluded (which add up) and
    positive_rate, the share of ones among the labelled rows (0 without any)."""
    done = F.col("label").isNotNull()
    rows = labelled.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(done).alias("n_labelled"), F.count_if(F.col("outcome") == "censored").alias("n_censored"), F.coalesce(F.avg(F.col("label").cast("double")), F.lit(0.0)).alias("positive_rate"))
    return rows.select("n_input", "n_labelled", "n_censored", (F.col("n_input") - F.col("n_labelled") - F.col("n_censored")).alias("n_excluded"), "positive_rate")


def excluded(df: DataFrame, by: str, id_column: str, keep: tuple[str, ...], sample: int = 5) -> DataFrame:
    """Report of what was left out: reason, n and the first ids.

    The first ids come from a ranked window with a limit, which each task applies before the shuffle."""
    rows = df.where(~F.col(by).isin(*keep)).select(F.col(by).alias("reason"), F.col(id_column).cast("string").alias("id"))
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy("id"))).where(F.col("place") <= sample)
    ids = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"))
    return counts.join(ids, "reason")


def fold_bounds(df: DataFrame, date_column: str, n_folds: int = 4, horizon: timedelta = timedelta(days=30)) -> DataFrame:
    """fold, eval_start, eval_end: n_folds windows of the horizon that end at the latest date."""
    _dates(df, date_column)
    latest, earliest = df.agg(F.max(date_column), F.min(date_column)).first()
    if latest is None or horizon * n_folds >= latest - earliest:
        raise ValueError(f"{n_folds} folds of {horizon.days} days need {(horizon * n_folds).days} days; the dates span {(latest - earliest).days if latest else 0}")
    rows = [(i, latest - horizon * (n_folds - i), latest - horizon * (n_folds - i) + horizon) for i in range(n_folds)]
    return df.sparkSession.createDataFrame(rows, "fold int, eval_start timestamp_ntz, eval_end timestamp_ntz")


def walk_forward(df: DataFrame, date_column: str, n_folds: int = 4, horizon: timedelta = timedelta(days=30)) -> DataFrame:
    """A row per fold and row of df that is in it, with role: `train` before the fold's window, `eval` inside it.

    Rows dated exactly at the latest date are in no window, as windows are half-open; undated rows in no fold. The
    bounds are n_folds rows, so the range join broadcasts them."""
    bounds = fold_bounds(df, date_column, n_folds, horizon)
    day = F.col(date_column).cast("timestamp_ntz")
    both = df.join(F.broadcast(bounds), day < F.col("eval_end"))
    return both.withColumn("role", F.when(day < F.col("eval_start"), "train").otherwise("eval"))


def label_with_censoring(df: DataFrame, *, start: str, event: str, observation_end, horizon: timedelta, min_tenure: timedelta = timedelta(0), data_end=None) -> DataFrame:
    """Add outcome and label. The first rule that holds decides:

    started_after (start after observation_end), short_tenure, no_start, already_gone (event by observation_end),
    positive (event within the horizon; label 1), event_after_window, negative (no event and data to the end of the
    horizon; label 0), else censored. Only positive and negative have a label. Without data_end the data end at
    observation_end, and every row without an event is censored.
    """
    _dates(df, start)
    _dates(df, event)
    end = F.lit(observation_end).cast("timestamp_ntz")
    until = end + F.lit(horizon)
    s, e = F.col(start).cast("timestamp_ntz"), F.col(event).cast("timestamp_ntz")
    data = F.lit(observation_end if data_end is None else data_end).cast("timestamp_ntz")
    outcome = (
        F.when(s > end, "started_after")
        .when(s > end - F.lit(min_tenure), "short_tenure")
        .when(s.isNull(), "no_start")
        .when(e <= end, "already_gone")
        .when(e <= until, "positive")
        .when(e.isNotNull(), "event_after_window")
        .when(data >= until, "negative")
        .otherwise("censored")
    )
    out = df.withColumn("outcome", outcome)
    return out.withColumn("label", F.when(F.col("outcome") == "positive", 1).when(F.col("outcome") == "negative", 0))


def time_travel_report(df: DataFrame, sources: list[str], prediction: str) -> DataFrame:
    """A row per source column: n_late (source later than the prediction), worst_source and its prediction. Equality is
    allowed; nulls are ignored."""
    p = F.col(prediction)
    rows = df.select(p.alias("_p"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("timestamp_ntz").alias("source")) for c in sources])).alias("x"))
    late = F.col("x.source") > F.col("_p")
    return rows.groupBy(F.col("x.feature").alias("feature")).agg(
        F.count_if(F.coalesce(late, F.lit(False))).alias("n_late"), F.max(F.when(late, F.struct("x.source", "_p"))).alias("worst")
    ).select("feature", "n_late", F.col("worst.source").alias("worst_source"), F.col("worst._p").alias("worst_prediction"))


def check_no_time_travel(df: DataFrame, sources: list[str], prediction: str) -> None:
    """Raise TimeTravelError naming the column, the count and the worst case."""
    for r in time_travel_report(df, sources, prediction).where("n_late > 0").orderBy(F.desc("n_late")).limit(1).collect():
        raise TimeTravelError(f"{r.n_late} values of {r.feature!r} are later than the prediction, the worst from {r.worst_source} for {r.worst_prediction}")
