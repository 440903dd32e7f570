"""Raw tables to a fitted model and its figures: loading, cleaning, one fitted object for training and serving, the run
that chooses a cutoff on out-of-fold scores, and predictions with band, reasons and recommendation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import evidence, scoring
from .requests import Field, readable, validated


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """A plain delimited file with a header, columns typed by their values; awkward files need read_table()."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def clean(df: DataFrame, *, id_column: str | None = None, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """What must happen alike in training and serving, and learns nothing: the id goes, texts that are no number become
    null in numeric columns, categories lose blanks at their ends. Columns that are not there are left out."""
    out = df.drop(id_column) if id_column else df
    to_number = {c: V.strip(F.col(c).cast("string")).try_cast("double") for c in numeric if c in out.columns}
    return out.withColumns(to_number | {c: V.strip(F.col(c).cast("string")) for c in categorical if c in out.columns})


def split_xy(df: DataFrame, features: Sequence[str], target: str, positive: str = "Yes") -> DataFrame:
    """The features and y: 1 where the target, without blanks at its ends, is the positive value, else 0."""
    return df.select(*features, F.coalesce((V.strip(F.col(target).cast("string")) == positive).cast("int"), F.lit(0)).alias("y"))


@dataclass(frozen=True)
class Model:
    """All that is fitted, as plain values: how columns are filled, scaled and encoded, the weights of the encoded
    features, the cutoff and its source. Serving is an expression; no row leaves the JVM."""

    numeric: dict[str, tuple[float, float, float]]  # median, mean, deviation
    categorical: dict[str, tuple[str | None, tuple[str, ...]]]  # mode, pinned categories
    weights: dict[str, float]
    intercept: float
    means: dict[str, float] = field(default_factory=dict)
    threshold: float | None = None
    version: str = "1"

    def features(self) -> dict[str, Column]:
        """Encoded features: scaled numbers, a 0/1 column per pinned category."""
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
        out = {c: (F.coalesce(number(c), F.lit(float(median))) - mean) / (deviation or 1.0) for c, (median, mean, deviation) in self.numeric.items()}
        for c, (mode, values) in self.categorical.items():
            filled = F.coalesce(F.col(c), F.lit(mode))
            out |= {f"{c}_{v}": F.coalesce((filled == v).cast("double"), F.lit(0.0)) for v in values}
        return out

    def probability(self) -> Column:
        terms = [x * self.weights[n] for n, x in self.features().items() if self.weights.get(n)]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))))

    def contributions(self) -> dict[str, Column]:
        return scoring.linear_contributions(self.features(), {n: self.weights.get(n, 0.0) for n in self.features()}, {n: self.means.get(n, 0.0) for n in self.features()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(**d | {"numeric": {k: tuple(v) for k, v in d["numeric"].items()}, "categorical": {k: (m, tuple(v)) for k, (m, v) in d["categorical"].items()}})


def prepared(df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]]) -> Model:
    """The fitted part before the estimator: medians, means and deviations of the filled numbers, modes."""
    medians = {r["column"]: r["median"] for r in evidence.medians(df, list(numeric)).collect()} if numeric else {}
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(medians.get(c, 0.0)))) for c in numeric}
    figures = [f(x).alias(f"{k}_{c}") for c, x in filled.items() for k, f in (("mean", F.avg), ("deviation", F.stddev_pop))] + [F.mode(c, True).alias(f"mode_{c}") for c in categorical]
    r = df.agg(F.count(F.lit(1)).alias("n"), *figures).first()
    return Model(
        {c: (float(medians.get(c, 0.0)), r[f"mean_{c}"] or 0.0, r[f"deviation_{c}"] or 1.0) for c in numeric}, {c: (r[f"mode_{c}"], tuple(v)) for c, v in categorical.items()}, {}, 0.0
    )


def fit(df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]], y: str = "y") -> Model:
    """Preprocessing and a logistic regression that weighs positives by the negatives for each."""
    model = prepared(df, numeric, categorical)
    encoded = model.features()
    weight = scoring.class_weight(df, y).first()[0]
    rows = df.select(F.col(y).cast("double").alias("_y"), F.when(F.col(y) == 1, F.lit(float(weight))).otherwise(1.0).alias("_w"), *[x.alias(f"f{i}") for i, x in enumerate(encoded.values())])
    fitted = scoring.train_logistic(rows, [f"f{i}" for i in range(len(encoded))], "_y", "_w").stages[-1]
    means = rows.agg(*[F.avg(f"f{i}").alias(f"f{i}") for i in range(len(encoded))]).first()
    return Model(model.numeric, model.categorical, dict(zip(encoded, map(float, fitted.coefficients), strict=True)), float(fitted.intercept), dict(zip(encoded, (x or 0.0 for x in means), strict=True)))


def train_run(df: DataFrame, key: str, numeric: Sequence[str], categorical: dict[str, Sequence[str]], *, y: str = "y", held_out: float = 0.2, folds: int = 5, version: str = "1") -> tuple[Model, dict[str, float]]:
    """A model with its cutoff, and the run's figures. The cutoff is chosen on out-of-fold scores of the training rows, and
    the metrics are of the held-out rows. For tables without a time column: others are split by temporal.cutoff_split()."""
    split = scoring.stratified_split(df, y, key, held_out)
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'eval'").drop("split")
    dealt = scoring.stratified_folds(train, y, key, folds)
    parts = [dealt.where(F.col("fold") == k).select(y, fit(dealt.where(F.col("fold") != k), numeric, categorical, y).probability().alias("p")) for k in range(folds)]
    best = scoring.pick_threshold(reduce(DataFrame.union, parts), y, "p").first()
    model = fit(train, numeric, categorical, y)
    model = Model(model.numeric, model.categorical, model.weights, model.intercept, model.means, best.threshold, version)
    scored = test.select(F.col(y).alias("y"), model.probability().alias("p"))
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate")).first()
    c = scoring.confusion(scored, "y", "p", best.threshold).first()
    figures = {
        "n_train": sizes.n, "n_test": test.count(), "churn_rate_train": round(sizes.rate or 0.0, 4), "scale_pos_weight": round(scoring.class_weight(train, y).first()[0], 3),
        "cost_offer": scoring.OFFER_COST, "value_saved": scoring.SAVED_VALUE, "roc_auc": (evidence.rank_auc(scored, ["p"], F.col("y"), fold=False).first() or {"auc": None})["auc"],
        "pr_auc": scoring.average_precision(scored, "y", "p").first()[0], "precision": c.precision, "recall": c.recall, "f1": c.f1, "threshold": best.threshold, "oof_expected_value": best.profit,
    }
    return model, figures


def predict(
    df: DataFrame, model: Model, fields: Sequence[Field], *, override: float | None = None, rules: Sequence[tuple[Column, str]] = (), default: str = "Route to the retention team.",
    labels: dict[str, str] | None = None, k: int = 4,
) -> DataFrame:
    """Add faults, churn_probability (four places), risk_band, will_churn, threshold, threshold_source, top_reasons,
    retention_recommendation and model_version; a row with faults has nulls in all but the first and the last two of
    these that do not depend on it."""
    cutoff, source = scoring.resolve_threshold(override, model.threshold)
    ok = F.col("faults") == ""
    p = F.when(ok, model.probability())
    rows = validated(df, fields).withColumn("_p", p)
    reasons = F.transform(scoring.top_reasons(model.contributions(), k), lambda x: F.struct(readable(x["feature"], labels or {"": ""}).alias("feature"), x["contribution"].alias("contribution"), x["direction"].alias("direction")))
    return rows.select(
        *df.columns, "faults", F.round("_p", 4).alias("churn_probability"), V.risk_band(F.col("_p")).alias("risk_band"), (F.col("_p") >= cutoff).alias("will_churn"), F.lit(cutoff).alias("threshold"), F.lit(source).alias("threshold_source"),
        F.when(ok, reasons).alias("top_reasons"), scoring.recommended(F.col("_p"), cutoff, rules, default).alias("retention_recommendation"), F.lit(model.version).alias("model_version"),
    )
