"""Encoding, cutoffs chosen by profit, metrics, bands, recommendations and explanations, over scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence

# Fixed values of the profit rule.
OFFER_COST = 200.0
SAVED_VALUE = 1200.0
SWEEP = (0.05, 0.95, 91)


def thresholds() -> list[float]:
    low, high, n = SWEEP
    return [low + (high - low) / (n - 1) * i for i in range(n)]


def median_scaled(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Missing numbers become the median (the mean of the middle pair), then all are centred and divided by the
    population deviation (1 where there is none). Two jobs, whatever the number of columns: medians, mean and deviation."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    medians = {r["column"]: r["median"] for r in evidence.medians(df, list(columns)).collect()}
    filled = {c: F.coalesce(value(c), F.lit(medians.get(c)).cast("double")) for c in columns}
    stats = df.select(*[x.alias(c) for c, x in filled.items()]).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {f"{c}{suffix}": (filled[c] - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns(scaled)


def mode_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing categories become the most frequent one, the smallest of equals."""
    modes = df.agg(*[F.mode(c, True).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in columns})


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """A 0/1 column per pinned category; unknown and missing ones are all zero."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories})


def sweep(scored: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, tp, fp, profit for each cutoff: scores are counted between neighbouring cutoffs first, then summed
    from the top, so the table is read once however many cutoffs there are."""
    cuts = thresholds()
    below = sum(((F.col(p) >= t).cast("int") for t in cuts), F.lit(0))
    bins = scored.where(F.col(p).isNotNull()).groupBy(below.alias("bin")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    grid = scored.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(cuts)], "k int, threshold double")
    rows = grid.join(bins, F.col("bin") >= F.col("k"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    return rows.withColumn("profit", F.col("tp") * SAVED_VALUE - (F.col("tp") + F.col("fp")) * OFFER_COST)


def pick_threshold(scored: DataFrame, y: str, p: str) -> DataFrame:
    """The lowest cutoff of the highest profit, rounded to four places, and that profit."""
    best = F.max_by(F.struct("threshold", "profit"), F.struct("profit", (-F.col("threshold")).alias("t"))).alias("b")
    return sweep(scored, y, p).agg(best).select(F.round("b.threshold", 4).alias("threshold"), F.col("b.profit").alias("profit"))


def confusion(scored: DataFrame, y: str, p: str, cutoff: float) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; a ratio of nothing is 0."""
    hit, true = F.col(p) >= cutoff, F.col(y) == 1
    c = scored.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def average_precision(scored: DataFrame, y: str, p: str) -> DataFrame:
    """Step-wise area under precision and recall: precision at each distinct score, weighted by the recall it adds.
    Scores are counted first; the running sums are over distinct scores."""
    by = scored.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = evidence.running(by, [], [F.desc("p")], ["pos", "n"]).withColumns({"tp": F.col("pos") + F.col("pos_before"), "seen": F.col("n") + F.col("n_before")})
    return steps.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos").cast("double")).alias("average_precision"))


def class_weight(df: DataFrame, y: str) -> DataFrame:
    """Negatives for each positive."""
    return df.agg((F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).alias("pos_weight"))


def _ranked(df: DataFrame, y: str, key: str, seed: int) -> DataFrame:
    """Add _rank: a row's place from 0 in a seeded order of its class."""
    return evidence.running(df.withColumns({"_one": F.lit(1), "_order": F.xxhash64(F.lit(seed), F.col(key))}), [y], [F.col("_order"), F.col(key)], ["_one"]).withColumnRenamed("_one_before", "_rank")


def stratified_folds(df: DataFrame, y: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Add fold, 0..k-1: within each class the folds' sizes differ by one row at most, the first folds having the larger
    ones. For tables without any time column only; those with one are split by time. Rows that share a key are dealt in
    any order."""
    return _ranked(df, y, key, seed).withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_one", "_order", "_rank")


def stratified_split(df: DataFrame, y: str, key: str, held_out: float = 0.2, seed: int = 42) -> DataFrame:
    """Add split: `eval` for the stated share of every class (rounded, halves up), `train` for the rest."""
    sizes = df.groupBy(F.col(y).alias("_class")).agg(F.floor(F.count(F.lit(1)) * held_out + 0.5).alias("_held"))
    both = _ranked(df, y, key, seed).join(F.broadcast(sizes), F.col(y).eqNullSafe(F.col("_class")))  # a row per class
    return both.select(*df.columns, F.when(F.col("_rank") < F.col("_held"), "eval").otherwise("train").alias("split"))


def recommended(p: Column, cutoff: float, rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Null below the cutoff, else the text of the first rule that holds, else the default."""
    out = F.when(p < cutoff, F.lit(None).cast("string")).when(p.isNull(), F.lit(None).cast("string"))
    for condition, text in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), text)
    return out.otherwise(default)


def top_reasons(contributions: dict[str, Column], k: int = 4) -> Column:
    """The k contributions of largest size as feature, contribution, direction; equals stay in the given order."""
    rows = F.array(*[F.struct((-F.abs(c)).alias("size"), F.lit(i).alias("place"), F.lit(n).alias("feature"), c.alias("contribution")) for i, (n, c) in enumerate(contributions.items())])
    direction = lambda x: F.when(x["contribution"] > 0, "increases").otherwise("decreases")
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(x["feature"].alias("feature"), F.round(x["contribution"], 4).alias("contribution"), direction(x).alias("direction")))


def linear_contributions(features: dict[str, Column], weights: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """Exact contributions of a linear model: weight * (value - mean)."""
    return {n: (c - means[n]) * weights[n] for n, c in features.items()}


def train_logistic(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None):
    """A Spark ML pipeline of assembler and logistic regression; raw frame in, probability out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = LogisticRegression(labelCol=y, featuresCol="_features", probabilityCol="_probability", maxIter=100, regParam=1e-3)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), model]).fit(df)


def scored_by(model, df: DataFrame) -> DataFrame:
    """Add churn_probability."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("churn_probability", vector_to_array("_probability")[1]).drop("_features", "_probability", "rawPrediction", "prediction")


def resolve_threshold(override: float | None, model: float | None) -> tuple[float, str]:
    """Override before the model's own before one half; with where it came from."""
    if override is not None:
        return override, "override"
    return (model, "model") if model is not None else (0.5, "fallback")


def placed(df: DataFrame, probability: str, key: str) -> DataFrame:
    """All rows with their place in the global sort, highest probability first. The sorted rows are stored once with
    their position in their partition; only the number of rows of each partition comes to the driver."""
    from ..session import scratch

    spark, path = df.sparkSession, scratch(df.sparkSession, "placed")
    df.orderBy(F.desc(probability), key).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before, offsets = 0, []
    for r in sorted(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["__part"], before))
        before += r.n
    offsets = spark.createDataFrame(offsets, "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(offsets), "__part").select(*df.columns, place.alias("place"))
