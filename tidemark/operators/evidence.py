"""Column evidence for roles and leakage: whole-table statistics, fused so that all columns share a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def kinds_of(df: DataFrame) -> dict[str, str]:
    """numeric, datetime or text by type."""
    kind = lambda t: "numeric" if isinstance(t, T.NumericType) else "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def long_form(df: DataFrame, columns: list[str], *carry: Column) -> DataFrame:
    """One row per cell: column, value (as text; doubles print alike for all numeric types)."""
    kinds = kinds_of(df)
    as_text = lambda c: (F.col(c).cast("double") if kinds[c] == "numeric" else F.col(c)).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in columns])
    return df.select(*carry, F.explode(cells).alias("cell")).select(*[c for c in df.select(*carry).columns] if carry else [], "cell.column", "cell.value")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_rows, n_missing, n_distinct (exact), mean_length, min_text, max_text, n_max (rows
    with the largest): grouped by cell value first, so
    that a value that fills a column is one partial count and no column needs a task of its own."""
    cells = long_form(df, columns or df.columns)
    values = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    length = F.sum(F.char_length("value") * F.col("n"))
    return values.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.try_divide(length.cast("double"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).cast("double")).alias("mean_length"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        F.coalesce(F.max_by("n", "value"), F.lit(0)).alias("n_max"),
    )


def positive(df: DataFrame, target: str) -> Column:
    """1 for the largest of the target's values as text, 0 for others and for nulls."""
    top = df.agg(F.max(F.col(target).cast("string"))).first()[0]
    return F.coalesce((F.col(target).cast("string") == F.lit(top)).cast("int"), F.lit(0))


def running(counted: DataFrame, by: list[str], order: list[Column], sums: list[str], tops: list[str] | tuple = ()) -> DataFrame:
    """Add <name>_before for each of sums: its sum over the rows of the same `by` that come before in `order`, nulls
    counting nothing; and for each of tops: its maximum over them, null if there is none.

    Rows are dealt to tasks by ranges of the order and stored; each range adds up its own rows, and the figures of whole
    ranges, of which there are few, make the offsets. So neither a group nor a table without groups is one task.
    """
    rows = stored(counted.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "running")
    up_to_now = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    figure = {c: F.sum for c in sums} | {c: F.max for c in tops}
    zero = lambda c, x: F.coalesce(x, F.lit(0)) if c in sums else x
    sizes = rows.groupBy(*by, "_range").agg(*[f(c).alias(c) for c, f in figure.items()])
    ahead = up_to_now(Window.partitionBy(*by).orderBy("_range"))
    offsets = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), *[zero(c, f(c).over(ahead)).alias(f"_{c}") for c, f in figure.items()])
    inside = up_to_now(Window.partitionBy(*by, "_range").orderBy(*order))
    rows = rows.withColumns({f"{c}_before": zero(c, f(c).over(inside)) for c, f in figure.items()})
    same = F.col("_range") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    total = lambda c: F.col(f"{c}_before") + F.col(f"_{c}") if c in sums else F.greatest(f"{c}_before", f"_{c}")
    return rows.join(offsets, same).select(*counted.columns, *[total(c).alias(f"{c}_before") for c in figure])


def numbers_of(df: DataFrame, columns: list[str], *carry: Column) -> DataFrame:
    """One row per cell that holds a number: the carried columns, column, value (double)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*carry, F.explode(cells).alias("_cell"))
    return rows.select("*", "_cell.column", "_cell.value").drop("_cell").where("value is not null and not isnan(value)")


def rank_auc(df: DataFrame, columns: list[str], y: Column, fold: bool = True) -> DataFrame:
    """column, auc: the chance that a positive row's value is above a negative one's, ties counting half; with fold the
    larger of it and its complement. Null without both classes.

    Values are counted per column first; ranks are then running sums over distinct values, so ties need no window of
    their own, skewed values are one row and a column of many values is many tasks.
    """
    rows = numbers_of(df, columns, y.alias("y"))
    counted = rows.groupBy("column", "value").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    scored = running(counted, ["column"], [F.col("value")], ["n"]).withColumn("won", F.col("p") * (F.col("n_before") + F.col("n") / 2))
    auc = F.try_divide(F.sum("won").cast("double"), (F.sum("p") * F.sum("n")).cast("double"))
    out = scored.groupBy("column").agg(auc.alias("auc"))
    return out.withColumn("auc", F.greatest("auc", 1 - F.col("auc"))) if fold else out


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, median (the mean of the middle pair), exact, for all columns in one job and no column in one task."""
    counted = numbers_of(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counted, ["column"], [F.col("value")], ["n"])
    total = counted.groupBy(F.col("column").alias("of")).agg(F.sum("n").alias("total"))
    both = placed.join(F.broadcast(total), F.col("column") == F.col("of"))  # a row per column
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    return both.groupBy("column").agg(((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median"))


def class_evidence(df: DataFrame, columns: list[str], y: Column) -> DataFrame:
    """column, null_mask_r (correlation of absence with the target, absolute; null where one does not vary) and
    constant_within_class, for all columns in one aggregation over cell counts."""
    cells = long_form(df, columns, y.cast("double").alias("y"))
    counted = cells.groupBy("column", "y", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, y_, m = F.col("n"), F.col("y"), F.col("value").isNull().cast("double")
    sums = counted.groupBy("column").agg(
        F.sum(n).alias("n"), F.sum(n * y_).alias("sy"), F.sum(n * m).alias("sm"), F.sum(n * m * y_).alias("smy"),
        F.count_if((y_ == 0) & F.col("value").isNotNull()).alias("d0"), F.count_if((y_ == 1) & F.col("value").isNotNull()).alias("d1"),
        F.max(F.when(y_ == 0, F.col("value"))).alias("v0"), F.max(F.when(y_ == 1, F.col("value"))).alias("v1"),
    )
    var = lambda s: F.col(s) / F.col("n") - F.pow(F.col(s) / F.col("n"), 2)
    cov = F.col("smy") / F.col("n") - F.col("sm") / F.col("n") * F.col("sy") / F.col("n")
    varies = (F.col("sm") > 0) & (F.col("sm") < F.col("n")) & (F.col("sy") > 0) & (F.col("sy") < F.col("n"))
    r = F.when(varies, F.abs(F.try_divide(cov, F.sqrt(var("sm") * var("sy")))))
    constant = (F.col("d0") == 1) & (F.col("d1") == 1) & (F.col("v0") != F.col("v1"))
    return sums.select("column", r.alias("null_mask_r"), F.coalesce(constant, F.lit(False)).alias("constant_within_class"))


def post_window(df: DataFrame, columns: list[str], observation_end) -> DataFrame:
    """column, n_after, latest: dates later than the end of the observation window."""
    end = F.lit(observation_end).cast("timestamp_ntz")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("timestamp_ntz").alias("value")) for c in columns])
    rows = df.select(F.explode(cells).alias("c")).select("c.column", "c.value")
    return rows.groupBy("column").agg(F.count_if(F.coalesce(F.col("value") > end, F.lit(False))).alias("n_after"), F.max("value").alias("latest"))
