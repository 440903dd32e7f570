"""Where results go: scored tables as delimited text, models with what must travel with them, rows as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scored(df: DataFrame, path: str, probability: str, key: str, one_file: bool = False) -> None:
    """All columns as delimited text with a header, highest probability first: over files in order, or in one file for
    tables that a person opens."""
    out = df.coalesce(1).sortWithinPartitions(F.desc(probability), key) if one_file else df.orderBy(F.desc(probability), key)
    out.write.option("header", True).mode("overwrite").csv(path)


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per row; nulls are left out."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))


def save_model(model, path: str, *, threshold: float, features: list[str], metrics: dict | None = None) -> None:
    """The fitted pipeline with its cutoff, features and metrics in one folder: they are of no use apart."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/pipeline")
    card = json.dumps({"threshold": threshold, "features": features, "metrics": metrics or {}}, sort_keys=True)
    spark.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load_model(spark: SparkSession, *paths: str):
    """(pipeline, card, path) of the first folder that holds a model, with a warning for each that does not; None if none
    does."""
    from pyspark.ml import PipelineModel

    warnings = []
    for path in paths:
        try:
            card = json.loads(spark.read.text(f"{path}/card").first()[0])
            return PipelineModel.load(f"{path}/pipeline"), card, path, warnings
        except Exception as e:  # any reason sends the caller to the next place
            warnings.append(f"{path}: {str(e).splitlines()[0]}")
    return None, None, None, warnings
