"""A record of training runs that only grows, stages that point into it, and settings from the environment."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, name string, at timestamp, params map<string,string>, metrics map<string,double>, tags map<string,string>, model string"
STAGES = "name string, stage string, run_id string, at timestamp"


@dataclass(frozen=True)
class Settings:
    """What may be set from outside: the folder of runs, the stage that serves, a local model in its place, and a cutoff that
    goes before the model's own."""

    runs: str | None = None
    stage: str = "Production"
    model: str | None = None
    threshold: float | None = None

    @staticmethod
    def from_environment(prefix: str = "TIDEMARK_", environment: Mapping[str, str] | None = None) -> Settings:
        """An empty value is as good as none; a cutoff that is no number between 0 and 1 raises."""
        known = os.environ if environment is None else environment
        said = lambda name: (known.get(prefix + name) or "").strip() or None
        threshold = said("THRESHOLD")
        if threshold is not None:
            threshold = float(threshold)
            if not 0 <= threshold <= 1:
                raise ValueError(f"{prefix}THRESHOLD is {threshold}, not between 0 and 1")
        return Settings(said("RUNS"), said("STAGE") or "Production", said("MODEL"), threshold)


def _append(spark: SparkSession, root: str, table: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/{table}")


def _read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{table}")
    except AnalysisException:  # nothing was recorded yet
        return spark.createDataFrame([], schema)


def record_run(spark: SparkSession, root: str, name: str, model_json: str, *, params: Mapping | None = None, metrics: Mapping | None = None, tags: Mapping | None = None) -> str:
    """Append one run with its model; a row is written as a whole or not at all. Metrics that are no numbers are left out."""
    run_id = uuid.uuid4().hex
    text = lambda d: {k: str(v) for k, v in (d or {}).items()}
    numbers = {k: float(v) for k, v in (metrics or {}).items() if isinstance(v, (int, float))}
    _append(spark, root, "runs", RUNS, (run_id, name, datetime.now(UTC), text(params), numbers, text(tags), model_json))
    return run_id


def runs(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    out = _read(spark, root, "runs", RUNS)
    return out if name is None else out.where(F.col("name") == name)


def point(spark: SparkSession, root: str, name: str, stage: str, run_id: str) -> None:
    """Let a stage point to a run of that name; earlier pointers stay on record."""
    if not runs(spark, root, name).where(F.col("run_id") == run_id).limit(1).count():
        raise KeyError(f"{name} has no run {run_id}")
    _append(spark, root, "stages", STAGES, (name, stage, run_id, datetime.now(UTC)))


def pointed(spark: SparkSession, root: str, name: str, stage: str):
    """The run that a stage points to, or None."""
    last = _read(spark, root, "stages", STAGES).where((F.col("name") == name) & (F.col("stage") == stage)).agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id")).first().run_id
    return runs(spark, root, name).where(F.col("run_id") == last).first() if last else None


def find_model(spark: SparkSession, name: str, settings: Settings, parse: Callable[[str], object]) -> tuple[object | None, float, str, list[str]]:
    """Model, cutoff, where the cutoff came from, and a warning for each place that had no model: the stage's run, then the
    local file. The cutoff is the setting's, else the run's tag or the model's own, else one half."""
    from ..operators.scoring import resolve_threshold

    warnings, model, own = [], None, None
    if settings.runs:
        try:
            run = pointed(spark, settings.runs, name, settings.stage)
            if run is None:
                warnings.append(f"{settings.runs}: no run of {name} in stage {settings.stage}")
            else:
                model, own = parse(run.model), (run.tags or {}).get("threshold")
        except Exception as e:  # any reason sends the caller to the next place
            warnings.append(f"{settings.runs}: {str(e).splitlines()[0]}")
    if model is None and settings.model:
        try:
            model = parse("\n".join(r.value for r in spark.read.text(settings.model, wholetext=True).collect()))
        except Exception as e:
            warnings.append(f"{settings.model}: {str(e).splitlines()[0]}")
    if own is None:
        own = getattr(model, "threshold", None)
    threshold, source = resolve_threshold(settings.threshold, float(own) if own is not None else None)
    return model, threshold, source, warnings


def as_params(model: object) -> dict[str, str]:
    """A model's JSON as flat parameters, for the record."""
    return {k: json.dumps(v, sort_keys=True) for k, v in json.loads(model.to_json()).items()}
