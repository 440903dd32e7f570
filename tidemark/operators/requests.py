"""Scoring requests: rows against a contract of pinned categories and ranges, and feature names for people."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BATCH = 1000


@dataclass(frozen=True)
class Field:
    """A field's type, allowed values or bounds (inclusive), and whether it may be missing."""

    name: str
    kind: str = "double"
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    optional: bool = False

    def fault(self) -> Column:
        """What is wrong with the field, null if nothing."""
        c = F.col(self.name)
        out = F.when(c.isNull(), F.lit(None) if self.optional else F.lit(f"{self.name}: missing"))
        if self.values:
            out = out.when(~c.isin(*self.values), f"{self.name}: unknown value")
        if self.low is not None:
            out = out.when(c < self.low, f"{self.name}: below {self.low:g}")
        if self.high is not None:
            out = out.when(c > self.high, f"{self.name}: above {self.high:g}")
        return out


def frame_of(spark: SparkSession, payloads: Sequence[dict], fields: Sequence[Field]) -> DataFrame:
    """Payloads as rows of the fields in order; what a payload lacks is null. At most MAX_BATCH of them."""
    if not 1 <= len(payloads) <= MAX_BATCH:
        raise ValueError(f"a request has 1 to {MAX_BATCH} rows, not {len(payloads)}")
    cast = lambda v, f: v if v is None or f.kind != "double" else float(v)
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.kind == "double" else T.StringType()) for f in fields])
    return spark.createDataFrame([tuple(cast(p.get(f.name), f) for f in fields) for p in payloads], schema)


def validated(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Add faults (in the order of the fields, `; ` between them; empty if the row may be scored)."""
    return df.withColumn("faults", F.concat_ws("; ", *[f.fault() for f in fields]))


def readable(feature: Column, labels: dict[str, str]) -> Column:
    """A label if the feature has one; `Column: value` if it is an encoded category of a labelled column; else itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    column, value = F.regexp_extract(feature, r"^(.+?)_([^_]+)$", 1), F.regexp_extract(feature, r"^(.+?)_([^_]+)$", 2)
    return F.coalesce(F.element_at(table, feature), F.concat(F.element_at(table, column), F.lit(": "), value), feature)
