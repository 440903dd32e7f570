"""Joins that no key makes one task, however many rows it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Rows that may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key of more than 1 / HEAVY of all rows is heavy: fewer than HEAVY keys are.
HEAVY = 1000


def join_skewed(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of rows (cheap to read twice) to a stored table. A table of few rows is broadcast. Of a larger one the
    rows of heavy keys alone are, if they are few, and those of other keys shuffle."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")), "counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    heavy = F.broadcast(counts.where((F.col("_rows") * HEAVY > F.lit(total)) & F.col(key).isNotNull()).select(key))
    theirs = stored(table.join(heavy, key, "left_semi"), "heavy")
    few = theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hot = rows.join(heavy, key, "left_semi").join(F.broadcast(theirs) if few else theirs, key)
    return hot.union(rows.join(heavy, key, "left_anti").join(table, key))
