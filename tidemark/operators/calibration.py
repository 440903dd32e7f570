"""Calibration: the monotone step function of scores that lies nearest to the outcomes (isotonic regression)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import evidence

#: Blocks that a task merges at a time.
MERGED = 250_000

BLOCKS = "low double, high double, positives double, n double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring blocks, in ascending order, joined as long as a later one has no greater share of positives."""
    stack: list[list[float]] = []
    for batch in batches:
        for low, high, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and stack[-1][2] * n >= s * stack[-1][3]:
                before = stack.pop()
                low, s, n = before[0], s + before[2], n + before[3]
            stack.append([low, high, s, n])
    if stack:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*stack, strict=True)], ["low", "high", "positives", "n"])


def isotonic(scored: DataFrame, y: str, p: str) -> DataFrame:
    """low, high (scores), positives, n of the blocks of equal calibrated score (positives / n), which rises from block to block.
    Rows without a score or outcome are left out; equal scores are one; an empty table has no blocks.

    Ranges of scores are pooled by tasks of their own. Blocks that violate the order across ranges are merged by
    pooling again with other ranges, until no range begins below the one before; what is left of n outcomes is about
    their cube root for noisy scores, and never more than a multiple of n ** (2/3), as shares of zeros and ones must differ.
    """
    known = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    blocks = known.groupBy(F.col(p).cast("double").alias("low")).agg(F.sum(F.col(y).cast("double")).alias("positives"), F.count(F.lit(1)).cast("double").alias("n"))
    blocks = blocks.select("low", F.col("low").alias("high"), "positives", "n")
    parts = None
    while True:
        dealt = blocks.repartitionByRange("low") if parts is None else blocks.repartitionByRange(parts, "low")
        blocks = stored(dealt.sortWithinPartitions("low").mapInArrow(_pooled, BLOCKS).withColumn("range", F.spark_partition_id()), "blocks")
        share = F.col("positives") / F.col("n")
        ranges = blocks.groupBy("range").agg(F.min("low").alias("low"), F.min_by(share, "low").alias("first"), F.max_by(share, "low").alias("last"), F.count(F.lit(1)).alias("blocks"))
        ends = sorted((r["low"], r["first"], r["last"], r["blocks"]) for r in ranges.collect())  # a row per range
        if all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False)):
            return blocks.drop("range")
        fewer = -(-sum(e[3] for e in ends) // MERGED)
        parts = fewer if fewer == 1 or parts is None or fewer < parts else fewer + 1 if parts == fewer else fewer  # other ranges than before
        blocks = blocks.drop("range")


def calibrated(scored: DataFrame, blocks: DataFrame, p: str, key: str) -> DataFrame:
    """key, score, calibrated: the share of positives of the last block that begins at or below the score, of the first block
    for scores below all; null without a score or without blocks.

    Shares rise with blocks, so the last one is the running maximum among the scores in order: no join of ranges.
    """
    lowest = blocks.agg(F.min_by(F.col("positives") / F.col("n"), "low")).first()[0]
    steps = blocks.select(F.col("low").alias("at"), F.lit(0).alias("kind"), (F.col("positives") / F.col("n")).alias("share"))
    rows = scored.select(F.col(key).alias("key"), F.col(p).cast("double").alias("at"), F.lit(1).alias("kind"))
    both = evidence.running(rows.unionByName(steps, allowMissingColumns=True), [], [F.col("at").asc_nulls_first(), F.col("kind")], [], ["share"])
    out: Column = F.when(F.col("at").isNotNull(), F.coalesce("share_before", F.lit(lowest).cast("double")))
    return both.where("kind = 1").select(F.col("key").alias(key), F.col("at").alias("score"), out.alias("calibrated"))


def reliability(scored: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, positive_share: how often what was scored alike came true, in bins of equal width."""
    known = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(p) * bins))).cast("int")
    return known.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(p)).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("positive_share"))
