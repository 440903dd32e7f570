"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations alone.

The corpus is cut into equal blocks of words. Blocks ("seats") go to sources by their highest quotients
target / (2 * seats + 1), so every shard of the mix has an integer quota of blocks for every source. Each source's
documents are laid out in a seeded order and its quota takes blocks from the front of that order, going round again
once all blocks are used. Whole documents are therefore kept or left; at most one per source is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, table, word_count

SEED = 20240601
BLOCK_WORDS = 16
N_SHARDS = 16
MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)


def weigh(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add rank and weight: sources by code point, null last, weigh weights[0], weights[1], ... and round again."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choices = F.array(*[F.lit(int(w)) for w in weights])
    return sources.withColumn("rank", rank).withColumn("weight", F.element_at(choices, (F.col("rank") % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add target: shares of the total by weight, none above max_epochs times its source's size.

    Sources sorted by how soon they reach their limit are filled like vessels: those in front of the first one that
    its share does not fill keep their limit, the others share the rest by weight.
    """
    everything = Window.partitionBy()
    limit = F.col("source_size") * max_epochs
    filled = Window.orderBy(limit / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(filled), F.lit(0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    shared = sources.withColumn("level", level).withColumn("open", F.col("level") <= limit / F.col("weight"))
    level = F.max_by("level", F.when(F.col("open"), -(limit / F.col("weight")))).over(everything)
    return shared.withColumn("target", F.least(limit.cast("double"), F.coalesce(level * F.col("weight"), limit.cast("double")))).drop("level", "open")


def apportion(parties: DataFrame, seats: Column, *, votes: str, order: str, by: list[str]) -> DataFrame:
    """Add quota: seats of each party by Sainte-Laguë within each group of `by`; ties go to the lower `order`.

    Rounding votes * seats / total misses the seats by half the parties at most, so only quotients near that line can
    decide. A party is given its certain seats and as many candidates as its share of such a miss, which makes the
    candidates a small multiple of the parties, however many seats there are.
    """
    group = Window.partitionBy(*by)
    fair = F.coalesce(F.try_divide(F.col(votes) * F.col("_seats"), F.col("_votes")), F.lit(0.0))
    spread = F.ceil(F.coalesce(F.try_divide(F.col(votes) * 1.5 * F.col("_parties"), F.col("_votes")), F.lit(0.0))) + 2
    asked = (
        parties.withColumn("_seats", seats)
        .withColumns({"_votes": F.sum(votes).over(group), "_parties": F.count(F.lit(1)).over(group)})
        .withColumn("_sure", F.greatest(F.lit(0), F.floor(fair + 0.5) - spread).cast("long"))
        .withColumn("_spread", spread.cast("long"))
    )
    ranked = (
        asked.withColumn("_seat", F.explode(F.expr("sequence(_sure, _sure + 2 * _spread)")))
        .withColumn("_place", F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("_seat") + 1)), order)))
        .withColumn("_free", F.col("_seats") - F.sum(F.when(F.col("_seat") == F.col("_sure"), F.col("_sure"))).over(group))
    )
    won = (F.col("_place") <= F.col("_free")) & (F.col(votes) > 0)
    return ranked.groupBy(*parties.columns).agg((F.max("_sure") + F.count_if(won)).cast("long").alias("quota"))


def shard_quotas(sources: DataFrame, *, block_words: int, n_shards: int, max_epochs: int) -> DataFrame:
    """One row per source: blocks it has, blocks the mix takes (quota) and the quota's running sums by shard (ends).

    The seats of shards 0..k together are apportioned for each k; as Sainte-Laguë never takes a seat back when more
    are given out, the differences are each shard's own integer quotas.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    each = sources.withColumn("_all", F.floor((total * 2 + block_words) / (2 * block_words)).cast("long"))
    each = each.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    quotas = apportion(each, F.floor(F.col("_all") * F.col("shard") / n_shards).cast("long"), votes="target", order="rank", by=["shard"])
    blocks = F.greatest(F.lit(1), F.floor((F.col("source_size") * 2 + block_words) / (2 * block_words))).cast("long")
    return (
        quotas.withColumn("blocks", blocks)
        .withColumn("quota", F.least("quota", F.col("blocks") * max_epochs))
        .groupBy("source", "source_size", "target", "blocks")
        .agg(F.max("quota").alias("quota"), F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("ends"))
    )


def times_over(a: Column, b: Column, c: Column) -> Column:
    """a * b div c of longs with a result that is a long; the product may be one no more."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(b), c).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """What documents are laid out by; equal ids, and missing ones, follow each other by size."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(documents: DataFrame, *, seed: int = SEED, block_words: int = BLOCK_WORDS, n_shards: int = N_SHARDS, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of documents (doc_id, text, source; other columns are ignored).

    size: words; source_size, target, quota (blocks), blocks, ends: its source's; passes: whole times that the mix
    takes the document; part: words taken once more, from its start; taken = passes * size + part; first_block: where
    it starts in its source's seeded order; order: what that order goes by. A null text is of size 0; a null source is a
    source of its own; rows with equal or null doc_id are laid out one after another by size. An empty table gives an
    empty result. The order is dealt to tasks in stretches of equal length, whatever ids repeat.
    """
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed).alias("order"), F.monotonically_increasing_id().alias("place"))
    sized = stored(sized)
    sized = stored(sized.repartitionByRange("source", "order", "doc_id", "size", "place").withColumn("stretch", F.spark_partition_id()))

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = shard_quotas(targets(weigh(sources, weights), max_epochs), block_words=block_words, n_shards=n_shards, max_epochs=max_epochs)
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sized.groupBy("source", "stretch").agg(F.sum("size").alias("words")).withColumn("stretch_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = stretches.alias("a").join(quotas.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target", "blocks", "quota", "ends")

    running = Window.partitionBy("source", "stretch").orderBy("order", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(running), F.lit(0)))
    both = placed.alias("d").join(small(stored(plan)).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.stretch") == F.col("p.stretch")))
    start = F.col("stretch_start") + F.col("within")
    cut = times_over(F.expr("quota % blocks"), F.col("source_size"), F.col("blocks"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), cut - start))
    passes = F.expr("quota div blocks")
    return both.select(
        "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"),
        passes.alias("passes"), part.cast("long").alias("part"), "quota", "blocks", "ends",
        F.coalesce(times_over(start, F.col("blocks"), F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).alias("first_block"), "order",
    )


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Number the rows (a stored table) of each value of `by` from 0, in the order they are stored: within each stretch
    of the table first, so that a value of any number of rows is dealt to as many tasks as there are stretches."""
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("_stretch", F.shiftright("_place", 33))
    rows = stored(rows)
    sizes = rows.groupBy(by, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(by, "_stretch").orderBy("_place")) - 1
    both = rows.withColumn("_within", within).alias("r").join(sizes.alias("s"), F.col(f"r.{by}").eqNullSafe(F.col(f"s.{by}")) & (F.col("r._stretch") == F.col("s._stretch")))
    return both.select(*[f"r.{c}" for c in rows.columns if c not in ("_place", "_stretch")], (F.col("_before") + F.col("r._within")).alias(name))


def mixed_rows(documents: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The mix itself, word for word what mix() plans: a row per copy of a document, with documents' columns (a last
    partial copy is cut after its part words); documents without words, and those the mix does not take, have none.

    Only the place where each source's quota ends is joined to the documents: what comes before it in the seeded order
    is taken once more than what comes after. Rows of the very id and size at that place are told apart by a number.
    """
    planned = stored(mix(documents, seed=seed, **options).select("source", "size", "passes", "part", F.struct("order", "doc_id", "size").alias("key")))
    last = planned.groupBy("source").agg(F.max("passes").alias("passes"), F.max(F.when(F.col("part") > 0, F.col("key"))).alias("last"))
    last = stored(last)
    met = planned.alias("a").join(small(last).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.key") == F.col("b.last")))
    ties = met.groupBy("a.source").agg(F.count_if(F.col("part") == F.col("a.size")).alias("whole"), F.max(F.when(F.col("part") < F.col("a.size"), F.col("part"))).alias("rest"))
    ends = last.alias("a").join(ties.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(F.struct("a.source", "passes", "last", "whole", "rest").alias("_end"))
    ends = small(stored(ends))

    there = documents.select(F.struct("*").alias("_doc"), word_count(F.col("text")).alias("_words"), F.struct(seeded(F.col("doc_id"), seed), "doc_id").alias("_id"), F.col("source").alias("_source"))
    there = there.where("_words > 0").join(ends, F.col("_source").eqNullSafe(F.col("_end.source")))
    key = F.struct(F.col("_id.col1").alias("order"), F.col("_id.doc_id"), F.col("_words").alias("size"))
    there = there.withColumn("_side", F.when(F.col("_end.last").isNull() | (key > F.col("_end.last")), 1).when(key < F.col("_end.last"), -1).otherwise(0))
    clear = there.where("_side <> 0").select("_doc", "_words", "_end.passes", F.when(F.col("_side") < 0, F.col("_words")).otherwise(F.lit(0)).alias("part"))
    tied = numbered(there.where("_side = 0").select("_doc", "_words", "_source", "_end"), "_source", "_number")
    part = F.when(F.col("_number") < F.col("_end.whole"), F.col("_words")).when(F.col("_number") == F.col("_end.whole"), F.coalesce("_end.rest", F.lit(0))).otherwise(F.lit(0))
    rows = clear.union(tied.select("_doc", "_words", "_end.passes", part.alias("part")))
    copies = rows.select("_doc", "_words", F.explode(F.expr("concat(array_repeat(_words, cast(passes as int)), if(part > 0, array(part), array()))")).alias("_taken"))
    text = F.when(F.col("_taken") < F.col("_words"), first_words(F.col("_doc.text"), F.col("_taken"))).otherwise(F.col("_doc.text"))
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.char_length(text).cast(documents.schema["n_chars"].dataType)
    return copies.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in documents.columns])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    start = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    return F.regexp_replace(F.concat(start, F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")), r"[\x20\x09-\x0D]+$", "")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op2_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM src),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
tot AS (SELECT CAST(sum(s) AS BIGINT) AS t FROM weighed),
steps AS (
  SELECT a.source, a.s, a.w, a.rk,
    CAST((SELECT t FROM tot) - coalesce(sum(3 * b.s), 0) AS DOUBLE) / CAST((SELECT sum(w) FROM weighed) - coalesce(sum(b.w), 0) AS DOUBLE) AS lvl
  FROM weighed a LEFT JOIN weighed b
    ON CAST(3 * b.s AS DOUBLE) / b.w < CAST(3 * a.s AS DOUBLE) / a.w OR (CAST(3 * b.s AS DOUBLE) / b.w = CAST(3 * a.s AS DOUBLE) / a.w AND b.rk < a.rk)
  GROUP BY a.source, a.s, a.w, a.rk),
lvl AS (SELECT arg_min(lvl, CAST(3 * s AS DOUBLE) / w) AS l FROM steps WHERE lvl <= CAST(3 * s AS DOUBLE) / w),
tgt AS (SELECT source, s, rk, least(CAST(3 * s AS DOUBLE), coalesce((SELECT l FROM lvl) * w, CAST(3 * s AS DOUBLE))) AS target FROM weighed),
seats AS (SELECT (2 * t + {BLOCK_WORDS}) // (2 * {BLOCK_WORDS}) AS n FROM tot),
quotients AS (
  SELECT source, rk, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rk) AS place
  FROM (SELECT source, rk, target, unnest(range(CAST(ceil(target / {BLOCK_WORDS}) AS BIGINT) + 4)) AS k FROM tgt WHERE target > 0)),
quota AS (SELECT rk, count(*) AS q FROM quotients WHERE place <= (SELECT n FROM seats) GROUP BY rk),
planned AS (
  SELECT tgt.source, s, target, greatest(1, (2 * s + {BLOCK_WORDS}) // (2 * {BLOCK_WORDS})) AS n, coalesce(q, 0) AS q
  FROM tgt LEFT JOIN quota USING (rk)),
capped AS (SELECT source, s, target, n, least(q, {MAX_EPOCHS} * n) AS q FROM planned),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sized)
SELECT doc_id, size, s AS source_size, target,
  CAST((q // n) * size + greatest(0, least(size, ((q % n) * s) // n - a)) AS BIGINT) AS taken
FROM placed d JOIN capped p ON d.source IS NOT DISTINCT FROM p.source
""",
}
