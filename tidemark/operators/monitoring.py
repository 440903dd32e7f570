"""Labels from inactivity, and what becomes of a model in use: drift, outcomes that come late and are restated, and whether a
challenger is better by more than chance."""

from __future__ import annotations

import random
from datetime import timedelta
from functools import reduce
from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import evidence
from .skew import join_skewed

#: Share that an empty bin counts as.
FLOOR = 1e-4
#: A prime above the hashes that replicates draw from.
PRIME = (1 << 31) - 1


def label_inactivity(events: DataFrame, instants: DataFrame, *, customer: str, timestamp: str, horizon: timedelta, observation_end, lookback: timedelta | None = None) -> DataFrame:
    """customer, as_of, last_event, next_event, outcome, label for each distinct pair of instants (customer, as_of).

    Events after observation_end are not known yet. The first rule that holds decides: after_observation (as_of later than
    observation_end), never_active (no event up to as_of), already_inactive (the last one longer ago than lookback),
    active (the next event after as_of within the horizon; label 0), censored (the horizon ends after observation_end),
    else inactive (label 1). Instants without customer or time are no_instant. Labels and exclusions add up to the input.

    Last and next events are running maxima over ranges of customer and time, so a customer of any number of events is
    dealt to many tasks, and no list of events is made.
    """
    end = F.lit(observation_end).cast("timestamp_ntz")
    log = events.select(F.col(customer).alias("customer"), F.col(timestamp).cast("timestamp_ntz").alias("t")).where(F.col("customer").isNotNull() & (F.col("t") <= end))
    asked = stored(instants.select("customer", F.col("as_of").cast("timestamp_ntz").alias("as_of")).distinct(), "instants")
    probes = asked.where("customer is not null and as_of is not null").select("customer", F.col("as_of").alias("t"))
    both = log.withColumn("probe", F.lit(0)).union(probes.withColumn("probe", F.lit(1)))
    both = both.withColumn("seen", F.when(F.col("probe") == 0, F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("t")))).withColumn("ahead", -F.col("seen"))
    # events at an instant are no later than it: they come before it in either direction but for the way back
    past = evidence.running(both, ["customer"], [F.col("t"), F.col("probe")], [], ["seen"]).where("probe = 1").select("customer", "t", F.col("seen_before").alias("last"), F.lit(None).cast("long").alias("next"))
    later = evidence.running(both, ["customer"], [F.desc("t"), F.desc("probe")], [], ["ahead"]).where("probe = 1").select("customer", "t", F.lit(None).cast("long").alias("last"), (-F.col("ahead_before")).alias("next"))
    moment = lambda c: F.timestamp_add("MICROSECOND", F.max(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    found = past.union(later).groupBy("customer", "t").agg(moment("last").alias("last_event"), moment("next").alias("next_event"))
    found = found.unionByName(asked.where("customer is null or as_of is null").withColumnRenamed("as_of", "t"), allowMissingColumns=True).withColumnRenamed("t", "as_of")
    until = F.col("as_of") + F.lit(horizon)
    outcome = F.when(F.col("customer").isNull() | F.col("as_of").isNull(), "no_instant").when(F.col("as_of") > end, "after_observation").when(F.col("last_event").isNull(), "never_active")
    if lookback is not None:
        outcome = outcome.when(F.col("last_event") < F.col("as_of") - F.lit(lookback), "already_inactive")
    outcome = outcome.when(F.col("next_event") <= until, "active").when(until > end, "censored").otherwise("inactive")
    return found.withColumn("outcome", outcome).withColumn("label", F.when(F.col("outcome") == "inactive", 1).when(F.col("outcome") == "active", 0))


def drift(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """column, bin, n_baseline, n_current, psi (the bin's part): how far the columns' values have moved between two tables.

    A value's bin is that of the baseline's mass below it, so all bins of the baseline are about equal, ties stay
    together and values beyond its range are in the outer bins; missing values are bin -1. Values of all columns are
    counted first and placed by running sums: no column is a task of its own, and all share their jobs.
    """
    cells = lambda df, name: F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in columns])
    long = lambda df, b, c: df.select(F.explode(cells(df, b)).alias("x"), F.lit(b).alias("b"), F.lit(c).alias("c")).select("x.column", "x.value", "b", "c")
    counted = stored(long(baseline, 1, 0).union(long(current, 0, 1)).groupBy("column", "value").agg(F.sum("b").alias("b"), F.sum("c").alias("c")), "counted")
    placed = evidence.running(counted.where("value is not null"), ["column"], [F.col("value")], ["b"])
    sizes = counted.groupBy("column").agg(F.sum("b").alias("of_b"), F.sum("c").alias("of_c"), F.sum(F.when(F.col("value").isNotNull(), F.col("b"))).alias("known"))
    sizes = F.broadcast(sizes)  # a row per column
    binned = placed.join(sizes, "column").select("column", "b", "c", "of_b", "of_c", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("b_before") * bins, F.col("known"))), F.lit(0))).cast("int").alias("bin"))
    missing = counted.where("value is null").join(sizes, "column").select("column", "b", "c", "of_b", "of_c", F.lit(-1).alias("bin"))
    each = binned.union(missing).groupBy("column", "bin").agg(F.sum("b").alias("n_baseline"), F.sum("c").alias("n_current"), F.first("of_b").alias("of_b"), F.first("of_c").alias("of_c"))
    share = lambda n, of: F.greatest(F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of).cast("double")), F.lit(0.0)), F.lit(FLOOR))
    was, now = share("n_baseline", "of_b"), share("n_current", "of_c")
    return each.select("column", "bin", "n_baseline", "n_current", ((now - was) * F.ln(now / was)).alias("psi"))


def matured(predictions: DataFrame, outcomes: DataFrame, as_of, horizon: timedelta) -> DataFrame:
    """Logged predictions (id, predicted_at, p) with what was known of them at as_of: known_at, y and state.

    Of an id's outcomes (id, known_at, y) that came after the prediction and by as_of the latest counts, as outcomes are
    restated; of outcomes known at one time the largest. state: labelled, pending (the horizon has not passed) or
    unlabelled (it has). Predictions after as_of are left out. An id with very many predictions or outcomes is no
    task of its own.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    logged = stored(predictions.select("id", F.col("predicted_at").cast("timestamp_ntz").alias("predicted_at"), "p").where(F.col("predicted_at") <= now), "logged")
    last = outcomes.select("id", F.col("known_at").cast("timestamp_ntz").alias("known_at"), "y").where((F.col("known_at") <= now) & F.col("id").isNotNull() & F.col("y").isNotNull())
    # the latest outcome of an id by as_of is the latest after each of its predictions, if it is after it at all
    last = stored(last.groupBy("id").agg(F.max(F.struct("known_at", "y")).alias("x")).select("id", "x.known_at", "x.y"), "outcomes")
    hit = join_skewed(logged, last, "id").where("known_at > predicted_at")
    known = stored(hit.select("id", "predicted_at", "p", "known_at", "y"), "matured")
    rest = logged.where("id is null").union(logged.where("id is not null").join(last, "id", "left_anti")).union(join_skewed(logged, last, "id").where("known_at <= predicted_at").select("id", "predicted_at", "p"))
    rest = rest.select("*", F.lit(None).cast("timestamp_ntz").alias("known_at"), F.lit(None).cast(known.schema["y"].dataType).alias("y"))
    state = F.when(F.col("known_at").isNotNull(), "labelled").when(F.col("predicted_at") + F.lit(horizon) > now, "pending").otherwise("unlabelled")
    return known.union(rest).withColumn("state", state)


def replicates(n: int, seed: int) -> list[tuple[int, int, int]]:
    """replicate, a, b: a row's draw of a replicate is a * hash + b modulo PRIME."""
    rng = random.Random(seed)
    return [(r, rng.randrange(1, PRIME), rng.randrange(PRIME)) for r in range(n)]


def poisson_steps() -> list[float]:
    """Probabilities that a Poisson variate of mean one is at most 0, 1, 2 and so on, as far as a draw may tell."""
    return [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(9)]


def paired_bootstrap(scored: DataFrame, key: str, y: str, champion: str, challenger: str, n: int = 200, seed: int = 42) -> DataFrame:
    """replicate, weight, champion, challenger (mean squared errors): each row stands in each replicate as often as a Poisson
    variate of mean one says, which a hash of its key draws for both models alike, so that the replicates' differences
    have no other cause than the rows. Replicate -1 is the table itself. One pass, with partial sums by replicate; runs
    agree however rows are dealt. Rows without a score or outcome are left out."""
    h = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long"), F.lit(PRIME))
    error = lambda p: F.pow(F.col(p) - F.col(y), F.lit(2.0))
    rows = scored.where(F.col(y).isNotNull() & F.col(champion).isNotNull() & F.col(challenger).isNotNull()).select(h.alias("h"), error(champion).alias("e1"), error(challenger).alias("e2"))
    draws = F.array(*[F.struct(F.lit(r).alias("replicate"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for r, a, b in [(-1, 0, 0), *replicates(n, seed)]])
    each = rows.select("h", "e1", "e2", F.explode(draws).alias("d")).select("d.replicate", "e1", "e2", ((F.col("d.a") * F.col("h") + F.col("d.b")) % PRIME / F.lit(float(PRIME))).alias("u"))
    copies = reduce(lambda a, b: a + b, [F.when(F.col("u") >= t, 1).otherwise(0) for t in poisson_steps()])
    w = F.when(F.col("replicate") < 0, 1).otherwise(copies)
    sums = each.withColumn("w", w).groupBy("replicate").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("e1")).alias("s1"), F.sum(F.col("w") * F.col("e2")).alias("s2"))
    return sums.select("replicate", "weight", F.try_divide("s1", F.col("weight").cast("double")).alias("champion"), F.try_divide("s2", F.col("weight").cast("double")).alias("challenger"))


def verdict(replicated: DataFrame, level: float = 0.95) -> DataFrame:
    """gain (the champion's error less the challenger's), low, high (of the replicates, by nearest rank), promoted (low above
    0): one row from paired_bootstrap()'s, of which there are few."""
    gain = F.col("champion") - F.col("challenger")
    out = replicated.agg(F.max(F.when(F.col("replicate") < 0, gain)).alias("gain"), F.array_sort(F.collect_list(F.when(F.col("replicate") >= 0, gain))).alias("all"))
    n, tail = F.size("all"), (1 - level) / 2
    low, high = (F.element_at("all", F.greatest(F.lit(1), F.ceil(n * q)).cast("int")) for q in (tail, 1 - tail))
    return out.select("gain", low.alias("low"), high.alias("high")).withColumn("promoted", F.col("low") > 0)
