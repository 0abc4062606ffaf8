"""Analysis of strategy populations: statistics by iteration, credit of indicator slots, weights and weighted choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.passes import Job, run_pass

PENALTY, LEAST, MOST, START, Q, EVAPORATION = -1000.0, 0.1, 15.0, 1.0, 100.0, 0.1


def decode_vector(df: DataFrame, names: list[str], vector: str = "vector", out: str = "chosen") -> DataFrame:
    """Names of the slots that a 0/1 vector chooses, in order."""
    pairs = F.arrays_zip(F.col(vector).alias("bit"), F.array(*map(F.lit, names)).alias("name"))
    return df.withColumn(out, F.transform(F.filter(pairs, lambda p: p["bit"] == 1), lambda p: p["name"]))


def encode_names(df: DataFrame, names: list[str], chosen: str = "chosen", out: str = "vector") -> DataFrame:
    return df.withColumn(out, F.transform(F.array(*map(F.lit, names)), lambda n: F.array_contains(chosen, n).cast("int")))


def is_valid(entries: Column, exits: Column, low: int = 2, high: int = 5) -> Column:
    return F.size(entries).between(low, high) & F.size(exits).between(low, high)


def fitness_of(profit: Column, error: Column) -> Column:
    """Profit, or the penalty where the evaluation failed."""
    return F.when(error | profit.isNull(), PENALTY).otherwise(profit)


def success(evaluations: DataFrame) -> DataFrame:
    """evaluations, successful, rate from fitness: what is above the penalty succeeded."""
    ok = F.count_if(F.col("fitness") > PENALTY)
    return evaluations.agg(F.count("*").alias("evaluations"), ok.alias("successful"), F.coalesce(F.try_divide(ok.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("rate"))


def iteration_stats(population: DataFrame) -> DataFrame:
    """iteration, best_so_far, iteration_best, mean, std (population), valid over fitness above the penalty; none: 0."""
    f = F.when(F.col("fitness") > PENALTY, F.col("fitness"))
    rows = population.groupBy("iteration").agg(F.max(f).alias("iteration_best"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), F.count(f).alias("valid"))
    w = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)  # a row for each iteration
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.withColumn("best_so_far", F.max("iteration_best").over(w)).select("iteration", zero("best_so_far"), zero("iteration_best"), zero("mean"), zero("std"), "valid")


def slot_credit(population: DataFrame, scale: float = 30_000.0) -> DataFrame:
    """slot, iteration, credit after each iteration, from iteration, fitness and slots (an array of the chosen ones).

    Credit falls by a tenth in every iteration; individuals that chose a slot take Q * |f| / scale from it if their fitness is below zero (and above the
    penalty) and add Q * (f / best so far)^2 / 7 if above. It is held between LEAST and MOST once an iteration. An iteration is a map min(max(a * x + b, lo), hi);
    such maps compose, so a slot's iterations are folded in one pass without a list of them.
    """
    best = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)  # a row for each iteration
    tops = population.groupBy("iteration").agg(F.max("fitness").alias("top_")).withColumn("best_", F.max("top_").over(best)).select("iteration", "best_")
    f = F.col("fitness")
    share = F.when((f > PENALTY) & (f < 0), -Q * F.abs(f) / scale).when((f > 0) & (F.col("best_") > 0), Q * F.pow(f / F.col("best_"), F.lit(2)) / 7).otherwise(0.0)
    deltas = population.join(F.broadcast(tops), "iteration").select("iteration", F.explode("slots").alias("slot"), share.alias("d_")).groupBy("slot", "iteration").agg(F.sum("d_").alias("d_"))
    every = tops.select("iteration").crossJoin(deltas.select("slot").distinct())  # iterations by slots, both few: slots are columns of a vector
    rows = every.join(deltas, ["slot", "iteration"], "left").select("slot", "iteration", F.coalesce("d_", F.lit(0.0)).alias("d_"))
    rows = rows.select("slot", F.col("iteration").cast("int").alias("iteration"), F.lit(1 - EVAPORATION).alias("a_"), "d_")
    job = Job("clamped", ("a_", "d_"), 1, (("least", LEAST), ("most", MOST), ("start", START))).named(("credit",))
    return run_pass(rows, ("slot",), [job], ["slot", "iteration"], order="iteration")


def top_and_bottom(credit: DataFrame, n: int = 5) -> DataFrame:
    """side, place, slot, credit of the last iteration's n best and n worst slots."""
    last = credit.groupBy("slot").agg(F.max_by("credit", "iteration").alias("credit"))
    parts = [last.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, "slot")).alias("place"), "slot", "credit") for side, order in (("top", F.desc("credit")), ("bottom", F.asc("credit")))]  # a row for each slot
    return parts[0].union(parts[1]).filter(F.col("place") <= n)


def slot_weights(credit: DataFrame, eta: dict[str, float], alpha: float = 1.0, beta: float = 2.0, category: str = "category") -> DataFrame:
    """slot, weight: credit^alpha * eta^beta over their sum (eta by category, else 1); a sum of zero gives equal weights."""
    e = F.coalesce(F.create_map(*[F.lit(x) for kv in eta.items() for x in kv])[F.col(category)], F.lit(1.0)) if eta else F.lit(1.0)
    raw = credit.withColumn("raw_", F.pow("credit", F.lit(alpha)) * F.pow(e, F.lit(beta)))
    everything = Window.partitionBy()  # a row for each slot
    total = F.sum("raw_").over(everything)
    return raw.select("slot", F.when(total > 0, F.col("raw_") / total).otherwise(1.0 / F.count("*").over(everything)).alias("weight"))


def choose(weights: DataFrame, draws: DataFrame, low: int = 2, high: int = 5, seed: int = 42) -> DataFrame:
    """draw, slot: for each draw a size between low and high and so many slots without replacement, by weight (least exponential arrival first)."""
    u = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    rows = draws.crossJoin(F.broadcast(weights.filter("weight > 0"))).withColumn("size_", low + F.floor(u("draw") * (high - low + 1)))  # slots are few
    w = Window.partitionBy("draw").orderBy((-F.log(u("draw", "slot"))) / F.col("weight"), "slot")
    return rows.withColumn("r_", F.row_number().over(w)).filter("r_ <= size_").select("draw", "slot")


def credit_summary(credit: DataFrame) -> DataFrame:
    return credit.groupBy("iteration").agg(F.avg("credit").alias("mean"), F.stddev_pop("credit").alias("std"), F.min("credit").alias("min"), F.max("credit").alias("max"))
