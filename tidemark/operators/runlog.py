"""Analysis of optimization logs: one row for each individual of an iteration of a run; lower fitness is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.percentiles import percentiles
from tidemark.functions.running import join_ranks, mean_ranks, running_sums
from tidemark.functions.tails import normal_two_sided, rank_sum_p, smirnov_p, student_two_sided
from tidemark.sources.files import scratch


def features_of(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c.startswith("feat_")]


def parameters_of(log: DataFrame) -> list[str]:
    return [c[:-6] for c in log.columns if c.endswith("_lower") and c[:-6] in log.columns]


def valid(log: DataFrame) -> DataFrame:
    return log.filter("iteration >= 0")


def _long(log: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return log.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keep, "x.*")


def _bound(log: DataFrame, percent: float) -> DataFrame:
    return percentiles(log, "fitness", [percent / 100]).select(F.col("q")[0].alias("bound"))


def with_top(log: DataFrame, percent: float = 10.0) -> DataFrame:
    """Adds top: fitness at or below the percentile (linear between ranks)."""
    return log.join(F.broadcast(_bound(log, percent))).withColumn("top", F.col("fitness") <= F.col("bound")).drop("bound")  # one row


def feature_importance(log: DataFrame) -> DataFrame:
    """name, r (with -fitness), p, abs_r, frequency in top: by absolute correlation."""
    rows = _long(with_top(valid(log)).withColumn("gain", -F.col("fitness")), features_of(log), "gain", "top")
    found = rows.groupBy("name").agg(F.coalesce(F.corr("value", "gain"), F.lit(0.0)).alias("r"), F.count("*").alias("n"), F.avg(F.when(F.col("top"), F.col("value"))).alias("frequency"))
    return found.select("name", "r", student_two_sided(F.col("r"), F.col("n").cast("double")).alias("p"), F.abs("r").alias("abs_r"), "frequency").orderBy(F.desc("abs_r"), "name")


def feature_cosine(log: DataFrame) -> DataFrame:
    """a, b, cosine: how often two features are chosen together, over the root of how often each is (1 for one that never is)."""
    names = features_of(log)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) * F.col(b)).cast("double").alias("both"), (F.col(a) * F.col(a)).cast("double").alias("x"), (F.col(b) * F.col(b)).cast("double").alias("y")) for a in names for b in names if a < b])
    sums = valid(log).select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.sum("both").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return sums.select("a", "b", (F.col("n") / F.sqrt(one("x") * one("y"))).alias("cosine"))


def spearman(log: DataFrame) -> DataFrame:
    """name, rho: rank correlation of each parameter with -fitness, ties by their mean rank.

    Ranks come from counts by value, in ranges of values, so no task puts all values of a parameter in order. Ranks of the gain, which is the same for all parameters,
    are joined to the rows, and rows of one value are summed up before the value's own rank is joined.
    """
    names, spark = parameters_of(log), log.sparkSession
    base = valid(log).select((-F.col("fitness")).alias("gain_"), *[F.col(c).cast("double").alias(c) for c in names])
    n = base.count()
    ranked = join_ranks(base, mean_ranks(base, [], "gain_", "rg_", n), "gain_", n)
    cells = _long(ranked, names, "rg_").groupBy("name", "value").agg(F.count("*").alias("n_"), F.avg("rg_").alias("x_"), (F.count("*") * F.var_pop("rg_")).alias("xx_"))
    values = mean_ranks(_long(base, names), ["name"], "value", "y_", n * len(names))
    path = scratch(spark, "ranks")
    cells.join(values, ["name", "value"]).select("name", "n_", "x_", "xx_", "y_").write.parquet(path)
    both = spark.read.parquet(path)  # a row for each distinct value
    means = both.groupBy("name").agg(*[(F.sum(F.col("n_") * F.col(c)) / F.sum("n_")).alias(f"mean_{c}") for c in ("x_", "y_")])
    x, y = F.col("x_") - F.col("mean_x_"), F.col("y_") - F.col("mean_y_")
    sums = both.join(F.broadcast(means), "name").groupBy("name", "mean_x_", "mean_y_").agg(F.sum("n_").alias("n_"), F.sum(F.col("xx_") + F.col("n_") * x * x).alias("xx_"), F.sum(F.col("n_") * y * y).alias("yy_"), F.sum(F.col("n_") * x * y).alias("xy_"))
    spread = lambda c: F.col(c * 2 + "_") > 1e-28 * F.col("n_") * F.col(f"mean_{c}_") * F.col(f"mean_{c}_")  # noqa: E731  more than what rounding leaves of equal ranks
    return sums.select("name", F.when(spread("x") & spread("y"), F.col("xy_") / (F.sqrt("xx_") * F.sqrt("yy_"))).otherwise(0.0).alias("rho"))


def parameter_ranges(log: DataFrame) -> DataFrame:
    """name, p5, p10, p90, p95 of top rows, lower, upper, utilization (of the bounds by p10..p90, 1 at most), proximity, new_lower, new_upper.

    proximity: narrow (p10..p90 under 30 % of the range), lower_bound or upper_bound (over 30 % of top rows within a fifth of the range from it),
    centered. Recommended bounds go half a range beyond an edge; with under 30 % utilization they close in on p5..p95.
    """
    names = parameters_of(log)
    wide = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.col(f"{c}_lower").cast("double").alias("lo"), F.col(f"{c}_upper").cast("double").alias("hi")) for c in names])
    rows = with_top(valid(log)).filter("top").select(F.explode(wide).alias("x")).select("x.*")
    base = rows.groupBy("name").agg(F.coalesce(F.min("lo"), F.min("value")).alias("lower"), F.coalesce(F.max("hi"), F.max("value")).alias("upper"), F.count("*").alias("n"))
    base = base.join(percentiles(rows, "value", [0.05, 0.1, 0.9, 0.95], ("name",)), "name")
    span = F.col("upper") - F.col("lower")
    edges = rows.join(F.broadcast(base.select("name", "lower", "upper")), "name").groupBy("name").agg(F.avg((F.col("value") <= F.col("lower") + 0.2 * span).cast("double")).alias("low_share"), F.avg((F.col("value") >= F.col("upper") - 0.2 * span).cast("double")).alias("high_share"))
    df = base.join(edges, "name").select("name", "n", "lower", "upper", *[F.col("q")[k].alias(p) for k, p in enumerate(("p5", "p10", "p90", "p95"))], "low_share", "high_share")
    used = F.col("p90") - F.col("p10")
    df = df.withColumn("utilization", F.when(span <= 0, 1.0).otherwise(F.least(used / F.nullif(span, F.lit(0.0)), F.lit(1.0))))
    df = df.withColumn("proximity", F.when(used < 0.3 * span, "narrow").when(F.col("low_share") > 0.3, "lower_bound").when(F.col("high_share") > 0.3, "upper_bound").otherwise("centered"))
    margin = 0.2 * (F.col("p90") - F.col("p10"))
    tight = F.col("utilization") < 0.3
    lower = F.when(F.col("proximity") == "lower_bound", F.col("lower") - 0.5 * span).when(F.col("proximity") == "upper_bound", F.col("lower")).when(tight, F.greatest(F.col("p5") - margin, 0.5 * F.col("lower"))).otherwise(F.col("lower"))
    upper = F.when(F.col("proximity") == "upper_bound", F.col("upper") + 0.5 * span).when(F.col("proximity") == "lower_bound", F.col("upper")).when(tight, F.least(F.col("p95") + margin, 1.5 * F.col("upper"))).otherwise(F.col("upper"))
    return df.withColumn("new_lower", lower).withColumn("new_upper", upper)


def progression(log: DataFrame) -> DataFrame:
    """iteration, best: minus the least fitness."""
    return valid(log).groupBy("iteration").agg((-F.min("fitness")).alias("best"))


def convergence(log: DataFrame) -> DataFrame:
    """rate (1 - last over first iteration's sample variance, 0 at least) and converged (0.7 or more); under two iterations 0."""
    by = valid(log).groupBy("iteration").agg(F.var_samp("fitness").alias("v"))
    ends = by.agg(F.min_by("v", "iteration").alias("first"), F.max_by("v", "iteration").alias("last"), F.count("*").alias("n"))
    first, last = F.coalesce("first", F.lit(0.0)), F.coalesce("last", F.lit(0.0))
    rate = F.when(F.col("n") < 2, 0.0).when(first == 0, F.when(last == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - last / F.nullif(first, F.lit(0.0))))
    return ends.select(rate.alias("rate"), (rate >= 0.7).alias("converged"))


def feature_stability(log: DataFrame) -> DataFrame:
    """name, stability (1 - population variance of its rate over iterations), mean_rate."""
    rates = _long(valid(log), features_of(log), "iteration").groupBy("name", "iteration").agg(F.avg("value").alias("rate"))
    return rates.groupBy("name").agg((1 - F.var_pop("rate")).alias("stability"), F.avg("rate").alias("mean_rate"))


def elite(log: DataFrame, percent: float = 10.0) -> DataFrame:
    """n, n_elite, fraction, best fitness and each feature's rate among the elite."""
    df = with_top(valid(log), percent)
    return df.agg(F.count("*").alias("n"), F.count_if("top").alias("n_elite"), F.avg(F.col("top").cast("double")).alias("fraction"), F.min("fitness").alias("best"), *[F.avg(F.when(F.col("top"), F.col(f).cast("double"))).alias(f"{f}_rate") for f in features_of(log)])


def elite_tests(log: DataFrame, percent: float = 10.0) -> DataFrame:
    """name, cohens_d, ks, ks_p, u, u_p, influence, low, high, rank, effect: each parameter of the elite against the rest.

    d: pooled sample deviation, 0 if there is none. D is exact; its p is that of all orders for samples of up to 10,000, asymptotic beyond. U is the elite's; without ties
    and with a sample of up to 8 its p is that of all orders, else normal with ties and continuity corrected. low and high: the elite's 5th and
    95th percentiles, linear between ranks. All come from counts by distinct value, so nothing larger than these is put in order.
    """
    rows = _long(with_top(valid(log), percent), parameters_of(log), "top")
    t, value = F.col("top"), F.col("value")
    stats = rows.groupBy("name").agg(*[f(F.when(c, value)).alias(f"{k}{s}") for s, c in (("1", t), ("0", ~t)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    counts = rows.groupBy("name", "value").agg(F.count_if(t).alias("c1"), F.count_if(~t).alias("c0"))
    counts = running_sums(counts, ["name"], ["value"], {"f1": "c1", "f0": "c0"}).join(F.broadcast(stats.select("name", "n1", "n0")), "name")
    c = F.col("c1") + F.col("c0")
    rank = F.col("f1") + F.col("f0") - c + (c + 1) / 2.0
    gap = F.abs(F.try_divide(F.col("f1"), F.col("n1")) - F.try_divide(F.col("f0"), F.col("n0")))

    def at(q: float, up: bool) -> Column:
        place = (F.col("n1") - 1) * q
        return F.min(F.when(F.col("f1") > (F.ceil(place) if up else F.floor(place)), F.col("value")))

    ranges = [at(q, up).alias(f"{k}{int(up)}") for k, q in (("low", 0.05), ("high", 0.95)) for up in (False, True)]
    sums = counts.groupBy("name").agg(*ranges, F.max(gap).alias("ks"), F.sum(F.col("c1") * rank).alias("ranks"), F.sum(c.cast("double") * c * c - c).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    pooled = F.sqrt(((n1 - 1) * F.coalesce("v1", F.lit(0.0)) + (n0 - 1) * F.coalesce("v0", F.lit(0.0))) / F.nullif(n - 2, F.lit(0.0)))
    df = stats.join(sums, "name").withColumn("cohens_d", F.coalesce(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled), F.lit(0.0)))
    df = df.withColumn("u", F.col("ranks") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0)) / F.nullif(spread, F.lit(0.0))
    normal = F.coalesce(normal_two_sided(z), F.lit(1.0))
    df = df.withColumn("u_p", F.when(F.col("ties") == 0, rank_sum_p(F.col("u"), n1, n0, normal)).otherwise(normal)).withColumn("ks_p", F.coalesce(smirnov_p(F.col("ks"), n1, n0), F.lit(1.0)))
    influence = 0.4 * F.least(F.abs("cohens_d"), F.lit(2.0)) / 2 + 0.3 * F.col("ks") + 0.3 * (1 - F.least("ks_p", "u_p"))
    between = lambda k, q: (F.col(f"{k}0") + (F.col(f"{k}1") - F.col(f"{k}0")) * (((F.col("n1") - 1) * q) % 1)).alias(k)
    df = df.select("name", "cohens_d", "ks", "ks_p", "u", "u_p", influence.alias("influence"), between("low", 0.05), between("high", 0.95))
    df = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("influence"), "name")))  # a row for each parameter
    return df.withColumn("effect", describe(*map(F.col, ("cohens_d", "ks", "ks_p", "low", "high"))))


#: The words for the least size of an effect, for the p below which and the D above which a difference counts.
EFFECTS = ((0.8, "very large"), (0.5, "medium"), (0.2, "small"))
SIGNIFICANCE = ((0.01, "highly significant (p<0.01)"), (0.05, "significant (p<0.05)"))
DIFFERENCES = ((0.3, "distinct distribution"), (0.15, "moderate distribution shift"))


def describe(d: Column, ks: Column, ks_p: Column, low: Column, high: Column) -> Column:
    """Size and direction of the effect, significance, difference of distributions (none if small) and the elite's range, in words."""

    def choice(cases, otherwise: str | None) -> Column:
        out = F.lit(otherwise)
        for condition, word in reversed(cases):
            out = F.when(condition, word).otherwise(out)
        return out

    size = choice([(F.abs(d) >= least, word) for least, word in EFFECTS], "negligible")
    side = F.when(d > 0, "higher").otherwise("lower")
    sure = choice([(ks_p < most, word) for most, word in SIGNIFICANCE], "not significant")
    apart = choice([(ks > above, word) for above, word in DIFFERENCES], None)
    return F.concat_ws("; ", F.concat(size, F.lit(" effect ("), side, F.lit(" in elites)")), sure, apart, F.format_string("elite range: [%.4f, %.4f]", low, high))


def suggestions(importance: DataFrame) -> DataFrame:
    """keep (|r| > 0.1 and frequency > 0.5), consider_removing (< 0.02 and < 0.2) or neutral."""
    keep, drop = (F.col("abs_r") > 0.1) & (F.col("frequency") > 0.5), (F.col("abs_r") < 0.02) & (F.col("frequency") < 0.2)
    return importance.select("name", "abs_r", "frequency", F.when(keep, "keep").when(drop, "consider_removing").otherwise("neutral").alias("suggestion"))


def settings_advice(log: DataFrame, iterations: float = 100, pf_max: float = 0.1) -> DataFrame:
    """iterations (half as many more if the last five are still moving), pf_max (half as much more, 0.2 at most, once converged)."""
    w = Window.orderBy("iteration")  # a row for each iteration
    steps = progression(log).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    spread = lambda c: F.max(F.when(c, F.col("best"))) - F.min(F.when(c, F.col("best")))
    ends = steps.agg(F.max("n").alias("n"), spread(F.col("i") <= 5).alias("early"), spread(F.col("i") > F.col("n") - 5).alias("late")).crossJoin(F.broadcast(convergence(log)))  # one row each
    moving = (F.col("n") > 5) & (F.col("late") > 0.1 * F.col("early"))
    return ends.select("n", "early", "late", F.when(moving, iterations * 1.5).otherwise(float(iterations)).alias("iterations"), F.when(F.col("rate") > 0.8, F.least(F.lit(0.2), F.lit(1.5 * pf_max))).otherwise(pf_max).alias("pf_max"))


def confidence(log: DataFrame) -> DataFrame:
    """Mean of min(5 * largest |r|, 1), 1 - population deviation of utilization and, with more than one iteration, min(improvement, 1)."""
    r = feature_importance(log).agg(F.least(5 * F.max("abs_r"), F.lit(1.0)).alias("a"))
    u = parameter_ranges(log).agg((1 - F.stddev_pop("utilization")).alias("b"))
    p = progression(log).agg(F.min_by("best", "iteration").alias("first"), F.max("best").alias("top"), F.count("*").alias("n"))
    df = r.crossJoin(u).crossJoin(p)  # one row each
    gain = F.least((F.col("top") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0)), F.lit(1.0))
    return df.select(F.when(F.col("n") > 1, (F.col("a") + F.col("b") + F.coalesce(gain, F.lit(0.0))) / 3).otherwise((F.col("a") + F.col("b")) / 2).alias("confidence"))


def report(log: DataFrame, percent: float = 10.0) -> DataFrame:
    """One row: run_ids, n, iterations, best_fitness, best (the whole individual; of equal ones the first by run, iteration and place), rate and converged,
    confidence, bounds (recommended, by parameter), settings and top_percentile."""
    df = valid(log)
    first = F.struct(*[c for c in ("fitness", "run_id", "iteration", "individual_idx") if c in df.columns])
    own = [c for c in df.columns if not c.endswith(("_lower", "_upper"))]
    totals = df.agg(
        F.sort_array(F.collect_set("run_id")).alias("run_ids"), F.count("*").alias("n"), F.count_distinct("iteration").alias("iterations"), F.min("fitness").alias("best_fitness"), F.min_by(F.struct(*own), first).alias("best"),
    )
    ranges = parameter_ranges(log).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct(F.col("new_lower").alias("lower"), F.col("new_upper").alias("upper")))))).alias("bounds"))
    advice = settings_advice(log).select(F.struct(F.col("iterations").alias("iterations"), "pf_max").alias("settings"))
    return totals.crossJoin(convergence(log)).crossJoin(confidence(log)).crossJoin(ranges).crossJoin(advice).withColumn("top_percentile", F.lit(percent))  # one row each
