"""Association of 0/1 features with a class: statistics from one pass of counts, and rules.

All statistics of all features come from one aggregation of the long form to n, n1 (class trade), sx (rows with the feature) and sxy (both); what
follows is arithmetic on a row for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tails import chi2_tail, fisher_p, student_two_sided
from tidemark.sources.files import scratch

MOST = 1000.0


def feature_counts(df: DataFrame, features: list[str], target: str = "tradeable", positive: str = "trade") -> DataFrame:
    """feature, n, n1, sx, sxy."""
    y = (F.coalesce(F.col(target), F.lit("hold")) == positive).cast("long")
    sums = df.agg(F.count("*").alias("n"), F.sum(y).alias("n1"), *[F.sum(F.col(f).cast("long") * k).alias(f"{f}__{name}") for f in features for name, k in (("sx", F.lit(1)), ("sxy", y))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), "n", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce(f"{f}__sx", F.lit(0)).alias("sx"), F.coalesce(f"{f}__sxy", F.lit(0)).alias("sxy")) for f in features])).alias("c")).select("c.*")


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def chi_square(counts: DataFrame) -> DataFrame:
    """Adds chi2 and chi2_p: sums of the feature by class against what the classes' shares give, with one degree of freedom."""
    e1, e0 = _d("sx") * _d("n1") / _d("n"), _d("sx") * (_d("n") - _d("n1")) / _d("n")
    o1, o0 = _d("sxy"), _d("sx") - _d("sxy")
    chi2 = F.coalesce(F.try_divide((o1 - e1) * (o1 - e1), e1) + F.try_divide((o0 - e0) * (o0 - e0), e0), F.lit(0.0))
    return counts.withColumn("chi2", chi2).withColumn("chi2_p", chi2_tail(F.col("chi2")))


def mutual_information(counts: DataFrame) -> DataFrame:
    """Adds mi (natural logarithm, 0 at least) of feature and class."""
    n = _d("n")
    cells = [(_d("sxy"), _d("sx"), _d("n1")), (_d("sx") - _d("sxy"), _d("sx"), n - _d("n1")), (_d("n1") - _d("sxy"), n - _d("sx"), _d("n1")), (n - _d("sx") - _d("n1") + _d("sxy"), n - _d("sx"), n - _d("n1"))]
    mi = sum((F.when(c > 0, c / n * F.log(c * n / F.nullif(a * b, F.lit(0.0)))).otherwise(0.0) for c, a, b in cells), F.lit(0.0))
    return counts.withColumn("mi", F.greatest(mi, F.lit(0.0)))


def point_biserial(counts: DataFrame) -> DataFrame:
    """Adds r_pb and r_pb_p; a constant side gives 0 and 1."""
    n = _d("n")
    below = F.sqrt(_d("sx") * (n - _d("sx")) * _d("n1") * (n - _d("n1")))
    r = F.coalesce(F.try_divide(n * _d("sxy") - _d("sx") * _d("n1"), F.nullif(below, F.lit(0.0))), F.lit(0.0))
    return counts.withColumn("r_pb", r).withColumn("r_pb_p", F.when(below > 0, student_two_sided(r, n)).otherwise(1.0))


def fisher(counts: DataFrame) -> DataFrame:
    """Adds odds_ratio (1000 if infinite) and fisher_p (two-sided) of feature by class."""
    a, b = F.col("sxy"), F.col("sx") - F.col("sxy")
    c, d = F.col("n1") - F.col("sxy"), F.col("n") - F.col("sx") - F.col("n1") + F.col("sxy")
    odds = F.when((b * c) == 0, F.when((a * d) == 0, F.lit(None)).otherwise(MOST)).otherwise(F.try_divide((a * d).cast("double"), (b * c).cast("double")))
    return counts.withColumn("odds_ratio", odds).withColumn("fisher_p", fisher_p(a, b, c, d))


def lift(counts: DataFrame) -> DataFrame:
    """Adds trade_support, hold_support and lift of the feature for trades; 1 for a constant feature."""
    n, constant = _d("n"), (F.col("sx") == 0) | (F.col("sx") == F.col("n"))
    value = F.when(constant, 1.0).otherwise(F.coalesce(F.try_divide(_d("sxy") * n, F.nullif(_d("sx") * _d("n1"), F.lit(0.0))), F.lit(1.0)))
    return counts.withColumn("trade_support", _d("sxy") / n).withColumn("hold_support", (_d("sx") - _d("sxy")) / n).withColumn("lift", value)


def all_statistics(counts: DataFrame) -> DataFrame:
    """All of the above and composite: a quarter each of scaled chi2, MI and lift (10 at most) and 1 - fisher_p; scaled constants count 0."""
    df = lift(fisher(point_biserial(mutual_information(chi_square(counts)))))
    everything = Window.partitionBy()  # a row for each feature

    def scaled(c: Column) -> Column:
        low, high = F.min(c).over(everything), F.max(c).over(everything)
        return F.when(high > low, (c - low) / (high - low)).otherwise(0.0)

    capped = F.least(F.greatest("lift", F.lit(0.0)), F.lit(10.0))
    return df.withColumn("composite", 0.25 * scaled(F.col("chi2")) + 0.25 * scaled(F.col("mi")) + 0.25 * scaled(capped) + 0.25 * (1 - F.col("fisher_p")))


def ranked(stats: DataFrame, by: str = "composite") -> DataFrame:
    """Best first: p values ascending, all else descending; an unknown name ranks by composite. Ties by feature."""
    by = by if by in ("composite", "chi2", "mi", "lift", "fisher_p") else "composite"
    return stats.orderBy(F.asc(by) if by == "fisher_p" else F.desc(by), "feature")


def percentile_mask(stats: DataFrame, percent: float = 50.0, by: str = "composite") -> DataFrame:
    """feature, score, selected: whether the score reaches the percentile (linear between ranks)."""
    bound = F.percentile(by, F.lit(percent / 100)).over(Window.partitionBy())
    return stats.select("feature", F.col(by).alias("score"), (F.col(by) >= bound).alias("selected"))


def overview(stats: DataFrame) -> DataFrame:
    """significant (chi2_p < 0.05), lift counts above 1, 1.2, 1.5, 2 and 3, mean_mi."""
    return stats.agg(F.count_if(F.col("chi2_p") < 0.05).alias("significant"), *[F.count_if(F.col("lift") > k).alias(f"lift_above_{name}") for k, name in ((1.0, "1"), (1.2, "1_2"), (1.5, "1_5"), (2.0, "2"), (3.0, "3"))], F.avg("mi").alias("mean_mi"))


def _rows_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as a 0/1 matrix of features, their number, and the number of those with the class."""
    on, y, k = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    x = np.zeros((batch.num_rows, width))
    x[np.repeat(np.arange(batch.num_rows), pc.list_value_length(on).to_numpy(zero_copy_only=False)), on.flatten().to_numpy(zero_copy_only=False)] = 1
    return x, k.astype(float), (k * y).astype(float)


def _pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """a, b, n_set, n_both of all features (a = b) and pairs that rows have, and of all rows (a = b = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, every, totals = np.zeros((width, width)), np.zeros((width, width)), np.zeros(2)
        for batch in batches:
            x, k, ky = _rows_of(batch, width)
            every += x.T @ (x * k[:, None])
            both += x.T @ (x * ky[:, None])
            totals += k.sum(), ky.sum()
        a, b = np.nonzero(np.triu(every))
        columns = [np.append(a, -1), np.append(b, -1), np.append(every[a, b], totals[0]), np.append(both[a, b], totals[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "n_set", "n_both"])

    return rows.mapInArrow(run, "a long, b long, n_set long, n_both long").groupBy("a", "b").agg(F.sum("n_set").alias("n_set"), F.sum("n_both").alias("n_both"))


def _grown_counts(rows: DataFrame, width: int, sets: np.ndarray, last: list[np.ndarray], together: int = 1024) -> DataFrame:
    """prefix, feature, n_set, n_both of each set (a row of ``sets``) with each of its features in ``last``."""
    sizes = np.array([len(x) for x in last])
    flat, prefix = np.concatenate(last), np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, both = np.zeros(len(flat)), np.zeros(len(flat))
        for batch in batches:
            x, k, ky = _rows_of(batch, width)
            for lo in range(0, len(sets), together):
                some = sets[lo : lo + together]
                held = np.ones((len(x), len(some)))
                for place in range(sets.shape[1]):
                    held *= x[:, some[:, place]]
                own = slice(starts[lo], starts[min(lo + together, len(sets))])
                every[own] += (held.T @ (x * k[:, None]))[prefix[own] - lo, flat[own]]
                both[own] += (held.T @ (x * ky[:, None]))[prefix[own] - lo, flat[own]]
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(c[some].astype(np.int64)) for c in (prefix, flat, every, both)], ["prefix", "feature", "n_set", "n_both"])

    return rows.mapInArrow(run, "prefix long, feature long, n_set long, n_both long").groupBy("prefix", "feature").agg(F.sum("n_set").alias("n_set"), F.sum("n_both").alias("n_both"))


def rules(df: DataFrame, features: list[str], target: str = "tradeable", positive: str = "trade", least_support: float = 0.01, least_confidence: float = 0.3, least_lift: float = 1.0, longest: int = 3, most: int = 1000) -> DataFrame:
    """antecedent (sorted names), n_both, support, confidence, lift, leverage, conviction of rules {features} -> trade; the ``most`` of highest lift.

    Rows that agree in all features and the class are one, and are written once; what follows reads only these. All features and pairs are counted in one
    pass, as a product of 0/1 matrices. Larger sets grow by one feature, and only where all that they are made of is frequent with trade; a pass counts all
    of a size. What tasks send is a number for each set, and the driver holds the frequent sets that still grow (features times features of them for the usual three).
    """
    names, spark = sorted(features), df.sparkSession
    y = (F.coalesce(F.col(target), F.lit("hold")) == positive).cast("int")
    on = F.filter(F.array(*[F.when(F.col(f) == 1, k) for k, f in enumerate(names)]), lambda c: c.isNotNull())
    path = scratch(spark, "feature-sets")
    df.select(on.alias("on"), y.alias("y")).groupBy("on", "y").agg(F.count("*").alias("k")).write.parquet(path)
    rows = spark.read.parquet(path).select("on", "y", "k")
    pairs = {(r.a, r.b): (r.n_set, r.n_both) for r in _pair_counts(rows, len(names)).collect()}  # features times features
    n, n1 = pairs.pop((-1, -1), (0, 0))
    frequent = {p: c for p, c in pairs.items() if c[1] >= least_support * n and n}
    schema = "set array<string>, n_set long, n_both long"
    small = [([names[a]] if a == b else [names[a], names[b]], *c) for (a, b), c in frequent.items() if a == b or longest > 1]
    found, sets = spark.createDataFrame(small, schema), sorted([p for p in frequent if p[0] != p[1]])
    near = {a: {b for b in range(len(names)) if (min(a, b), max(a, b)) in frequent and a != b} for a in range(len(names))}
    for size in range(3, longest + 1):
        grown = [(s, sorted(x for x in set.intersection(*(near[f] for f in s)) if x > s[-1])) for s in sets]
        grown = [(s, x) for s, x in grown if x]
        if not grown:
            break
        counted = _grown_counts(rows, len(names), np.array([s for s, _ in grown]), [np.array(x) for _, x in grown]).filter(F.col("n_both") >= least_support * n)
        prefixes = spark.createDataFrame([(k, [names[f] for f in s]) for k, (s, _) in enumerate(grown)], "prefix long, names array<string>")
        at = F.array(*map(F.lit, names))
        counted = counted.join(prefixes, "prefix").select(F.concat("names", F.array(F.get(at, F.col("feature").cast("int")))).alias("set"), "n_set", "n_both", "prefix", "feature")
        found = found.unionByName(counted.drop("prefix", "feature"))
        if size < longest:
            sets = sorted((*grown[r.prefix][0], r.feature) for r in counted.select("prefix", "feature").collect())
    n, share = F.lit(float(n)), F.lit(n1 / n if n else 0.0)
    confidence = _d("n_both") / _d("n_set")
    out = found.select(
        F.col("set").alias("antecedent"), "n_both", (_d("n_both") / n).alias("support"), confidence.alias("confidence"), (confidence / F.nullif(share, F.lit(0.0))).alias("lift"),
        (_d("n_both") / n - _d("n_set") / n * share).alias("leverage"), F.when(confidence >= 1, MOST).otherwise((1 - share) / F.nullif(1 - confidence, F.lit(0.0))).alias("conviction"),
    )
    return out.filter((F.col("confidence") >= least_confidence) & (F.col("lift") >= least_lift)).orderBy(F.desc("lift"), "antecedent").limit(most)


def best_combinations(found: DataFrame, first: int = 50, keep: int = 20) -> DataFrame:
    """Distinct antecedents among the first rules by lift, in order."""
    w = Window.orderBy(F.desc("lift"), "antecedent")  # rules are bounded by their number
    ordered = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= first)
    return ordered.groupBy("antecedent").agg(F.min("place").alias("place"), F.max("lift").alias("lift")).orderBy("place").limit(keep)


def co_occurrence(found: DataFrame) -> DataFrame:
    """a, b, n_rules, mean_lift: pairs of features in one antecedent of two or more."""
    pairs = found.filter(F.size("antecedent") >= 2).select("lift", F.explode("antecedent").alias("a"), "antecedent").select("lift", "a", F.explode("antecedent").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_rules"), F.avg("lift").alias("mean_lift"))


def by_indicator(stats: DataFrame) -> DataFrame:
    """indicator, entry, exit (composite scores), combined, entry_dominant."""
    side = F.when(F.col("feature").endswith("_entry"), "entry").when(F.col("feature").endswith("_exit"), "exit")
    named = stats.withColumn("side", side).filter("side IS NOT NULL").withColumn("indicator", F.regexp_replace("feature", "_(gs|ho)_(entry|exit)$", ""))
    wide = named.groupBy("indicator").pivot("side", ["entry", "exit"]).agg(F.max("composite"))
    e, x = F.coalesce("entry", F.lit(0.0)), F.coalesce("exit", F.lit(0.0))
    return wide.select("indicator", e.alias("entry"), x.alias("exit"), (e + x).alias("combined"), (e > x).alias("entry_dominant"))


def _as_list(rows: DataFrame, order: list, most: int, *columns: str) -> DataFrame:
    """One row: the first ``most`` rows in order, as an array of structs (a top-k, so it is small)."""
    top = rows.orderBy(*order).limit(most).withColumn("place_", F.row_number().over(Window.orderBy(*order)))
    return top.agg(F.transform(F.sort_array(F.collect_list(F.struct("place_", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("list_"))


# The names of the fields of both reports are those that readers of them expect.


def association_report(stats: DataFrame, found: DataFrame, top: int = 30, first: int = 50) -> DataFrame:
    """One row with what a report says: summary, top_features, association_rules, statistics_summary, feature_mask (in the order of features' names)."""
    share = F.count_if
    sums = stats.join(percentile_mask(stats).select("feature", "selected"), "feature").agg(
        F.struct(F.max("n").alias("total_samples"), F.max("n1").alias("trade_samples"), (F.max("n") - F.max("n1")).alias("hold_samples"), F.count("*").alias("num_features")).alias("summary"),
        F.struct(
            share(F.col("chi2_p") < 0.05).alias("chi2_significant_count"), share(F.col("fisher_p") < 0.05).alias("fisher_significant_count"), share(F.col("lift") > 1.0).alias("lift_count"),
            share(F.col("lift") > 1.5).alias("high_lift_count"), F.avg("mi").alias("mean_mutual_info"),
        ).alias("statistics_summary"),
        F.transform(F.sort_array(F.collect_list(F.struct("feature", "selected"))), lambda x: x["selected"]).alias("feature_mask"),
    )
    best = _as_list(stats, [F.desc("composite"), "feature"], top, "feature", "composite", "chi2", "chi2_p", "mi", "r_pb", "odds_ratio", "fisher_p", "lift", "trade_support", "hold_support")
    listed = _as_list(found, [F.desc("lift"), "antecedent"], first, "antecedent", "support", "confidence", "lift")
    # one row each
    return sums.crossJoin(best.withColumnRenamed("list_", "top_features")).crossJoin(listed.withColumnRenamed("list_", "association_rules"))


def association_export(stats: DataFrame, found: DataFrame, percent: float = 50.0, top: int = 30, combinations: int = 20) -> DataFrame:
    """One row: feature_columns, feature_mask, feature_scores, top_features, top_feature_indices, indicator_combinations, class_distribution, percentile_threshold."""
    order = Window.orderBy("feature")  # a row for each feature
    rows = percentile_mask(stats, percent).withColumn("at", F.row_number().over(order) - 1).join(stats.select("feature", "n", "n1"), "feature")
    one = F.sort_array(F.collect_list(F.struct("at", "feature", "score", "selected")))
    sums = rows.agg(one.alias("x"), F.struct(F.max("n1").alias("trade"), (F.max("n") - F.max("n1")).alias("hold")).alias("class_distribution"))
    each = lambda name: F.transform("x", lambda v: v[name])
    sums = sums.select(each("feature").alias("feature_columns"), each("selected").alias("feature_mask"), F.map_from_arrays(each("feature"), each("score")).alias("feature_scores"), "class_distribution", F.lit(percent).alias("percentile_threshold"))
    best = _as_list(rows, [F.desc("score"), "feature"], top, "feature", "at").select(F.transform("list_", lambda v: v["feature"]).alias("top_features"), F.transform("list_", lambda v: v["at"]).alias("top_feature_indices"))
    sets = _as_list(found, [F.desc("lift"), "antecedent"], combinations, "antecedent").select(F.transform("list_", lambda v: v["antecedent"]).alias("indicator_combinations"))
    return sums.crossJoin(best).crossJoin(sets)  # one row each
