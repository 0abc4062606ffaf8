"""Preparation of feature tables for models, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _w():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def encode_target(df: DataFrame, column: str = "tradeable", out: str = "y") -> DataFrame:
    """hold (and null) 0, trade 1; any other label is an error."""
    label = F.coalesce(F.col(column), F.lit("hold"))
    return df.withColumn(out, F.when(label == "hold", 0).when(label == "trade", 1).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("int")))


def scale(df: DataFrame, columns: list[str], how: str = "standard", fit_on: Column | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, or their place between minimum and maximum; a spread of zero divides by 1.

    Statistics come from all rows, or from those that ``fit_on`` holds for.
    """
    base = df if fit_on is None else df.filter(fit_on)
    kinds = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}[how]
    stats = base.agg(*[f(c).alias(f"s{k}_{c}") for c in columns for k, f in enumerate(kinds)])
    joined = df.crossJoin(F.broadcast(stats))  # one row of statistics

    def scaled(c: str) -> Column:
        low, other = F.col(f"s0_{c}"), F.col(f"s1_{c}")
        spread = other if how == "standard" else other - low
        return ((F.col(c) - low) / F.when(spread == 0, 1.0).otherwise(spread)).alias(c)

    return joined.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def shift_target(df: DataFrame, k: int, column: str = "y") -> DataFrame:
    """Features of a bar with the label k bars later; the last k bars of a symbol go."""
    return df.withColumn(column, F.lead(column, k).over(_w())).filter(F.col(column).isNotNull()) if k else df


def sequences(df: DataFrame, features: list[str], length: int, stride: int = 1, target: str = "y") -> DataFrame:
    """symbol, bar_idx (of the first bar), x (length rows of features), y: the label of the bar after the sequence; starts every ``stride`` bars."""
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(_w().rowsBetween(0, length - 1))
    out = df.select("symbol", "bar_idx", rows.alias("x"), F.lead(target, length).over(_w()).alias("y"))
    return out.filter((F.size("x") == length) & F.col("y").isNotNull() & (F.col("bar_idx") % stride == 0))


def class_weights(df: DataFrame, target: str = "y", power: float | None = None) -> DataFrame:
    """class, n, weight: total / (2 n + 1e-6); with ``power`` (total / (2 n)) ** power, scaled to a mean of 1."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # a row for each class
    total = F.sum("n").over(everything)
    if power is None:
        return counts.withColumn("weight", total / (2 * F.col("n") + F.lit(1e-6)))
    raw = counts.withColumn("weight", F.pow(total / (2 * F.greatest("n", F.lit(1))), F.lit(power)))
    return raw.withColumn("weight", F.col("weight") / F.avg("weight").over(everything))


def split(df: DataFrame, validation: float = 0.2, test: float = 0.2) -> DataFrame:
    """Adds part: train, validation and test in time order within a symbol; the last two have whole numbers of rows, cut down."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    v, t = F.floor(n * validation), F.floor(n * test)
    place = F.row_number().over(_w())
    return df.withColumn("part", F.when(place <= n - v - t, "train").when(place <= n - t, "validation").otherwise("test"))


def decode(df: DataFrame, threshold: float = 0.5, p: str = "p_trade") -> DataFrame:
    """Adds predicted (1: trade) and confidence: the larger class, but a trade below the threshold holds."""
    trade = (F.col(p) > 1 - F.col(p)) & (F.col(p) >= threshold)
    return df.withColumn("predicted", trade.cast("int")).withColumn("confidence", F.greatest(p, 1 - F.col(p)))


def _counts() -> list[Column]:
    y, z = F.col("y_true") == 1, F.col("predicted") == 1
    return [F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(y & ~z).alias("fn"), F.count_if(~y & ~z).alias("tn")]


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = counts.withColumn("accuracy", _over(tp + tn, tp + fp + fn + tn))
    for name, hit, wrong, missed in (("trade", tp, fp, fn), ("hold", tn, fn, fp)):
        p, r = _over(hit, hit + wrong), _over(hit, hit + missed)
        df = df.withColumn(f"{name}_precision", p).withColumn(f"{name}_recall", r).withColumn(f"{name}_f1", _over(2 * p * r, p + r)).withColumn(f"{name}_support", hit + missed)
    n = F.col("trade_support") + F.col("hold_support")
    for m in ("precision", "recall", "f1"):
        df = df.withColumn(f"weighted_{m}", _over(F.col(f"trade_{m}") * F.col("trade_support") + F.col(f"hold_{m}") * F.col("hold_support"), n))
    return df


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row from y_true and predicted: confusion counts, accuracy, and precision, recall, F1 and support by class and weighted; empty classes give 0."""
    return _metrics(predictions.agg(*_counts()))


def threshold_sweep(predictions: DataFrame, thresholds: list[float] | None = None, by: str = "trade_f1") -> DataFrame:
    """threshold, metrics, best: the first threshold that is strictly best."""
    values = thresholds or [round(0.3 + 0.05 * k, 2) for k in range(13)]
    rows = predictions.withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in values])))
    trade = (F.col("p_trade") > 1 - F.col("p_trade")) & (F.col("p_trade") >= F.col("threshold"))
    found = _metrics(rows.withColumn("predicted", trade.cast("int")).groupBy("threshold").agg(*_counts()))
    return found.withColumn("best", F.row_number().over(Window.orderBy(F.desc(by), "threshold")) == 1)  # a row for each threshold


def fitness(metrics: DataFrame, e: float = 1e-10) -> DataFrame:
    """Adds fitness (smaller is better), which favours recall of trades, and the plain product of the classes' F1."""
    p, r = F.col("trade_precision"), F.col("trade_recall")
    value = -F.pow(p + e, F.lit(1 / 3)) * F.pow(r + e, F.lit(2 / 3)) * F.col("hold_f1") * F.least(r / 0.3, F.lit(1.0))
    return metrics.withColumn("fitness", value).withColumn("product_fitness", -F.col("trade_f1") * F.col("hold_f1"))


def eta_squared(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, eta2: share of a feature's variance that lies between classes, 1 at most; 0 if it has none."""
    long = df.select(F.col(target).alias("c_"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("c_", "x.*")
    groups = long.groupBy("feature", "c_").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    sums = groups.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.nullif("n", F.lit(0))).alias("b"))
    middle = F.col("s") * F.col("s") / F.nullif("n", F.lit(0))
    return sums.select("feature", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("b") - middle, F.nullif(F.col("q") - middle, F.lit(0.0))), F.lit(0.0))).alias("eta2"))


def phi(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, phi: correlation of two 0/1 columns by their two-by-two counts, without sign; 0 if either is constant."""
    long = df.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("f")).select("y", "f.*")
    c = long.groupBy("feature").agg(*[F.sum(((F.col("x") == a) & (F.col("y") == b)).cast("double")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    below = F.sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00))
    return c.select("feature", F.coalesce(F.abs(F.try_divide(n11 * n00 - n10 * n01, F.nullif(below, F.lit(0.0)))), F.lit(0.0)).alias("phi"))


def feature_mask(correlations: DataFrame, constant: float = 0.5, value: str = "value", r: str = "r") -> DataFrame:
    """Adds selected: value > -100 * r * c, with r scaled to 0..1 over all features and c a tier of the constant by the raw r, the first that fits."""
    everything = Window.partitionBy()  # a row for each feature
    low, high = F.min(r).over(everything), F.max(r).over(everything)
    scaled = F.when(high > low, (F.col(r) - low) / (high - low)).otherwise(0.0)
    x = F.col(r)
    c = F.when(x < 0.01, -1.8 * constant).when(x < 0.05, -1.6 * constant).when(x > 0.80, 1.1 * constant).when(x > 0.90, 1.3 * constant).otherwise(constant)
    return correlations.withColumn("scaled_r", scaled).withColumn("tier", c).withColumn("selected", F.col(value) > -100 * F.col("scaled_r") * F.col("tier"))


def latest_window(df: DataFrame, length: int, shift: int = 0) -> DataFrame:
    """The last length + shift bars of each symbol that has so many."""
    back = Window.partitionBy("symbol").orderBy(F.desc("bar_ts"))
    n = F.count("*").over(Window.partitionBy("symbol"))
    return df.withColumn("n_", n).withColumn("r_", F.row_number().over(back)).filter((F.col("r_") <= length + shift) & (F.col("n_") >= length + shift)).drop("r_", "n_")


def target_patterns(df: DataFrame, length: int = 4) -> DataFrame:
    """pattern, n: kinds of label sequences of whole chunks: all hold, entry ... exit, or invalid."""
    chunks = df.groupBy("symbol", F.floor(F.col("bar_idx") / length).alias("c_")).agg(F.sort_array(F.collect_list(F.struct("bar_idx", F.coalesce("signal", F.lit("hold")).alias("s")))).alias("x"))
    s = F.transform("x", lambda v: v["s"])
    kind = F.when(F.forall(s, lambda v: v == "hold"), "ALL_HOLD").when((F.element_at(s, 1) == "entry") & F.exists(s, lambda v: v == "exit") & (F.size(F.filter(s, lambda v: v == "entry")) == 1), "ENTRY_EXIT").otherwise("INVALID")
    return chunks.filter(F.size("x") == length).groupBy(kind.alias("pattern")).agg(F.count("*").alias("n"))
