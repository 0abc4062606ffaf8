"""Exact percentiles without a buffer of all values: a histogram finds the parts that hold the wanted ranks, and only those are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...] = (), bins: int = 4096) -> DataFrame:
    """keys and q: an array of the percentiles of ``value`` (nulls apart) at ``shares`` (0 to 1), linear between ranks; a row for each of the keys (one in all without).

    Rows are counted by value, with partial sums. The range of values is cut into ``bins`` equal parts; equal values share a part, so counts of parts tell
    exactly which ones hold the ranks. The values of these are sorted part by part. Without rows there is none in the result.
    """
    by = [*keys, "all_"]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.lit(0).alias("all_"), F.col(value).cast("double").alias("v_")).agg(F.count("*").alias("c_"))
    whole = counts.groupBy(*by).agg(F.sum("c_").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    span = F.col("hi_") - F.col("lo_")
    parted = counts.join(whole, by).withColumn("part_", F.when(span > 0, F.floor((F.col("v_") - F.col("lo_")) / span * bins)).otherwise(F.lit(0).cast("long")))

    def rank(p: float, up: bool) -> Column:
        place = F.lit(p) * (F.col("n_") - 1)
        return F.ceil(place) if up else F.floor(place)

    ranks = F.array(*[rank(p, up) for p in shares for up in (False, True)])
    w = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)  # bins at most
    hist = parted.groupBy(*by, "n_", "part_").agg(F.sum("c_").alias("in_")).withColumn("end_", F.sum("in_").over(w))
    wanted = hist.filter(F.exists(ranks, lambda r: (r < F.col("end_")) & (r >= F.col("end_") - F.col("in_")))).select(*by, "part_", (F.col("end_") - F.col("in_")).alias("below_"))
    w = Window.partitionBy(*by, "part_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    rest = parted.join(wanted, [*by, "part_"]).withColumn("end_", F.col("below_") + F.sum("c_").over(w))
    found = rest.groupBy(*by).agg(*[F.min(F.when(F.col("end_") > rank(p, up), F.col("v_"))).alias(f"p{k}{int(up)}_") for k, p in enumerate(shares) for up in (False, True)], F.max("n_").alias("n_"))

    def between(k: int, p: float) -> Column:
        return F.col(f"p{k}0_") + (F.col(f"p{k}1_") - F.col(f"p{k}0_")) * (F.lit(p) * (F.col("n_") - 1) - rank(p, False))

    return found.select(*keys, F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("q"))
