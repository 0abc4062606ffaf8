"""Running sums and ranks over keys of any size: rows are dealt by ranges of the order, and a range adds what the ranges before it hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import scratch

#: Rows of a range, about.
RANGE_ROWS = 1 << 18


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], most: int | None = None, each: int = RANGE_ROWS) -> DataFrame:
    """Adds, for each ``out: column`` of ``sums``, the sum of the column over the rows of the same keys up to this one in ascending ``order`` (nulls first).

    ``most``: a bound on the number of rows, if it is known; else they are counted. Ranges of ``each`` rows are of keys and order together, so a task has no more of a large
    key than of small ones; rows are written once, as a second sampling might draw other ranges. What is ordered by key in one task is a row for each range.
    Like any window, rows that agree in keys and order have no order of their own.
    """
    spark = df.sparkSession
    ranges = max(1, -(-(df.count() if most is None else most) // each))
    path = scratch(spark, "running")
    dealt = df.repartitionByRange(ranges, *keys, *order).withColumn("range_", F.spark_partition_id())
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    ends = rows.groupBy(*keys, "range_").agg(*[F.sum(c).alias(out) for out, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select(*[F.col(k).alias(f"{k}_of_") for k in keys], F.col("range_").alias("at_"), *[F.sum(out).over(before).alias(f"{out}_before_") for out in sums])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_of_")) for k in keys], F.col("range_") == F.col("at_"))
    w = Window.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.repartition(ranges, *keys, "range_")  # a fixed number, as small partitions joined by their compressed bytes can hold many rows
    found = near.select("*", *[F.sum(c).over(w).alias(out) for out, c in sums.items()]).join(F.broadcast(ends), same)
    total = [F.coalesce(F.col(f"{out}_before_") + F.col(out), F.col(out), F.col(f"{out}_before_")).alias(out) for out in sums]
    return found.select(*df.columns, *total)


def mean_ranks(df: DataFrame, keys: list[str], value: str, out: str, most: int | None = None) -> DataFrame:
    """keys, value, ``out`` and rows_: the rank in ascending order of each distinct value of the keys (nulls apart), ties by their mean rank, and how many rows have it.

    What is put in order is a row for each distinct value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rows_"))
    ends = running_sums(counts, keys, [value], {"end_": "rows_"}, most)
    return ends.select(*keys, value, (F.col("end_") - F.col("rows_") + (F.col("rows_") + 1) / 2.0).alias(out), "rows_")


def join_ranks(df: DataFrame, ranks: DataFrame, value: str, rows: int, share: int = 1000, each: int = RANGE_ROWS) -> DataFrame:
    """``df`` of ``rows`` rows with the columns of ``ranks``. Values that have 1 / ``share`` of the rows or more (so ``share`` at most) are broadcast: no shuffled value has many rows.

    The others are joined in partitions of ``each`` rows or less, as many as the session sets at least. They are joined as texts (a double's is its own): for keys
    that are doubles, or for fewer partitions, Spark would deal the rows again and join small partitions by their compressed bytes, which can hold many rows.
    """
    parts = max(-(-rows // each), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    text = (F.col(value).cast("double") + 0.0).cast("string").alias("key_")  # one zero
    df, ranks = df.select("*", text), ranks.select(text, *[c for c in ranks.columns if c != value])
    often = F.col("rows_") * share >= rows
    hot, others = (ranks.filter(c).drop("rows_") for c in (often, ~often))
    rest = df.join(F.broadcast(hot.select("key_")), "key_", "left_anti")
    rest = rest.repartition(parts, "key_") if rows > each else rest
    return df.join(F.broadcast(hot), "key_").unionByName(rest.join(others, "key_")).drop("key_")
