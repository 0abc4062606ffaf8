"""Hindsight labels of bars: entry and exit signals, and whether a period was worth a trade."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.passes import begins


def _w():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def _best(period: int, threshold: float) -> tuple[Column, Column]:
    """Best change in percent over the next period - 1 bars if it reaches the threshold, and its offset; of equal ones the earliest."""
    changes = F.array(*[(F.lead("close", k).over(_w()) - F.col("close")) / F.nullif("close", F.lit(0.0)) * 100 for k in range(1, period)])
    return changes, threshold


def best_exits(bars: DataFrame, period: int = 4, threshold: float = 1.0) -> DataFrame:
    """Adds best_pct and best_offset (null where no later bar of the period reaches the threshold; bars beyond the end don't count)."""
    changes, least = _best(period, threshold)
    df = bars.withColumn("changes_", changes)
    good = F.filter("changes_", lambda c: c.isNotNull() & (c >= least))
    best = F.when(F.size(good) > 0, F.array_max(good))
    return df.withColumn("best_pct", best).withColumn("best_offset", F.when(F.col("best_pct").isNotNull(), F.array_position("changes_", F.col("best_pct")).cast("int"))).drop("changes_")


def _composed(to: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map of all bars (rows of ``to``: the state after a bar from each state before it, and the hits on the way): halves are composed until one is left."""
    while len(to) > 1:
        if len(to) % 2:
            to = np.concatenate([to, np.arange(to.shape[1])[None]])
            hits = np.concatenate([hits, np.zeros_like(hits[:1])])
        first, second = to[::2], to[1::2]
        to, hits = np.take_along_axis(second, first, axis=1), hits[::2] + np.take_along_axis(hits[1::2], first, axis=1)
    return to[0], hits[0]


def count_from_offsets(bars: DataFrame, period: int = 4, threshold: float = 1.0, block: int = 1 << 16) -> DataFrame:
    """symbol, offset (0 to period), signals: hits met when a hit moves on by a period and a miss by one bar; whole periods only.

    The state of a start is the number of bars that it still has to pass over. A bar maps states to states, and maps compose, so each block of bars (with the
    bars of a period beyond it) is a task's own and gives one map; a symbol's maps are then applied in order. A null close is no hit.
    """
    if block < period:
        raise ValueError("a block holds a period at least")
    size = period + 1
    where = F.floor(F.col("bar_idx") / block)
    ahead = (F.col("bar_idx") % block < period - 1) & (where > 0)  # also seen by the block before
    df = bars.select("symbol", "bar_idx", "close", F.explode(F.when(ahead, F.array(where - 1, where)).otherwise(F.array(where))).alias("block_"))
    w = Window.partitionBy("symbol", "block_").orderBy("bar_idx")
    reach = [(F.lead("close", k).over(w) - F.col("close")) / F.nullif("close", F.lit(0.0)) * 100 >= threshold for k in range(1, period)]
    hit = F.exists(F.array(*reach), lambda c: c) & F.lead("bar_idx", period - 1).over(w).isNotNull() if reach else F.lit(False)
    bits = df.withColumn("hit_", F.coalesce(hit, F.lit(False))).filter(F.floor(F.col("bar_idx") / block) == F.col("block_")).select("symbol", "block_", "hit_", "bar_idx")
    bits = bits.repartition("symbol", "block_").sortWithinPartitions("symbol", "block_", "bar_idx")  # as the window left them

    wait = np.maximum(np.arange(size) - 1, 0)
    taken = np.concatenate([[max(period - 1, 0)], wait[1:]])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, hits = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_numpy(zero_copy_only=False)
            new, _ = begins([batch.column(0), batch.column(1)], last)
            for lo, hi in zip(starts := [0, *(np.flatnonzero(new[1:]) + 1).tolist()], [*starts[1:], len(key)]):
                if key[lo] != last and held:
                    yield row(last, *held)
                    held = []
                to = np.where(hits[lo:hi, None], taken, wait)
                count = np.zeros((hi - lo, size), np.int64)
                count[:, 0] = hits[lo:hi]
                to, count = _composed(to, count)
                held = [to[held[0]], held[1] + count[held[0]], held[2] + hi - lo] if held else [to, count, hi - lo]
                last = key[lo]
        if held:
            yield row(last, *held)

    def row(key: tuple, to: np.ndarray, count: np.ndarray, bars: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([to.tolist()], pa.list_(pa.int32())), pa.array([count.tolist()], pa.list_(pa.int64())), pa.array([bars], pa.int64())], ["symbol", "block_", "to", "hits", "bars"])

    found = bits.mapInArrow(maps, "symbol string, block_ long, to array<int>, hits array<long>, bars long")
    blocks = found.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block_", "to", "hits"))).alias("maps"), F.sum("bars").alias("bars"))
    start = f"transform(sequence(0, {period}), k -> struct(k AS at, 0L AS hits))"
    folded = f"aggregate(maps, {start}, (all, m) -> transform(all, x -> struct(m.to[x.at] AS at, x.hits + m.hits[x.at] AS hits)))"
    return blocks.select("symbol", "bars", F.posexplode(F.expr(folded)).alias("offset", "x")).filter("offset < bars").selectExpr("symbol", "offset", "CAST(x.hits AS INT) AS signals")


def best_offset(bars: DataFrame, period: int = 4, threshold: float = 1.0) -> DataFrame:
    """symbol, offset, signals: the start with most signals, the lowest of equal ones."""
    w = Window.partitionBy("symbol").orderBy(F.desc("signals"), "offset")
    return count_from_offsets(bars, period, threshold).withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")


def label_periods(bars: DataFrame, period: int = 4, threshold: float = 1.0) -> DataFrame:
    """Adds signal (entry, exit), signal_pct_change, period_id and tradeable (trade, hold).

    Periods follow each other without overlap from bar 0, a hit or not; an incomplete last one holds. A hit's first bar is the entry and its best bar the
    exit; both carry the change and the hit's number (from 0). All bars of a hit are tradeable.
    """
    df = best_exits(bars, period, threshold)
    whole = Window.partitionBy("symbol")
    df = df.withColumn("bucket_", F.floor(F.col("bar_idx") / period)).withColumn("n_", F.count("*").over(whole))
    first = (F.col("bar_idx") % period == 0) & ((F.col("bucket_") + 1) * period <= F.col("n_")) & F.col("best_pct").isNotNull()
    w = Window.partitionBy("symbol", "bucket_")
    df = df.withColumn("hit_", first.cast("int")).withColumn("pct_", F.max(F.when(first, F.col("best_pct"))).over(w)).withColumn("at_", F.max(F.when(first, F.col("bar_idx") + F.col("best_offset"))).over(w))
    number = F.sum("hit_").over(_w().rowsBetween(Window.unboundedPreceding, 0)) - 1
    df = df.withColumn("number_", number).withColumn("signal", F.when(F.col("hit_") == 1, "entry").when(F.col("bar_idx") == F.col("at_"), "exit"))
    return df.select(
        *bars.columns, "signal", F.when(F.col("signal").isNotNull(), F.col("pct_")).alias("signal_pct_change"), F.when(F.col("signal").isNotNull(), F.col("number_")).cast("int").alias("period_id"),
        F.when(F.col("pct_").isNotNull(), "trade").otherwise("hold").alias("tradeable"),
    )


def label(bars: DataFrame, period: int = 4, threshold: float = 1.0) -> DataFrame:
    """Bars from each symbol's best offset on, numbered anew and labelled."""
    start = best_offset(bars, period, threshold).select("symbol", "offset")
    df = bars.join(start, "symbol").filter("bar_idx >= offset").withColumn("bar_idx", (F.col("bar_idx") - F.col("offset")).cast("int")).drop("offset")
    return label_periods(df.select(*bars.columns), period, threshold)


def signals_only(labelled: DataFrame) -> DataFrame:
    return labelled.filter("signal IS NOT NULL")


def summary(labelled: DataFrame) -> DataFrame:
    """By symbol: total_rows, signal_count (entries), avg, min and max change of entries, trade and hold rows, trade_ratio (0 without entries)."""
    entry = F.when(F.col("signal") == "entry", F.col("signal_pct_change"))
    trades = F.count_if(F.col("tradeable") == "trade")
    return labelled.groupBy("symbol").agg(
        F.count("*").alias("total_rows"), F.count(entry).alias("signal_count"), F.avg(entry).alias("avg_pct"), F.min(entry).alias("min_pct"), F.max(entry).alias("max_pct"), trades.alias("trade_rows"),
        F.count_if(F.col("tradeable") == "hold").alias("hold_rows"), F.when(F.count(entry) == 0, 0.0).otherwise(trades / F.count("*")).alias("trade_ratio"),
    )


def chunk_purity(labelled: DataFrame, period: int = 4) -> DataFrame:
    """symbol, offset, chunks, pure: chunks of ``period`` rows from each start offset, and how many have one label only."""
    df = labelled.select("symbol", "bar_idx", "tradeable", F.explode(F.sequence(F.lit(0), F.lit(period - 1))).alias("offset")).filter("bar_idx >= offset")
    chunks = df.groupBy("symbol", "offset", F.floor((F.col("bar_idx") - F.col("offset")) / period).alias("chunk")).agg(F.count("*").alias("n"), F.count_distinct("tradeable").alias("labels"))
    return chunks.filter(F.col("n") == period).groupBy("symbol", "offset").agg(F.count("*").alias("chunks"), F.count_if(F.col("labels") == 1).alias("pure"))


def period_gaps(labelled: DataFrame) -> DataFrame:
    """gap, n: how many bars lie between entries that follow each other."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    entries = labelled.filter("signal = 'entry'").withColumn("gap", F.col("bar_idx") - F.lag("bar_idx").over(w))
    return entries.filter("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))


def period_sizes(labelled: DataFrame) -> DataFrame:
    """rows, periods, consistent: how many periods have so many signal rows, and how many of those carry one label only."""
    sizes = labelled.filter("period_id IS NOT NULL").groupBy("symbol", "period_id").agg(F.count("*").alias("rows"), F.count_distinct("tradeable").alias("labels"))
    return sizes.groupBy("rows").agg(F.count("*").alias("periods"), F.count_if(F.col("labels") == 1).alias("consistent"))


def null_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """a_null, b_null, n: the two-by-two table of missing values in two columns."""
    return df.groupBy(F.col(a).isNull().alias("a_null"), F.col(b).isNull().alias("b_null")).agg(F.count("*").alias("n"))
