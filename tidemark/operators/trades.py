"""Pairing of entry and exit signals into trades, and statistics of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.percentiles import percentiles
from tidemark.functions.running import running_sums

CAPITAL = 10_000.0


def pair_trades(df: DataFrame, entry: str = "entry", exit_: str = "exit", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row for each trade: keys, trade_id (from 1), entry_idx, exit_idx, entry_price, exit_price, open, profit_pct, profit_abs.

    One position at a time: an exit counts strictly after its entry, the next entry strictly after that exit. A bar that has both turns the
    position over, so the position after a bar is the last bar with one signal alone, turned once for each bar with both since. A trade
    that never exits is closed at the symbol's last close. Null signals are none.
    """
    w = Window.partitionBy(*keys).orderBy("bar_ts")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    e, x = F.coalesce(F.col(entry).cast("int"), F.lit(0)) == 1, F.coalesce(F.col(exit_).cast("int"), F.lit(0)) == 1
    df = df.select(*keys, "bar_ts", "bar_idx", "close", F.when(e & ~x, 1).when(x & ~e, 0).alias("set_"), F.when(e & x, 1).otherwise(0).alias("turn_"))
    df = df.withColumn("turns_", F.sum("turn_").over(past)).withColumn("last_set_", F.last(F.when(F.col("set_").isNotNull(), F.struct("set_", "turns_")), ignorenulls=True).over(past))
    held = F.coalesce(F.col("last_set_.set_"), F.lit(0))
    turned = F.col("turns_") - F.coalesce(F.col("last_set_.turns_"), F.lit(0))
    df = df.withColumn("in_", (held + turned) % 2)
    before = F.coalesce(F.lag("in_").over(w), F.lit(0))
    df = df.withColumn("opens_", ((F.col("in_") == 1) & (before == 0)).cast("int")).withColumn("closes_", ((F.col("in_") == 0) & (before == 1)).cast("int"))
    df = df.withColumn("trade_id", F.sum("opens_").over(past)).withColumn("final_", F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = df.filter("opens_ = 1 OR closes_ = 1").groupBy(*keys, "trade_id").agg(
        F.max(F.when(F.col("opens_") == 1, F.col("bar_idx"))).alias("entry_idx"),
        F.max(F.when(F.col("closes_") == 1, F.col("bar_idx"))).alias("exit_idx"),
        F.max(F.when(F.col("opens_") == 1, F.col("close"))).alias("entry_price"),
        F.coalesce(F.max(F.when(F.col("closes_") == 1, F.col("close"))), F.max("final_")).alias("exit_price"),
        (F.max("closes_") == 0).alias("open"),
    )
    ratio = F.col("exit_price") / F.nullif("entry_price", F.lit(0.0))
    return rows.withColumn("profit_pct", (ratio - 1) * 100).withColumn("profit_abs", F.col("entry_price") * (ratio - 1)).withColumn("trade_id", F.col("trade_id").cast("int"))


def trade_stats(trades: DataFrame, all_keys: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each key of ``all_keys``: n_trades, final_capital, total_profit_pct, win_rate (percent), avg_profit_pct, max_drawdown, sharpe, and the losses.

    max_drawdown is the worst trade; sharpe is the mean over the population deviation, without scaling to a year, 0 if there is
    none. Losses (smaller is better): profit, sharpe, win rate, sortino; without trades they are infinite.
    """
    p = F.col("profit_pct")
    grown = F.product(F.col("exit_price") / F.nullif("entry_price", F.lit(0.0)))
    found = trades.groupBy(*keys).agg(
        F.count("*").alias("n"), (CAPITAL * grown).alias("final_capital"), F.avg(F.when(p > 0, 100.0).otherwise(0.0)).alias("win_rate"), F.avg(p).alias("mean_"), F.min(p).alias("max_drawdown"),
        F.stddev_pop(p).alias("std_"), F.count_if(p < 0).alias("losers_"), F.stddev_pop(F.when(p < 0, p)).alias("down_"),
    )
    df = all_keys.select(*keys).distinct().join(found, list(keys), "left")
    none, infinite = F.col("n").isNull(), F.lit(float("inf"))

    def value(c: Column, otherwise: float) -> Column:
        return F.when(none, F.lit(otherwise)).otherwise(c)

    sharpe = F.when((F.col("n") > 1) & (F.col("std_") > 0), F.col("mean_") / F.col("std_")).otherwise(0.0)
    sortino = F.when(F.col("losers_") == 0, -100.0).when(F.col("down_") > 0, -F.col("mean_") / F.col("down_")).otherwise(-F.col("mean_"))
    capital = value(F.col("final_capital"), CAPITAL)
    return df.select(
        *keys, F.coalesce("n", F.lit(0)).alias("n_trades"), capital.alias("final_capital"), ((capital / CAPITAL - 1) * 100).alias("total_profit_pct"), value(F.col("win_rate"), 0.0).alias("win_rate"),
        value(F.col("mean_"), 0.0).alias("avg_profit_pct"), value(F.col("max_drawdown"), 0.0).alias("max_drawdown"), value(sharpe, 0.0).alias("sharpe"),
        F.when(none, infinite).otherwise(-(capital / CAPITAL - 1) * 100).alias("loss_profit"), F.when(none, infinite).otherwise(-sharpe).alias("loss_sharpe"),
        F.when(none, infinite).otherwise(-F.col("win_rate")).alias("loss_win_rate"), F.when(none, infinite).otherwise(sortino).alias("loss_sortino"),
    )


def closed_trade_summary(trades: DataFrame) -> DataFrame:
    """By pair: trades, profit, hours held (mean, min, max, median), wins, losses, averages, best, worst, profit factor."""
    p, hours = F.col("profit_abs"), (F.unix_timestamp(F.col("close_date").cast("timestamp")) - F.unix_timestamp(F.col("open_date").cast("timestamp"))) / 3600.0
    gain, loss = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0)))
    held = trades.withColumn("hours_", hours)
    rest = ("wins", "losses", "avg_win", "avg_loss", "best", "worst", "profit_factor")
    sums = held.groupBy("pair").agg(
        F.count("*").alias("n_trades"), F.sum(p).alias("profit"), F.avg("hours_").alias("mean_hours"), F.min("hours_").alias("min_hours"), F.max("hours_").alias("max_hours"),
        F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.avg(F.when(p > 0, p)).alias("avg_win"),
        F.avg(F.when(p < 0, p)).alias("avg_loss"), F.max(p).alias("best"), F.min(p).alias("worst"), (gain / F.greatest(loss, F.lit(0.01))).alias("profit_factor"),
    )
    median = percentiles(held, "hours_", [0.5], ("pair",)).select("pair", F.col("q")[0].alias("median_hours"))
    return sums.join(median, "pair", "left").select("pair", "n_trades", "profit", "mean_hours", "min_hours", "max_hours", "median_hours", *rest)


def exit_reasons(trades: DataFrame) -> DataFrame:
    return trades.groupBy("pair", "exit_reason").agg(F.count("*").alias("n_trades"), F.sum("profit_abs").alias("profit"))


def cumulative_profit(trades: DataFrame) -> DataFrame:
    """Trades with the running profit of their pair in closing order, several tasks to a pair."""
    return running_sums(trades, ["pair"], ["close_date", "open_date", "l_orderkey", "l_linenumber", "profit_abs"], {"running_profit": "profit_abs"})


def compare_strategies(stats: DataFrame) -> DataFrame:
    """strategy, trades, profit, wins -> with win_rate = wins / max(trades, 1), best profit first."""
    return stats.withColumn("win_rate", F.col("wins") / F.greatest("trades", F.lit(1))).orderBy(F.desc("profit"), "strategy")


def outputs_at_signals(df: DataFrame, columns: list[str], entry: str = "entry", exit_: str = "exit") -> DataFrame:
    """side, feature, mean, std (sample), min, max, n of indicator columns on entry rows and on exit rows."""
    long = df.select(entry, exit_, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("f"))
    sides = [long.filter(F.col(c).cast("int") == 1).select(F.lit(side).alias("side"), "f.*") for side, c in (("entry", entry), ("exit", exit_))]
    return sides[0].union(sides[1]).groupBy("side", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
