"""Wide feature tables: indicator columns beside labels, shifts, joins, alignment and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import REGISTRY, add
from tidemark.operators.series import SparkSeries

def _w():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def build(labelled: DataFrame, indicators: dict[str, dict], mode: str = "binary", suffix: str = "gs", shift: int = 0) -> DataFrame:
    """Bars with {name}_{suffix}_entry and _exit as 0/1 (binary) or {name}_{suffix}_{output} (raw); one partitioning serves all columns.

    With ``shift`` features come from that many bars before, and each symbol's first ones go.
    """
    s, columns = SparkSeries(labelled), []
    for name, params in indicators.items():
        outputs, entry, exit_ = add(s, name, **params)
        if mode == "binary":
            columns += [(s.put(f"CAST({c} AS INT)"), f"{name}_{suffix}_{side}") for c, side in ((entry, "entry"), (exit_, "exit")) if c]
        else:
            columns += [(c, f"{name}_{suffix}_{o}") for c, o in zip(outputs, REGISTRY[name].outputs)]
    df = s.select(*labelled.columns, *[f"{a} AS {b}" for a, b in columns])
    return shifted(df, [b for _, b in columns], shift) if shift else df


def shifted(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Columns from k bars before; bars without such a one go, and whole numbers stay whole."""
    return df.select(*[F.lag(c, k).over(_w()).alias(c) if c in columns else c for c in df.columns]).filter(F.col("bar_idx") >= k)


def compare(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which a target or any of the signal columns fires."""
    any_ = F.col("signal").isNotNull()
    for c in columns:
        any_ = any_ | (F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1)
    return df.filter(any_)


def join_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Feature tables that are stored apart, joined on symbol and bar; what both have comes from the left."""
    keys = ["symbol", "bar_ts"]
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), keys)


def valid_rows(binary: DataFrame, technical: DataFrame) -> DataFrame:
    """Rows of the one table whose bar has no missing value in the other."""
    return binary.join(technical.na.drop().select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_semi")


def align(binary: DataFrame, technical: DataFrame, period: int = 4) -> tuple[DataFrame, DataFrame]:
    """Both tables on the bars that are complete in both, begun where most chunks of ``period`` rows carry one label, and cut to whole chunks.

    The lowest of equally good starts is taken. Without a column tradeable the rest is cut from the start.
    """
    keys = ["symbol", "bar_ts"]
    w = Window.partitionBy("symbol").orderBy("bar_ts")
    rows = valid_rows(binary, technical).withColumn("i_", F.row_number().over(w) - 1).withColumn("n_", F.count("*").over(Window.partitionBy("symbol")))
    if "tradeable" in binary.columns:
        chunks = rows.select("symbol", "i_", "tradeable", F.explode(F.sequence(F.lit(0), F.lit(period - 1))).alias("o_")).filter("i_ >= o_").groupBy("symbol", "o_", F.floor((F.col("i_") - F.col("o_")) / period).alias("c_")).agg(F.count("*").alias("k_"), F.count_distinct("tradeable").alias("d_"))
        pure = chunks.groupBy("symbol", "o_").agg(F.count_if((F.col("k_") == period) & (F.col("d_") == 1)).alias("p_"))
        first = pure.withColumn("r_", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("p_"), "o_"))).filter("r_ = 1").select("symbol", "o_")
        rows = rows.join(first, "symbol").filter((F.col("i_") >= F.col("o_")) & (F.col("i_") < F.col("o_") + F.floor((F.col("n_") - F.col("o_")) / period) * period))
    else:
        rows = rows.filter(F.col("i_") >= F.col("n_") % period)
    kept = rows.select(*binary.columns)
    return kept, technical.join(kept.select(*keys), keys, "left_semi")


def columns_by_suffix(df: DataFrame, suffixes: tuple[str, ...] = ("_gs_entry", "_gs_exit", "_ho_entry", "_ho_exit")) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def without_metadata(df: DataFrame, metadata: tuple[str, ...] = ("symbol", "bar_ts", "bar_idx", "open", "high", "low", "close", "volume", "signal", "signal_pct_change", "period_id", "tradeable")) -> DataFrame:
    """The feature columns alone: what names a row, its prices and its labels go (those that are there)."""
    return df.drop(*metadata)


def mode_of(df: DataFrame) -> str:
    """binary if signal columns outnumber other indicator columns (raw)."""
    signals = len(columns_by_suffix(df))
    return "binary" if signals and signals >= len([c for c in df.columns if "_gs_" in c or "_ho_" in c]) - signals else "raw"


def to_long(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol", "bar_idx")) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("f")).select(*keys, "f.*")


def best_params(results: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """indicator, type, score, params: the best row of each sweep."""
    out = None
    for (name, kind), df in results.items():
        score = "score" if "score" in df.columns else "loss"
        row = df.filter("best").select(F.lit(name).alias("indicator"), F.lit(kind).alias("type"), F.col(score).cast("double").alias("score"), "params")
        out = row if out is None else out.unionByName(row)
    return out
