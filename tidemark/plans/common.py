"""Helpers for the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import REGISTRY, add
from tidemark.operators.series import SparkSeries, SqlSeries
from tidemark.sources.views import sql_view


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded (-0.0 as 0.0), whole numbers as bigint."""

    def column(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            return (F.round(c.cast("double"), digits) + 0.0).alias(name)
        return c.cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else c

    return df.select(*[column(n, k) for n, k in df.dtypes])


def rounded(sql: str, digits: int) -> str:
    """Rounds the columns that a comment /*round: a, b*/ in the text names; /*count: a*/ columns become bigint."""
    names = lambda kind: [n.strip() for m in re.findall(rf"/\*{kind}: ([^*]*)\*/", sql) for n in m.split(",") if n.strip()]
    parts = [f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names("round")] + [f"CAST({n} AS BIGINT) AS {n}" for n in names("count")]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql


def with_indicator(bars: DataFrame, name: str, block: int | None = None, **params) -> DataFrame:
    """Bars with an indicator's outputs (o1, o2, ..), entry and exit; ``block`` as in ``SparkSeries``."""
    s = SparkSeries(bars, block=block)
    outputs, entry, exit_ = add(s, name, **params)
    sides = [f"{c or 'false'} AS {n}" for c, n in ((entry, "entry"), (exit_, "exit"))]
    return s.select(*bars.columns, *[f"{o} AS {n}" for o, n in zip(outputs, REGISTRY[name].outputs)], *sides)


def sql_indicator(name: str, view: str = "bars", **params) -> str:
    s = SqlSeries(sql_view(view))
    outputs, entry, exit_ = add(s, name, **params)
    sides = [f"{s.put(c) if c else 'false'} AS {n}" for c, n in ((entry, "entry"), (exit_, "exit"))]
    return s.sql(", ".join(["symbol", "bar_ts", "open", "high", "low", "close", "volume", "bar_idx", *[f"{o} AS {n}" for o, n in zip(outputs, REGISTRY[name].outputs)], *sides]))


def sql_erfc(x: str) -> str:
    """The complementary error function (x >= 0) in SQL: one less the exponential times a series of positive terms."""
    term = f"exp(2 * k * ln(2) + (2 * k + 1) * ln({x}) - lgamma(2 * k + 2) + lgamma(k + 1) - ({x}) * ({x}))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 250), lambda k: {term})) END"


def sql_student(r: str, n: str) -> str:
    """p of a correlation r over n pairs in SQL: the finite sums of Student's t over the angle, for even and for odd degrees of freedom."""
    even = f"abs({r}) * (1 + coalesce(list_sum(list_transform(range(1, CAST(({n} - 2) // 2 AS BIGINT)), lambda k: exp(k * ln(1 - {r} * {r}) + lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)))), 0))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, CAST(({n} - 3) // 2 AS BIGINT)), lambda k: exp((2 * k + 1) / 2.0 * ln(1 - {r} * {r}) + 2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)))), 0))"
    return f"CASE WHEN {n} <= 2 OR {r} IS NULL THEN 1.0 WHEN abs({r}) >= 1 THEN 0.0 WHEN {n} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"
