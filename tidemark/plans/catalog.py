"""Every registered query over the star-schema tables, with the same question as SQL for another engine where SQL can put it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.common import rounded, tidy
from tidemark.sources.views import load_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, view: str | tuple[str, ...], query: Callable[..., DataFrame], sql: str | None = None, digits: int = 6) -> None:
    """query: from the views' DataFrames; sql: over the same views inlined. Doubles are rounded on both sides."""
    views = (view,) if isinstance(view, str) else view

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(query(*(load_view(spark, sf_dir, v) for v in views)), digits)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = rounded(sql, digits)


from tidemark.plans import queries_analysis, queries_bars, queries_models  # noqa: E402

for module in (queries_bars, queries_models, queries_analysis):
    module.add_to(register)
