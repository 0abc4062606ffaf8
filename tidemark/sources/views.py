"""Input views over the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "bars": """SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
        max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {events} WHERE value > 0 GROUP BY event_type, date_trunc('hour', ts)""",
    "daily_bars": """SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS bar_ts, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
        min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {orders} GROUP BY o_orderpriority, date_trunc('day', o_orderdate)""",
    "supp_bars": """SELECT CAST(l_suppkey AS STRING) AS symbol, date_trunc('day', l_shipdate) AS bar_ts,
        min_by(l_extendedprice, l_orderkey * CAST(1000000 AS DOUBLE) + l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        max_by(l_extendedprice, l_orderkey * CAST(1000000 AS DOUBLE) + l_extendedprice) AS close, sum(l_quantity) AS volume FROM {lineitem} GROUP BY l_suppkey, date_trunc('day', l_shipdate)""",
    "features01": """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS INT) AS QTY_gs_entry,
        CAST(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS INT) AS DISC_gs_entry, CAST(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS INT) AS TAX_gs_exit,
        CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS STAT_gs_exit, CASE WHEN l_returnflag = 'R' THEN 'trade' ELSE 'hold' END AS tradeable FROM {lineitem}""",
    "opt_log": """SELECT l_returnflag AS run_id, CAST(l_orderkey % 20 AS INT) - 1 AS iteration, l_linenumber AS individual_idx, CAST(l_partkey % 2 AS INT) AS feat_0,
        CAST(l_suppkey % 2 AS INT) AS feat_1, CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 1 ELSE 0 END AS feat_2, l_tax AS dropout, l_quantity AS hidden_size,
        CAST(0.0 AS DOUBLE) AS dropout_lower, CAST(0.08 AS DOUBLE) AS dropout_upper, CAST(1.0 AS DOUBLE) AS hidden_size_lower, CAST(50.0 AS DOUBLE) AS hidden_size_upper,
        -(l_discount + l_extendedprice / 1000000.0) AS fitness FROM {lineitem}""",
    "bt_trades": """SELECT o_orderpriority AS pair, l_orderkey, l_linenumber, o_orderdate AS open_date, o_orderdate + CAST(l_quantity AS INT) * INTERVAL '1' HOUR AS close_date,
        l_extendedprice * (0.05 - l_discount) AS profit_abs, CAST(0.05 - l_discount AS DOUBLE) AS profit_ratio, l_linestatus AS exit_reason FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "predictions": "SELECT doc_id, quality AS y_true, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS p_trade FROM {labels}",
    "bt_text": """SELECT l_suppkey AS k, concat('| S_', CAST(l_suppkey AS STRING), ' | ', CAST(count(*) AS STRING), ' | 0.26 | ', CAST(CAST(sum(l_quantity) AS BIGINT) AS STRING), ' | 0.66 |') AS line
        FROM {lineitem} GROUP BY l_suppkey""",
}
TABLES = ("events", "orders", "lineitem", "labels")


def load_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the parquet tables of a directory; bars get ``bar_idx``, a bar's place in its symbol."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql, **tables)
    return with_index(df.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz"))) if "bar_ts" in df.columns else df


def with_index(bars: DataFrame) -> DataFrame:
    return bars.selectExpr("*", "CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS INT) AS bar_idx")


def sql_view(name: str) -> str:
    """The same view for DuckDB, as the text of a subquery."""
    sql = VIEWS[name]
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS INT) AS bar_idx FROM ({sql})" if "bar_ts" in sql else sql
