"""Readers and writers: bars by symbol, logs, tables of features, artefacts in JSON, and summary tables in text."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.indicators import REGISTRY, Indicator
from tidemark.sources.arrow_files import ArrowFiles
from tidemark.sources.views import with_index


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a local one only if unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load_bars(spark: SparkSession, path: str, pattern: str = r"([A-Z0-9]+)_USDT") -> DataFrame:
    """Bars from parquet files, one for each symbol, which the file's name has: symbol, bar_ts, open .. volume, bar_idx. ``date`` becomes bar_ts."""
    df = spark.read.parquet(path).withColumn("symbol", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, 1))
    df = df.withColumn("bar_ts", F.col("date").cast("timestamp_ntz")).drop("date")
    return with_index(df.filter("bar_ts IS NOT NULL AND symbol <> ''"))


def load_arrow_bars(spark: SparkSession, path: str, pattern: str = r"^([A-Z0-9]+)_USDT", only: list[str] | None = None) -> DataFrame:
    """The same from Arrow (feather) files, of the symbols ``only`` if given (other files stay unread)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)
    df = spark.read.format("arrow_files").option("pattern", pattern).load(path)
    df = df.filter(F.col("symbol").isin(only)) if only else df
    return with_index(df.withColumnRenamed("date", "bar_ts").filter("bar_ts IS NOT NULL AND symbol <> ''"))


def export_arrow_bars(bars: DataFrame, path: str) -> None:
    """A feather file for each symbol, its bars in order: one shuffle by symbol, and a task writes batch by batch."""
    bars.sparkSession.dataSource.register(ArrowFiles)
    rows = bars.select("symbol", F.col("bar_ts").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows.repartition("symbol").sortWithinPartitions("symbol", "date").write.format("arrow_files").mode("append").save(path)


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def load_logs(spark: SparkSession, paths: list[str], run_ids: list[str] | None = None) -> DataFrame:
    """Optimization logs in CSV; columns that a file lacks are null; iterations below 0 (initial rows) go."""
    out = None
    for path in paths:
        df = spark.read.csv(path, header=True, inferSchema=True)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    out = out.filter("iteration >= 0")
    return out.filter(F.col("run_id").isin(run_ids)) if run_ids else out


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def fitness_history(checkpoints: DataFrame) -> DataFrame:
    """iteration (of the checkpoint), step, fitness."""
    return checkpoints.select("iteration", F.posexplode("fitness_history").alias("step", "fitness"))


def export(df: DataFrame, path: str, kind: str = "parquet", partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.option("header", True).format(kind).save(path)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A wide table in CSV with a header; with a schema the file is read once, without one its types are found first."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def export_association(stats: DataFrame, rules: DataFrame, path: str, top: int = 20) -> None:
    """Scores, the best features and the best combinations, as JSON tables."""
    stats.write.mode("overwrite").json(f"{path}/scores")
    stats.orderBy(F.desc("composite"), "feature").limit(top).write.mode("overwrite").json(f"{path}/top_features")
    rules.orderBy(F.desc("lift"), "antecedent").limit(top).write.mode("overwrite").json(f"{path}/combinations")


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("report"))


@dataclass(frozen=True)
class IndicatorConfig:
    """Indicator definitions of a JSON text: ``indicators`` by name, ``operators`` (symbols by name)."""

    indicators: dict[str, dict]
    operators: dict[str, str]

    def indicator(self, name: str) -> dict:
        if name not in self.indicators:
            raise ValueError(f"no indicator {name}")
        return self.indicators[name]

    def by_category(self, category: str | None = None) -> dict[str, dict]:
        return {n: d for n, d in self.indicators.items() if category is None or d["category"] == category}

    def names(self) -> list[str]:
        return list(self.indicators)

    def categories(self) -> list[str]:
        return sorted({d["category"] for d in self.indicators.values()})

    def symbol(self, operator: str) -> str:
        """An operator's symbol; one that is not listed stands for itself."""
        return self.operators.get(operator, operator)


def load_config(text: str) -> IndicatorConfig:
    """Of a parameter only those with a range count; what a definition leaves out is empty."""
    found = json.loads(text)
    out = {}
    for name, d in found.get("indicators", {}).items():
        params = {k: p for k, p in d.get("params", {}).items() if isinstance(p, dict) and "range" in p}
        out[name] = {"full_name": d.get("name", name), "category": d.get("category", ""), "function": d.get("talib_function", ""), "params": params, "outputs": d.get("outputs", []), "entry": d.get("entry", {}), "exit": d.get("exit", {}), "requires": d.get("requires", [])}
    return IndicatorConfig(out, found.get("operators", {}))


def load_indicator_config(text: str) -> dict[str, dict]:
    """Indicator definitions of a JSON text: name, category, params (default, range, type), outputs, entry and exit conditions."""
    found = json.loads(text)
    found = found.get("indicators", found)
    return {name: {"category": d.get("category"), "params": d.get("params", {}), "outputs": d.get("outputs", []), "entry": d.get("entry"), "exit": d.get("exit")} for name, d in found.items() if isinstance(d, dict)}


def by_category(category: str | None = None) -> list[Indicator]:
    return [i for i in REGISTRY.values() if category is None or i.category == category]


def categories() -> list[str]:
    return sorted({i.category for i in REGISTRY.values()})


def number(c: Column) -> Column:
    """What is left of a cell without all but digits, points and signs, as a number; null if that is none."""
    return F.regexp_replace(c, r"[^\d.\-]", "").try_cast("double")


def cells(line: Column) -> Column:
    """The cells of a table line, without its bars and outer spaces."""
    parts = F.transform(F.split(line, r"[│┃|]"), lambda c: F.trim(c))
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def summary_rows(text: DataFrame, title: str = "STRATEGY SUMMARY", stop: str = "cache|^[└╰]") -> DataFrame:
    """k, place, cells (the first five) of table rows after a line with the title and before one that matches ``stop``, from (k, value: whole text)."""
    marked = F.transform(F.split("value", "\n"), lambda line, i: F.struct(i.alias("place"), line.alias("line")))
    start = F.array_min(F.transform(F.filter(marked, lambda x: F.upper(x["line"]).contains(title)), lambda x: x["place"]))
    df = text.withColumn("lines_", marked).withColumn("start_", start)
    end = F.array_min(F.transform(F.filter("lines_", lambda x: (x["place"] > F.col("start_")) & F.lower(x["line"]).rlike(stop)), lambda x: x["place"]))
    rows = df.withColumn("end_", F.coalesce(end, F.lit(1 << 30))).select("k", "start_", "end_", F.explode("lines_").alias("x"))
    rows = rows.filter((F.col("x.place") > F.col("start_")) & (F.col("x.place") < F.col("end_")) & F.trim("x.line").rlike("^[│|]"))
    return rows.select("k", F.col("x.place").alias("place"), F.slice(cells(F.col("x.line")), 1, 5).alias("cells"))


def strategy_row(lines: DataFrame, header: str, name: str) -> DataFrame:
    """The row of a strategy by the names in a header line: trades, profit, win rate (last number of wins-draws-losses, as a share), drawdown."""
    names = [c.strip() for c in header.strip().strip("|│┃").replace("┃", "|").replace("│", "|").split("|")]
    row = lines.select(cells(F.col("line")).alias("c")).filter(F.get("c", 0) == name)
    get = lambda part: next((F.get("c", k) for k, n in enumerate(names) if part in n.lower()), F.lit(None).cast("string"))
    win = F.element_at(F.split(F.trim(get("win")), r"\s+"), -1)
    return row.select(F.get("c", 0).alias("strategy"), number(get("trades")).alias("trades"), number(get("tot profit")).alias("profit"), (number(win) / 100).alias("win_rate"), number(F.element_at(F.split(F.trim(get("drawdown")), r"\s+"), 1)).alias("drawdown"))
