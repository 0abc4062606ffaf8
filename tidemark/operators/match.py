"""Matching of indicator signals with target signals, and sweeps over indicator parameters."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import REGISTRY
from tidemark.operators.series import Series, SparkSeries
from tidemark.operators.trades import pair_trades, trade_stats


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1


def matched(df: DataFrame, indicator: str, target: str, tolerance: int = 1, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``match_greedy`` for signals on one bar or next to each other."""
    if tolerance not in (0, 1):
        raise ValueError("tolerances beyond 1 are for match_greedy")
    return match_greedy(df, indicator, target, tolerance, keys)


def match_greedy(df: DataFrame, indicator: str, target: str, tolerance: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, n_indicator, n_target, matches: one-to-one matches of signals at most ``tolerance`` bars apart, by distance, then bar, then earlier target.

    The greedy order takes all pairs on one bar, then all pairs one bar apart, and so on, so there is a round for each distance d. Free signals whose bars
    follow each other d apart and are indicator and target by turns form a chain; from its first bar on, its members pair up two by two whichever side the first is on: an
    indicator takes the earlier target if that is free, else the later one. So a chain of n gives n // 2 matches, and an odd one leaves its last bar. Each
    round numbers chains in windows over the same partitioning: bars are shuffled once.
    """
    if tolerance < 0 or tolerance != int(tolerance):
        raise ValueError("the tolerance is a number of bars")
    i, t = _flag(indicator), _flag(target)
    df = df.select(*keys, "bar_idx", i.alias("i_"), t.alias("t_"))
    single = F.col("i_") != F.col("t_")
    if tolerance == 0:
        found = df.withColumn("matched_", F.lit(False))
    elif tolerance == 1:
        return _islands(df, single, keys)
    else:
        found = df.withColumn("free_", single)
        for d in range(1, tolerance + 1):
            w = Window.partitionBy(*keys).orderBy("free_", F.col("bar_idx") % d, "bar_idx")
            before = F.lag(F.struct("free_", "bar_idx", "i_")).over(w)
            goes_on = F.coalesce(F.col("free_") & before["free_"] & (F.col("bar_idx") - before["bar_idx"] == d) & (F.col("i_") != before["i_"]), F.lit(False))
            found = found.withColumn("begin_", F.when(~goes_on, F.row_number().over(w))).withColumn("place_", F.row_number().over(w) - F.last("begin_", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            # odd places end a pair; an even one begins it if the next bar goes on with the chain
            pairs = F.col("free_") & ((F.col("place_") % 2 == 1) | (F.coalesce(F.lead("place_").over(w), F.lit(0)) == F.col("place_") + 1))
            found = found.withColumn("free_", F.col("free_") & ~pairs)
        found = found.withColumn("matched_", single & ~F.col("free_"))
    sums = (F.count_if("i_").alias("n_indicator"), F.count_if("t_").alias("n_target"), (F.count_if(F.col("i_") & F.col("t_")) + F.floor(F.count_if("matched_") / 2)).alias("matches"))
    return found.groupBy(*keys).agg(*sums)


def _islands(df: DataFrame, single: Column, keys: tuple[str, ...]) -> DataFrame:
    """A single distance needs no marks on rows: a row for each island (with the bars after it that are in none), then sums of these."""
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    before = F.lag(F.when(F.col("i_") != F.col("t_"), F.struct("bar_idx", "i_"))).over(w)
    goes_on = F.coalesce((F.col("bar_idx") - before["bar_idx"] == 1) & (F.col("i_") != before["i_"]), F.lit(False))
    df = df.withColumn("begins_", (single & ~goes_on).cast("int")).withColumn("island_", F.sum("begins_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = df.groupBy(*keys, "island_").agg(F.count_if("i_").alias("a_"), F.count_if("t_").alias("b_"), F.count_if(F.col("i_") & F.col("t_")).alias("exact_"), F.count_if(single).alias("n_"))
    return islands.groupBy(*keys).agg(F.sum("a_").alias("n_indicator"), F.sum("b_").alias("n_target"), F.sum(F.col("exact_") + F.floor(F.col("n_") / 2)).alias("matches"))


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; all zero if either side has no signal."""
    none = (F.col("n_indicator") == 0) | (F.col("n_target") == 0)
    p, r = (F.when(none, 0.0).otherwise(F.try_divide(F.col("matches"), F.col(n))) for n in ("n_indicator", "n_target"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def match_score(df: DataFrame, tolerance: int = 1, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Entry and exit sides (columns entry, exit, target_entry, target_exit) with scores, and the sum of matches."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("side_"), _flag(a).alias("a_"), _flag(f"target_{a}").alias("b_")) for a in ("entry", "exit")]))
    found = with_scores(match_greedy(df.select(*keys, "bar_idx", sides.alias("s_")).select(*keys, "bar_idx", "s_.*"), "a_", "b_", tolerance, (*keys, "side_")))
    names = ("n_indicator", "n_target", "matches", "precision", "recall", "f1")
    both = found.groupBy(*keys).agg(*[F.max(F.when(F.col("side_") == side, F.col(n))).alias(f"{side}_{n}") for side in ("entry", "exit") for n in names])
    return both.withColumn("combined_score", F.col("entry_matches") + F.col("exit_matches"))


def alignment(df: DataFrame, tolerance: int = 1) -> DataFrame:
    """Each bar with indicator and target (whether it has such a signal), and matched: an indicator with any target within the tolerance."""
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-tolerance, tolerance)
    near = F.max(_flag("target_entry").cast("int")).over(w) == 1
    return df.select("symbol", "bar_idx", _flag("entry").alias("indicator"), _flag("target_entry").alias("target"), (_flag("entry") & near).alias("matched"))


def unmatched(df: DataFrame, tolerance: int = 1) -> DataFrame:
    """Signals without a match: indicators without a target within tolerance, targets without an indicator on their own bar."""
    rows = alignment(df, tolerance)
    kinds = F.array(F.when(F.col("indicator") & ~F.col("matched"), "indicator"), F.when(F.col("target") & ~F.col("indicator"), "target"))
    return rows.select("symbol", "bar_idx", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("side"))


def axis(low: float, high: float, whole: bool, step: float = 0.1, clip: bool = True) -> list[float]:
    """Values of a parameter: whole steps, or tenths rounded to three places; two at least. Without clip a last tenth may pass the bound."""
    if whole:
        values = list(range(int(low), int(high) + 1))
    else:
        values = [round(low + k * step, 3) for k in range(int(math.ceil((high + step - low) / step - 1e-9)))]
        values = [v for v in values if v <= high + 1e-9] if clip else values
    return values if len(values) >= 2 else [low, high]


def grid(name: str, most: int = 3000, clip: bool = True, only: tuple[str, ...] | None = None) -> list[dict]:
    """Parameter combinations of an indicator; with over twice ``most`` of them each axis is thinned to evenly spaced values."""
    spec = REGISTRY[name]
    axes = {k: axis(p.low, p.high, p.whole, clip=clip) if only is None or k in only else [p.default] for k, p in spec.params.items()}
    if math.prod(map(len, axes.values())) > 2 * most:
        n = int(most ** (1 / max(len(axes), 1))) + 1
        axes = {k: v if len(v) <= n else [v[round(i * (len(v) - 1) / (n - 1))] for i in range(n)] for k, v in axes.items()}
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def grid_table(spark: SparkSession, combos: list[dict]) -> DataFrame:
    """combo_id and params (a map) of each combination."""
    return spark.createDataFrame([(k, {n: float(v) for n, v in c.items()}) for k, c in enumerate(combos)], "combo_id int, params map<string,double>")


def sample_grid(combos: DataFrame, most: int = 3000, seed: int = 42) -> DataFrame:
    """A seeded choice of ``most`` combinations, each once."""
    return combos.orderBy(F.xxhash64(F.col("combo_id").cast("long"), F.lit(seed)), "combo_id").limit(most)


def sampled(combos: list[dict], most: int, seed: int = 42) -> list[dict]:
    """A seeded choice of ``most`` combinations in their order: those of the least md5 of seed and place."""
    order = sorted(range(len(combos)), key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
    return [combos[k] for k in sorted(order[:most])]


class _Template(Series):
    """Conditions over outputs of any combination: V, P and Q hold all outputs' values on this bar and the two before, c the combination."""

    def __init__(self, shared: Series) -> None:
        super().__init__(shared.keys)
        self.shared = shared

    def put(self, spark: str, other: str | None = None) -> str:
        """A field of the combination, found once for entry and exit; what stands on such a field is written out."""
        return f"({spark})" if "c.l" in spark else self.known.setdefault(spark, f"c.l{len(self.known)}")

    def lag(self, x: str, k: int = 1) -> str:
        if re.fullmatch(r"[VP]\[c\.o\d+\]", x) and k == 1:
            return {"V": "P", "P": "Q"}[x[0]] + x[1:]
        if x.startswith("c.p_"):
            return x
        if "c." in x:
            raise ValueError(f"no {x} on bars before")
        return self.shared.lag(x, k)


def sweep_signals(labelled: DataFrame, name: str, combos: list[dict], only_signals: bool = False) -> DataFrame:
    """Entry and exit of each combination on each bar (``only_signals``: where it or a target has one, and on the last bar), beside the targets.

    All combinations are one Series, so each distinct output is computed once and the bars are read once. The outputs are elements of one array of a row, and a
    table of combinations, a constant, says which of them each takes with what constants; the conditions are evaluated for one after another.
    """
    spec, s = REGISTRY[name], SparkSeries(labelled)
    place: dict[str, int] = {}
    rows = []
    for k, params in enumerate(combos):
        given = spec.defaults(**params)
        outputs = [place.setdefault(o, len(place)) for o in spec.build(s, **given)]
        rows.append({"id": k} | {f"o{j}": o for j, o in enumerate(outputs)} | {f"p_{n}": float(v) for n, v in given.items()})
    template, symbols = _Template(s), [f"V[c.o{j}]" for j in range(len(spec.outputs))]
    entry, exit_ = (f(template, symbols, {n: f"c.p_{n}" for n in spec.params}) if f else "false" for f in (spec.entry, spec.exit))
    texts = " ".join([entry, exit_, *template.known])
    columns, arrays, last = list(place), [], max((k for k, x in enumerate("VPQ") if f"{x}[" in texts), default=-1)
    for k, letter in enumerate("VPQ"[: last + 1]):
        columns = [s.lag(c) for c in columns] if k else columns
        arrays.append(f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}) AS {letter}")
    fields = {"id": "int"} | {f"o{j}": "int" for j in range(len(spec.outputs))} | {f"p_{n}": "double" for n in spec.params}
    table = f"from_json('{json.dumps(rows)}', 'array<struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>>')"
    own = [f"c.{n} AS {n}" for n in fields if re.search(rf"\bc\.{n}\b", f"{entry} {exit_}") or n == "id"]
    table = f"transform({table}, c -> struct({', '.join([*own, *[f'{text} AS {name[2:]}' for text, name in template.known.items()]])}))"
    shared = dict.fromkeys(re.findall(r"\bt\d+_\b", texts))
    bars = s.select("symbol", "bar_ts", "bar_idx", "close", *shared, f"coalesce(signal = 'entry', false) AS target_entry", f"coalesce(signal = 'exit', false) AS target_exit", f"lead(bar_idx) {s.window()} IS NULL AS last_", *arrays)
    each = f"transform({table}, c -> struct(c.id AS combo_id, {entry} AS entry, {exit_} AS exit))"
    each = f"filter({each}, c -> c.entry OR c.exit OR target_entry OR target_exit OR last_)" if only_signals else each
    if len(combos) > 64:  # bars of one symbol are no longer tied to each other, and each is much work
        bars = bars.repartition(max(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), bars.sparkSession.sparkContext.defaultParallelism), "symbol", "bar_idx")
    found = bars.selectExpr("symbol", "bar_ts", "bar_idx", "close", "CAST(target_entry AS INT) AS target_entry", "CAST(target_exit AS INT) AS target_exit", f"inline({each})")
    return found.select("combo_id", "symbol", "bar_ts", "bar_idx", "close", "entry", "exit", "target_entry", "target_exit")


def sweep(labelled: DataFrame, name: str, combos: list[dict], tolerance: int = 1) -> DataFrame:
    """combo_id, params, score, best: summed matches of each combination; best is the first of the highest score."""
    signals = sweep_signals(labelled, name, combos, only_signals=True)
    scores = match_score(signals, tolerance, keys=("combo_id", "symbol")).groupBy("combo_id").agg(F.sum("combined_score").alias("score"))
    w = Window.orderBy(F.desc("score"), "combo_id")  # as many rows as combinations
    return scores.join(grid_table(labelled.sparkSession, combos), "combo_id").withColumn("best", F.row_number().over(w) == 1)


def sensitivity(labelled: DataFrame, name: str, parameter: str, tolerance: int = 1) -> DataFrame:
    """value, score of one parameter, the others at their defaults."""
    combos = grid(name, only=(parameter,))
    return sweep(labelled, name, combos, tolerance).select(F.element_at("params", parameter).alias("value"), "score", "best")


def profit_sweep(bars: DataFrame, name: str, combos: list[dict], loss: str = "loss_sharpe") -> DataFrame:
    """combo_id, params, loss, best: mean loss over symbols of the trades that each combination makes; the least is best, then the first."""
    signals = sweep_signals(bars.withColumn("signal", F.lit(None).cast("string")), name, combos, only_signals=True)
    keys = ("combo_id", "symbol")
    stats = trade_stats(pair_trades(signals, keys=keys), signals, keys)
    scores = stats.groupBy("combo_id").agg(F.avg(loss).alias("loss"))
    w = Window.orderBy("loss", "combo_id")
    return scores.join(grid_table(bars.sparkSession, combos), "combo_id").withColumn("best", F.row_number().over(w) == 1)
