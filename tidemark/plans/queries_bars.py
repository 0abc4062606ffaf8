"""Queries on bars: indicators, presets, strategies, labels, trades, matching and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import candles, dataset, labels, match, strategies, trades
from tidemark.operators.indicators import REGISTRY, condition
from tidemark.operators.series import SparkSeries, SqlSeries
from tidemark.plans.common import sql_indicator, with_indicator
from tidemark.plans.presets import PRESETS
from tidemark.sources import files
from tidemark.sources.views import sql_view

DIGITS = {"HT_TRENDLINE": 9, "ROC": 7, "ROCP": 7, "ROCR": 7, "ROCR100": 7}
SHOWN = [n for n in PRESETS if PRESETS[n][0] != "SAR"]
RULES = (["ROC_fast", "OBV_fast"], ["MACD_standard", "TRIMA_standard"])

B = sql_view("bars")
LEADS = f"SELECT *, {', '.join(f'(lead(close, {k}) OVER (PARTITION BY symbol ORDER BY bar_ts) - close) / nullif(close, 0.0) * 100 AS c{k}' for k in (1, 2, 3))} FROM ({B})"
BEST = f"""SELECT symbol, bar_ts, open, high, low, close, volume, bar_idx, best_pct, CASE WHEN best_pct = c1 THEN 1 WHEN best_pct = c2 THEN 2 WHEN best_pct = c3 THEN 3 END AS best_offset
FROM (SELECT *, greatest(CASE WHEN c1 >= 1.0 THEN c1 END, CASE WHEN c2 >= 1.0 THEN c2 END, CASE WHEN c3 >= 1.0 THEN c3 END) AS best_pct FROM ({LEADS}))"""


def labelled_sql(bars: str = BEST, offset: bool = False) -> str:
    """Periods of four bars, from bar 0 or from each symbol's best offset."""
    source = f"SELECT b.* REPLACE (b.bar_idx - o.\"offset\" AS bar_idx) FROM ({bars}) b JOIN ({best_offset_sql()}) o ON b.symbol = o.symbol WHERE b.bar_idx >= o.\"offset\"" if offset else bars
    return f"""SELECT symbol, bar_ts, open, high, low, close, volume, bar_idx, sig AS signal, CASE WHEN sig IS NOT NULL THEN pct END AS signal_pct_change, CASE WHEN sig IS NOT NULL THEN number END AS period_id, CASE WHEN pct IS NOT NULL THEN 'trade' ELSE 'hold' END AS tradeable
FROM (SELECT *, CASE WHEN hit = 1 THEN 'entry' WHEN bar_idx = at_idx THEN 'exit' END AS sig FROM (SELECT *, max(CASE WHEN hit = 1 THEN best_pct END) OVER q AS pct, max(CASE WHEN hit = 1 THEN bar_idx + best_offset END) OVER q AS at_idx,
sum(hit) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS number FROM (SELECT *, bar_idx // 4 AS bucket, CASE WHEN bar_idx % 4 = 0 AND bar_idx + 4 <= count(*) OVER (PARTITION BY symbol) AND best_pct IS NOT NULL THEN 1 ELSE 0 END AS hit FROM ({source})) WINDOW q AS (PARTITION BY symbol, bucket)))"""


def offsets_sql() -> str:
    return f"""WITH RECURSIVE h AS MATERIALIZED (SELECT symbol, bar_idx, best_pct IS NOT NULL AS hit, count(*) OVER (PARTITION BY symbol) AS n FROM ({BEST})),
r(symbol, "offset", pos, hits) AS (SELECT symbol, bar_idx, bar_idx, 0 FROM h WHERE bar_idx <= 4
UNION ALL SELECT r.symbol, r."offset", CASE WHEN h.hit THEN pos + 4 ELSE pos + 1 END, hits + CASE WHEN h.hit THEN 1 ELSE 0 END FROM r JOIN h ON h.symbol = r.symbol AND h.bar_idx = r.pos AND r.pos + 4 <= h.n)
SELECT symbol, "offset", max(hits) AS signals FROM r GROUP BY symbol, "offset\""""


def best_offset_sql() -> str:
    return f"SELECT symbol, \"offset\", signals FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY signals DESC, \"offset\") AS k FROM ({offsets_sql()})) WHERE k = 1"


def trades_sql(signals: str, keys: str = "symbol") -> str:
    """Trades by going through each symbol's bars one after another."""
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT {keys}, bar_idx, close, coalesce(CAST(entry AS INT), 0) AS e, coalesce(CAST(exit AS INT), 0) AS x, last_value(close) OVER (PARTITION BY {keys} ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM ({signals})),
r({keys}, bar_idx, held, k) AS (SELECT {keys}, -1, 0, 0 FROM s GROUP BY {keys} UNION ALL SELECT s.{keys}, s.bar_idx, CASE WHEN held = 1 THEN 1 - x ELSE e END, k + CASE WHEN held = 0 THEN e ELSE 0 END FROM r JOIN s ON s.{keys} = r.{keys} AND s.bar_idx = r.bar_idx + 1),
m AS (SELECT s.*, held, k, coalesce(lag(held) OVER (PARTITION BY s.{keys} ORDER BY s.bar_idx), 0) AS was FROM r JOIN s ON s.{keys} = r.{keys} AND s.bar_idx = r.bar_idx),
t AS (SELECT {keys}, k AS trade_id, max(CASE WHEN held = 1 AND was = 0 THEN bar_idx END) AS entry_idx, max(CASE WHEN held = 0 AND was = 1 THEN bar_idx END) AS exit_idx, max(CASE WHEN held = 1 AND was = 0 THEN close END) AS entry_price,
coalesce(max(CASE WHEN held = 0 AND was = 1 THEN close END), max(fin)) AS exit_price, max(CASE WHEN held = 0 AND was = 1 THEN 1 ELSE 0 END) = 0 AS open FROM m WHERE held <> was GROUP BY {keys}, k)
SELECT *, (exit_price / nullif(entry_price, 0) - 1) * 100 AS profit_pct, entry_price * (exit_price / nullif(entry_price, 0) - 1) AS profit_abs FROM t"""


STATS = "total_profit_pct, win_rate, avg_profit_pct, max_drawdown, sharpe, loss_profit, loss_sharpe, loss_win_rate, loss_sortino, final_capital"


def stats_sql(trades_: str, bars: str = B) -> str:
    return f"""SELECT *, CASE WHEN n_trades = 0 THEN 'inf'::DOUBLE ELSE -total_profit_pct END AS loss_profit, CASE WHEN n_trades = 0 THEN 'inf'::DOUBLE ELSE -sharpe END AS loss_sharpe, CASE WHEN n_trades = 0 THEN 'inf'::DOUBLE ELSE -win_rate END AS loss_win_rate
FROM (SELECT *, (final_capital / 10000.0 - 1) * 100 AS total_profit_pct FROM (SELECT k.symbol, coalesce(n, 0) AS n_trades, coalesce(10000 * g, 10000.0) AS final_capital, coalesce(w, 0.0) AS win_rate, coalesce(m, 0.0) AS avg_profit_pct, coalesce(d, 0.0) AS max_drawdown,
CASE WHEN n > 1 AND s > 0 THEN m / s ELSE 0.0 END AS sharpe, CASE WHEN n IS NULL THEN 'inf'::DOUBLE WHEN l = 0 THEN -100.0 WHEN ds > 0 THEN -m / ds ELSE -m END AS loss_sortino
FROM (SELECT DISTINCT symbol FROM ({bars})) k LEFT JOIN (SELECT symbol, count(*) AS n, product(exit_price / nullif(entry_price, 0)) AS g, avg(CASE WHEN profit_pct > 0 THEN 100.0 ELSE 0.0 END) AS w, avg(profit_pct) AS m, min(profit_pct) AS d, stddev_pop(profit_pct) AS s,
count(*) FILTER (profit_pct < 0) AS l, stddev_pop(CASE WHEN profit_pct < 0 THEN profit_pct END) AS ds FROM ({trades_}) GROUP BY symbol) t ON k.symbol = t.symbol)) /*round: {STATS}*/ /*count: n_trades*/"""


MATCHED = """WITH f AS (SELECT symbol, bar_idx, coalesce(CAST({i} AS INT), 0) = 1 AS i, coalesce(CAST({t} AS INT), 0) = 1 AS t FROM ({source})),
c AS (SELECT symbol, count(*) FILTER (i) AS n_indicator, count(*) FILTER (t) AS n_target, count(*) FILTER (i AND t) AS exact FROM f GROUP BY symbol),
l AS (SELECT *, CASE WHEN bar_idx - lag(bar_idx) OVER w = 1 AND i <> lag(i) OVER w THEN 0 ELSE 1 END AS b FROM f WHERE i <> t WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
g AS (SELECT symbol, sum(b) OVER (PARTITION BY symbol ORDER BY bar_idx) AS k FROM l), n AS (SELECT symbol, sum(c // 2) AS m FROM (SELECT symbol, k, count(*) AS c FROM g GROUP BY symbol, k) GROUP BY symbol)
SELECT c.symbol, n_indicator, n_target, CAST(exact + coalesce(m, 0) AS BIGINT) AS matches FROM c LEFT JOIN n USING (symbol)"""
SCORED = "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM (SELECT *, CASE WHEN n_indicator = 0 OR n_target = 0 THEN 0.0 ELSE matches / n_indicator END AS precision, CASE WHEN n_indicator = 0 OR n_target = 0 THEN 0.0 ELSE matches / n_target END AS recall FROM ({0}))"


def targets_sql(name: str, **params) -> str:
    return f"SELECT s.symbol, s.bar_idx, s.bar_ts, s.close, s.entry, s.exit, CAST(l.signal = 'entry' AS INT) AS target_entry, CAST(l.signal = 'exit' AS INT) AS target_exit FROM ({sql_indicator(name, **params)}) s JOIN ({labelled_sql()}) l ON s.symbol = l.symbol AND s.bar_idx = l.bar_idx"


def with_targets(bars: DataFrame, name: str, **params) -> DataFrame:
    df = with_indicator(labels.label_periods(bars), name, **params)
    return df.withColumn("target_entry", (F.col("signal") == "entry").cast("int")).withColumn("target_exit", (F.col("signal") == "exit").cast("int"))


def score_sql(source: str) -> str:
    names = ("n_indicator", "n_target", "matches", "precision", "recall", "f1")
    sides = {side: SCORED.format(MATCHED.format(i=side, t=f"target_{side}", source=source)) for side in ("entry", "exit")}
    cols = ", ".join(f"{a}.{n} AS {side}_{n}" for a, side in (("a", "entry"), ("b", "exit")) for n in names)
    return f"SELECT a.symbol, {cols}, a.matches + b.matches AS combined_score FROM ({sides['entry']}) a JOIN ({sides['exit']}) b ON a.symbol = b.symbol"


SCORE_ROUND = "/*round: entry_precision, entry_recall, entry_f1, exit_precision, exit_recall, exit_f1*/"


def combos_of(name: str, **axes: list) -> list[dict]:
    import itertools

    return [dict(zip(axes, v)) for v in itertools.product(*axes.values())]


SWEEP = ("SMA", combos_of("SMA", fast_period=[5, 9], slow_period=[15, 21]))


def sweep_sql() -> str:
    name, combos = SWEEP
    parts = " UNION ALL ".join(f"SELECT {k} AS combo_id, sum(combined_score) AS score FROM ({score_sql(targets_sql(name, **c))})" for k, c in enumerate(combos))
    return f"SELECT combo_id, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, combo_id) = 1 AS best FROM ({parts}) /*count: combo_id*/"


def greedy_sql(source: str, tolerance: int) -> str:
    """The greedy matching as it is defined: one candidate pair after another, with what is taken so far."""
    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT symbol, bar_idx, coalesce(CAST(entry AS INT), 0) = 1 AS i, coalesce(CAST(target_entry AS INT), 0) = 1 AS t FROM ({source})),
p AS MATERIALIZED (SELECT a.symbol, a.bar_idx AS x, b.bar_idx AS y, row_number() OVER (PARTITION BY a.symbol ORDER BY abs(a.bar_idx - b.bar_idx), a.bar_idx, b.bar_idx) AS k
FROM f a JOIN f b ON a.symbol = b.symbol AND a.i AND b.t AND b.bar_idx BETWEEN a.bar_idx - {tolerance} AND a.bar_idx + {tolerance}),
r(symbol, k, xs, ys) AS (SELECT DISTINCT symbol, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM f UNION ALL
SELECT symbol, k, CASE WHEN free THEN list_append(xs, x) ELSE xs END, CASE WHEN free THEN list_append(ys, y) ELSE ys END FROM (
SELECT r.symbol, p.k, r.xs, r.ys, p.x, p.y, NOT list_contains(r.xs, p.x) AND NOT list_contains(r.ys, p.y) AS free FROM r JOIN p ON p.symbol = r.symbol AND p.k = r.k + 1)),
m AS (SELECT symbol, max(len(xs)) AS matches FROM r GROUP BY symbol)
SELECT c.*, m.matches FROM (SELECT symbol, count(*) FILTER (i) AS n_indicator, count(*) FILTER (t) AS n_target FROM f GROUP BY symbol) c JOIN m USING (symbol) /*count: matches*/"""


def crossing_grid_sql(combos: list[dict]) -> str:
    """Scores of all (fast, slow) averages by a table of combinations, averages and bars."""
    periods = sorted({n for c in combos for n in c.values()})
    means = " UNION ALL ".join(f"SELECT symbol, bar_idx, {n} AS n, CASE WHEN bar_idx >= {n - 1} THEN avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS v FROM b" for n in periods)
    rows = ", ".join(f"({k}, {c['fast_period']}, {c['slow_period']})" for k, c in enumerate(combos))
    side = lambda i, t: f"""c{i} AS (SELECT combo_id, symbol, count(*) FILTER ({i} AND {t}) AS exact FROM e GROUP BY ALL),
l{i} AS (SELECT combo_id, symbol, bar_idx, CASE WHEN bar_idx - lag(bar_idx) OVER w = 1 AND {i} <> lag({i}) OVER w THEN 0 ELSE 1 END AS b FROM e WHERE {i} <> {t} WINDOW w AS (PARTITION BY combo_id, symbol ORDER BY bar_idx)),
n{i} AS (SELECT combo_id, sum(c // 2) AS m FROM (SELECT combo_id, symbol, k, count(*) AS c FROM (SELECT combo_id, symbol, sum(b) OVER (PARTITION BY combo_id, symbol ORDER BY bar_idx) AS k FROM l{i}) GROUP BY ALL) GROUP BY combo_id),
s{i} AS (SELECT combo_id, exact + coalesce(m, 0) AS score FROM (SELECT combo_id, sum(exact) AS exact FROM c{i} GROUP BY combo_id) LEFT JOIN n{i} USING (combo_id))"""  # noqa: E731
    return f"""WITH g(combo_id, fast, slow) AS (VALUES {rows}), b AS MATERIALIZED (SELECT symbol, bar_idx, close, coalesce(signal = 'entry', false) AS te, coalesce(signal = 'exit', false) AS tx FROM ({labelled_sql()})),
m AS MATERIALIZED ({means}),
s AS (SELECT combo_id, b.symbol, b.bar_idx, te, tx, CASE WHEN abs(x.v - y.v) <= 1e-9 * least(1.0, abs(b.close)) THEN 0 WHEN x.v > y.v THEN 1 WHEN x.v < y.v THEN -1 END AS side
FROM g JOIN m x ON x.n = g.fast JOIN m y ON y.n = g.slow AND y.symbol = x.symbol AND y.bar_idx = x.bar_idx JOIN b ON b.symbol = x.symbol AND b.bar_idx = x.bar_idx),
a AS (SELECT *, lag(side) OVER (PARTITION BY combo_id, symbol ORDER BY bar_idx) AS was FROM s),
e AS MATERIALIZED (SELECT combo_id, symbol, bar_idx, coalesce(side > 0 AND was <= 0, false) AS ie, coalesce(side < 0 AND was >= 0, false) AS ix, te, tx FROM a),
{side('ie', 'te')}, {side('ix', 'tx')}
SELECT combo_id, CAST(a.score + b.score AS BIGINT) AS score FROM sie a JOIN six b USING (combo_id)"""


#: Averages of each kind, and the MACD made of them.
KINDS = range(9)


def kinds(s, macd: bool) -> dict[str, str]:
    if macd:
        return {f"{o}_{k}": x for k in KINDS for o, x in zip(REGISTRY["MACDEXT"].outputs, REGISTRY["MACDEXT"].build(s, **REGISTRY["MACDEXT"].defaults(fastmatype=k, slowmatype=k, signalmatype=k)))}
    return {f"ma_{k}": REGISTRY["MA"].build(s, timeperiod=20, matype=k)[0] for k in KINDS}


#: RSI presets share their output column: the first one's is computed, and the others put their own constants to it.
SHARED = (["RSI_standard", "RSI_aggressive"], ["RSI_conservative"])


def add_to(register) -> None:
    for name, spec in REGISTRY.items():
        columns = ["symbol", "bar_ts", *spec.outputs, "entry", "exit"]
        sql = f"SELECT {', '.join(columns)} FROM ({sql_indicator(name)}) /*round: {', '.join(spec.outputs)}*/"
        register(f"ind_{name.lower()}", "bars", lambda bars, name=name, columns=columns: with_indicator(bars, name).select(*columns), sql, DIGITS.get(name, 6))

    register("flagship", "bars", lambda bars: trades.trade_stats(trades.pair_trades(with_indicator(bars, "SMA")), bars), stats_sql(trades_sql(sql_indicator("SMA"))), 4)
    register("supplier_bars_trades", "supp_bars", lambda bars: trades.trade_stats(trades.pair_trades(with_indicator(bars, "SMA")), bars), stats_sql(trades_sql(sql_indicator("SMA", "supp_bars")), sql_view("supp_bars")), 3)
    register("src1_bars", "bars", lambda bars: bars, f"SELECT * FROM ({B}) /*round: open, high, low, close, volume*/ /*count: bar_idx*/")
    def through_files(bars: DataFrame, only: list[str] | None = None) -> DataFrame:
        path = files.scratch(bars.sparkSession, "bars")
        files.export_arrow_bars(bars.withColumn("symbol", F.upper("symbol")), path)
        return files.load_arrow_bars(bars.sparkSession, path, only=only).withColumn("symbol", F.lower("symbol"))

    stored = "/*round: open, high, low, close, volume*/ /*count: bar_idx*/"
    register("src1_arrow_files", "bars", through_files, f"SELECT * FROM ({B}) {stored}")
    register("src1_arrow_symbols", "bars", lambda bars: through_files(bars, ["CLICK", "VIEW"]), f"SELECT * FROM ({B}) WHERE symbol IN ('click', 'view') {stored}")
    register("src2_symbols", "bars", lambda bars: bars.select("symbol").distinct(), f"SELECT DISTINCT symbol FROM ({B})")

    # predicates and rules
    def predicates(s):
        s_fast, s_slow = s.sma("close", 5), s.sma("close", 12)
        out = {"above": condition(s, s_fast, "crosses_above", s_slow), "below": condition(s, s_fast, "crosses_below", s_slow), "above_constant": condition(s, "close", "crosses_above", "50.0"), "below_factor": condition(s, "close", "crosses_below", s_slow, 1.1), "under": condition(s, "close", "lt", s_slow, 0.9), "over": condition(s, "close", "gte", "75.0")}
        return {k: s.put(v) for k, v in out.items()}

    def run_predicates(bars: DataFrame) -> DataFrame:
        s = SparkSeries(bars)
        found = predicates(s)
        return s.select("symbol", "bar_ts", *[f"{v} AS {k}" for k, v in found.items()])

    s = SqlSeries(B)
    found = predicates(s)
    register("prd1_5_conditions", "bars", run_predicates, s.sql(", ".join(["symbol", "bar_ts", *[f"{v} AS {k}" for k, v in found.items()]])))

    def run_candles(bars: DataFrame) -> DataFrame:
        s = SparkSeries(bars)
        found = candles.add_patterns(s)
        return s.select("symbol", "bar_ts", *[f"{c} AS {n}" for n, c in found.items()])

    s = SqlSeries(B)
    patterns = candles.add_patterns(s)
    shapes = s.sql(", ".join(["symbol", "bar_ts", *[f"{c} AS {n}" for n, c in patterns.items()]]))
    register("ind_candlesticks", "bars", run_candles, f"SELECT * FROM ({shapes}) /*count: {', '.join(patterns)}*/")

    for name, macd in (("ind_ma_kinds", False), ("ind_macdext_kinds", True)):

        def run_kinds(bars: DataFrame, macd=macd) -> DataFrame:
            s = SparkSeries(bars)
            return s.select("symbol", "bar_ts", *[f"{x} AS {n}" for n, x in kinds(s, macd).items()])

        s = SqlSeries(B)
        found = kinds(s, macd)
        register(name, "bars", run_kinds, f"SELECT * FROM ({s.sql(', '.join(['symbol', 'bar_ts', *[f'{x} AS {n}' for n, x in found.items()]]))}) /*round: {', '.join(found)}*/", 7)

    def run_shared(bars: DataFrame) -> DataFrame:
        s = SparkSeries(bars)
        entry, exit_ = strategies.strategy(s, *SHARED)
        return s.select("symbol", "bar_ts", f"{entry} AS entry", f"{exit_} AS exit")

    register("prd7_shared_outputs", "bars", run_shared, f"SELECT symbol, bar_ts, CASE WHEN rsi < 30 AND rsi < 25 THEN 1 END AS entry, CASE WHEN rsi > 65 THEN 1 END AS exit FROM ({sql_indicator('RSI', timeperiod=14)}) /*count: entry, exit*/")

    def run_strategy(bars: DataFrame) -> DataFrame:
        s = SparkSeries(bars)
        entry, exit_ = strategies.strategy(s, *RULES)
        return s.select("symbol", "bar_ts", "bar_idx", "close", f"{entry} AS entry", f"{exit_} AS exit")

    s = SqlSeries(B)
    sides = strategies.strategy(s, *RULES)
    rules_sql = s.sql(f"symbol, bar_ts, bar_idx, close, {sides[0]} AS entry, {sides[1]} AS exit")
    register("prd6_7_strategy", "bars", run_strategy, f"SELECT * FROM ({rules_sql}) /*count: bar_idx, entry, exit*/ /*round: close*/")
    register("prd6_strategy_trades", "bars", lambda bars: trades.trade_stats(trades.pair_trades(run_strategy(bars)), bars), stats_sql(trades_sql(rules_sql)), 4)

    def preset_sql(name: str) -> str:
        s = SqlSeries(B)
        _, entry, exit_ = strategies.preset(s, name)
        e, x = (s.put(c) if c else "false" for c in (entry, exit_))
        return f"SELECT '{name}' AS preset, symbol, sum(CAST(e AS INT)) AS entries, sum(CAST(x AS INT)) AS exits FROM ({s.sql(f'symbol, {e} AS e, {x} AS x')}) GROUP BY symbol"

    groups: dict[str, list[str]] = {}
    for name in SHOWN:
        groups.setdefault(REGISTRY[PRESETS[name][0]].category, []).append(name)
    for category, names in groups.items():
        for lo in range(0, len(names), 12):
            chosen = names[lo : lo + 12]

            register(f"presets_{category}_{lo // 12}", "bars", lambda bars, chosen=chosen: strategies.preset_counts(bars, chosen), " UNION ALL ".join(preset_sql(n) for n in chosen).join(["SELECT * FROM (", ") /*count: entries, exits*/"]))
    for preset in ("SAR_loose", "SAR_standard", "SAR_tight"):
        counts = f"SELECT symbol, sum(CAST(entry AS INT)) AS entries, sum(CAST(exit AS INT)) AS exits FROM ({sql_indicator('SAR', **PRESETS[preset][1])}) GROUP BY symbol /*count: entries, exits*/"
        register(f"presets_{preset.lower()}", "bars", lambda bars, preset=preset: strategies.preset_counts(bars, [preset]).drop("preset"), counts)

    # labels
    lab = ("symbol", "bar_ts", "bar_idx")
    register("lab1_best_exits", "bars", lambda b: labels.best_exits(b).select(*lab, "best_pct", "best_offset"), f"SELECT symbol, bar_ts, bar_idx, best_pct, best_offset FROM ({BEST}) /*round: best_pct*/ /*count: bar_idx, best_offset*/")
    register("lab2_count_offsets", "bars", labels.count_from_offsets, f"SELECT * FROM ({offsets_sql()}) /*count: \"offset\", signals*/")
    register("lab3_best_offset", "bars", labels.best_offset, f"SELECT * FROM ({best_offset_sql()}) /*count: \"offset\", signals*/")
    signal_columns = (*lab, "signal", "signal_pct_change", "period_id", "tradeable")
    notes = "/*round: signal_pct_change*/ /*count: bar_idx, period_id*/"
    register("lab4_periods", "bars", lambda b: labels.label_periods(b).select(*signal_columns), f"SELECT {', '.join(signal_columns)} FROM ({labelled_sql()}) {notes}")
    register("lab5_signals", "bars", lambda b: labels.signals_only(labels.label_periods(b)).select(*signal_columns), f"SELECT {', '.join(signal_columns)} FROM ({labelled_sql()}) WHERE signal IS NOT NULL {notes}")
    register("lab7_all_symbols", "bars", lambda b: labels.label(b).select(*signal_columns), f"SELECT {', '.join(signal_columns)} FROM ({labelled_sql(offset=True)}) {notes}")
    summary = f"""SELECT symbol, count(*) AS total_rows, count(e) AS signal_count, avg(e) AS avg_pct, min(e) AS min_pct, max(e) AS max_pct, count(*) FILTER (tradeable = 'trade') AS trade_rows, count(*) FILTER (tradeable = 'hold') AS hold_rows,
        CASE WHEN count(e) = 0 THEN 0.0 ELSE count(*) FILTER (tradeable = 'trade') / count(*) END AS trade_ratio FROM (SELECT *, CASE WHEN signal = 'entry' THEN signal_pct_change END AS e FROM ({labelled_sql(offset=True)})) GROUP BY symbol /*round: avg_pct, min_pct, max_pct, trade_ratio*/"""
    register("lab6_summary", "bars", lambda b: labels.summary(labels.label(b)), summary)
    purity = f"""SELECT symbol, "offset", count(*) AS chunks, count(*) FILTER (d = 1) AS pure FROM (SELECT symbol, o AS "offset", (bar_idx - o) // 4 AS c, count(*) AS n, count(DISTINCT tradeable) AS d FROM ({labelled_sql()}), (VALUES (0), (1), (2), (3)) v(o) WHERE bar_idx >= o GROUP BY ALL) WHERE n = 4 GROUP BY symbol, "offset" /*count: "offset"*/"""
    register("lab8_chunk_purity", "bars", lambda b: labels.chunk_purity(labels.label_periods(b)), purity)
    gaps = f"SELECT gap, count(*) AS n FROM (SELECT bar_idx - lag(bar_idx) OVER (PARTITION BY symbol ORDER BY bar_idx) AS gap FROM ({labelled_sql()}) WHERE signal = 'entry') WHERE gap IS NOT NULL GROUP BY gap /*count: gap*/"
    register("lab8_gaps", "bars", lambda b: labels.period_gaps(labels.label_periods(b)), gaps)
    sizes = f"SELECT rows, count(*) AS periods, count(*) FILTER (d = 1) AS consistent FROM (SELECT symbol, period_id, count(*) AS rows, count(DISTINCT tradeable) AS d FROM ({labelled_sql()}) WHERE period_id IS NOT NULL GROUP BY symbol, period_id) GROUP BY rows"
    register("lab8_period_sizes", "bars", lambda b: labels.period_sizes(labels.label_periods(b)), sizes)
    register("lab8_null_overlap", "bars", lambda b: labels.null_overlap(with_indicator(labels.label_periods(b), "RSI"), "rsi", "signal"), f"SELECT a_null, b_null, count(*) AS n FROM (SELECT i.rsi IS NULL AS a_null, l.signal IS NULL AS b_null FROM ({sql_indicator('RSI')}) i JOIN ({labelled_sql()}) l ON i.symbol = l.symbol AND i.bar_idx = l.bar_idx) GROUP BY a_null, b_null")

    # trades
    paired = trades_sql(sql_indicator("MOM"))
    register("trd1_2_pairs", "bars", lambda b: trades.pair_trades(with_indicator(b, "MOM")), f"SELECT * FROM ({paired}) /*round: entry_price, exit_price, profit_pct, profit_abs*/ /*count: trade_id, entry_idx, exit_idx*/")
    register("trd3_4_statistics", "daily_bars", lambda b: trades.trade_stats(trades.pair_trades(with_indicator(b, "MIDPRICE")), b), stats_sql(trades_sql(sql_indicator("MIDPRICE", "daily_bars")), sql_view("daily_bars")), 3)
    closed = sql_view("bt_trades")
    register(
        "trd5_6_closed", "bt_trades", trades.closed_trade_summary,
        f"""SELECT pair, count(*) AS n_trades, sum(p) AS profit, avg(h) AS mean_hours, min(h) AS min_hours, max(h) AS max_hours, quantile_cont(h, 0.5) AS median_hours, count(*) FILTER (p > 0) AS wins, count(*) FILTER (p < 0) AS losses, avg(p) FILTER (p > 0) AS avg_win,
        avg(p) FILTER (p < 0) AS avg_loss, max(p) AS best, min(p) AS worst, coalesce(sum(p) FILTER (p > 0), 0.0) / greatest(abs(coalesce(sum(p) FILTER (p < 0), 0.0)), 0.01) AS profit_factor
        FROM (SELECT pair, profit_abs AS p, (epoch(close_date) - epoch(open_date)) / 3600.0 AS h FROM ({closed})) GROUP BY pair /*round: profit, mean_hours, min_hours, max_hours, median_hours, avg_win, avg_loss, best, worst, profit_factor*/""", 3,
    )
    register("trd5_exit_reasons", "bt_trades", trades.exit_reasons, f"SELECT pair, exit_reason, count(*) AS n_trades, sum(profit_abs) AS profit FROM ({closed}) GROUP BY pair, exit_reason /*round: profit*/", 3)
    register(
        "trd5_running_profit", "bt_trades", lambda t: trades.cumulative_profit(t.drop("profit_ratio", "exit_reason")).select("pair", "l_orderkey", "l_linenumber", "close_date", "profit_abs", "running_profit"),
        f"SELECT pair, l_orderkey, l_linenumber, close_date, profit_abs, sum(profit_abs) OVER (PARTITION BY pair ORDER BY close_date, open_date, l_orderkey, l_linenumber, profit_abs ROWS UNBOUNDED PRECEDING) AS running_profit FROM ({closed}) /*round: profit_abs, running_profit*/ /*count: l_linenumber*/", 5,
    )
    by_pair = lambda t: trades.compare_strategies(t.groupBy(F.col("pair").alias("strategy")).agg(F.count("*").alias("trades"), F.sum("profit_abs").alias("profit"), F.count_if(F.col("profit_abs") > 0).alias("wins")))
    register("trd7_compare", "bt_trades", by_pair, f"SELECT *, wins / greatest(trades, 1) AS win_rate FROM (SELECT pair AS strategy, count(*) AS trades, sum(profit_abs) AS profit, count(*) FILTER (profit_abs > 0) AS wins FROM ({closed}) GROUP BY pair) /*round: profit, win_rate*/", 3)
    at_rows = " UNION ALL ".join(f"SELECT '{side}' AS side, '{c}' AS feature, {c} AS v FROM i WHERE {side}" for side in ("entry", "exit") for c in ("sma_fast", "sma_slow"))
    register("trd8_outputs_at_signals", "bars", lambda b: trades.outputs_at_signals(with_indicator(b, "SMA"), ["sma_fast", "sma_slow"]), f"WITH i AS ({sql_indicator('SMA')}) SELECT side, feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, count(v) AS n FROM ({at_rows}) GROUP BY side, feature /*round: mean, std, min, max*/")
    stop = lambda b: with_indicator(b, "ATR").filter("entry").select("symbol", "bar_ts", (F.col("close") - F.col("atr") * 2.0).alias("stop_price"))
    register("ind_atr_stop_price", "bars", stop, f"SELECT symbol, bar_ts, close - atr * 2.0 AS stop_price FROM ({sql_indicator('ATR')}) WHERE entry /*round: stop_price*/")

    # matching and sweeps
    source = targets_sql("MOM")
    register("mat1_matches", "bars", lambda b: match.with_scores(match.matched(with_targets(b, "MOM"), "entry", "target_entry")), f"SELECT * FROM ({SCORED.format(MATCHED.format(i='entry', t='target_entry', source=source))}) /*round: precision, recall, f1*/")
    register("mat1_greedy_tolerance_3", "bars", lambda b: match.match_greedy(with_targets(b, "MOM"), "entry", "target_entry", 3), greedy_sql(source, 3))
    register("mat1_greedy_tolerance_7", "bars", lambda b: match.match_greedy(with_targets(b, "MOM"), "entry", "target_entry", 7), greedy_sql(source, 7))
    register("mat2_score", "bars", lambda b: match.match_score(with_targets(b, "MOM")), f"SELECT * FROM ({score_sql(source)}) {SCORE_ROUND}")
    near = f"SELECT symbol, bar_idx, i AS indicator, t AS target, i AND max(t) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS matched FROM (SELECT symbol, bar_idx, coalesce(entry, false) AS i, coalesce(target_entry, 0) = 1 AS t FROM ({source}))"
    register("mat3_alignment", "bars", lambda b: match.alignment(with_targets(b, "MOM")), f"SELECT * FROM ({near}) /*count: bar_idx*/")
    register("mat4_unmatched", "bars", lambda b: match.unmatched(with_targets(b, "MOM")), f"SELECT symbol, bar_idx, 'indicator' AS side FROM ({near}) WHERE indicator AND NOT matched UNION ALL SELECT symbol, bar_idx, 'target' FROM ({near}) WHERE target AND NOT indicator".join(["SELECT * FROM (", ") /*count: bar_idx*/"]))
    register("swp3_sweep", "bars", lambda b: match.sweep(labels.label_periods(b), *SWEEP).select("combo_id", "score", "best"), sweep_sql())
    whole = match.grid("SMA")
    register("swp1_3_whole_grid", "bars", lambda b: match.sweep(labels.label_periods(b), "SMA", whole).select("combo_id", "score", "best"), f"SELECT *, row_number() OVER (ORDER BY score DESC, combo_id) = 1 AS best FROM ({crossing_grid_sql(whole)}) /*count: combo_id*/")
    some = match.sampled(whole, 100)
    params = [f"CAST(params['{k}'] AS BIGINT) AS {k}" for k in ("fast_period", "slow_period")]
    chosen_rows = ", ".join(f"({k}, {c['fast_period']}, {c['slow_period']})" for k, c in enumerate(some))
    register("swp2_6_sampled_grid", "bars", lambda b: dataset.best_params({("SMA", "gs"): match.sweep(labels.label_periods(b), "SMA", some)}).selectExpr("indicator", "type", "score", *params), f"WITH c(combo_id, fast_period, slow_period) AS (VALUES {chosen_rows}) SELECT 'SMA' AS indicator, 'gs' AS type, CAST(score AS DOUBLE) AS score, fast_period, slow_period FROM ({crossing_grid_sql(some)}) JOIN c USING (combo_id) ORDER BY score DESC, combo_id LIMIT 1 /*count: fast_period, slow_period*/ /*round: score*/")
    values = match.axis(*(lambda q: (q.low, q.high, q.whole))(REGISTRY["MOM"].params["timeperiod"]))
    each = " UNION ALL ".join(f"SELECT {float(n)}::DOUBLE AS value, CAST(sum(combined_score) AS BIGINT) AS score FROM ({score_sql(targets_sql('MOM', timeperiod=n))})" for n in values)
    register("swp4_sensitivity", "bars", lambda b: match.sensitivity(labels.label_periods(b), "MOM", "timeperiod"), f"SELECT value, score, row_number() OVER (ORDER BY score DESC, value) = 1 AS best FROM ({each})")
    register("swp5_profit_sweep", "bars", lambda b: match.profit_sweep(b, "MOM", [{"timeperiod": n} for n in (5, 10, 20)], "loss_sharpe").select("combo_id", "loss", "best"), "SELECT combo_id, loss, row_number() OVER (ORDER BY loss, combo_id) = 1 AS best FROM (" + " UNION ALL ".join(f"SELECT {k} AS combo_id, avg(loss_sharpe) AS loss FROM ({stats_sql(trades_sql(sql_indicator('MOM', timeperiod=n)))})".replace("/*round: " + STATS + "*/", "").replace("/*count: n_trades*/", "") for k, n in enumerate((5, 10, 20))) + ") /*round: loss*/ /*count: combo_id*/")
    lots = [{"timeperiod": n} for n in values]
    each = " UNION ALL ".join(f"SELECT {k} AS combo_id, avg(loss_sharpe) AS loss FROM ({stats_sql(trades_sql(sql_indicator('MOM', **c)))})".replace("/*round: " + STATS + "*/", "").replace("/*count: n_trades*/", "") for k, c in enumerate(lots))
    register("swp5_profit_axis", "bars", lambda b: match.profit_sweep(b, "MOM", lots, "loss_sharpe").select("combo_id", "loss", "best"), f"SELECT combo_id, loss, row_number() OVER (ORDER BY loss, combo_id) = 1 AS best FROM ({each}) /*round: loss*/ /*count: combo_id*/")
    register("swp6_best_params", "bars", lambda b: dataset.best_params({("SMA", "gs"): match.sweep(labels.label_periods(b), *SWEEP)}).select("indicator", "type", "score"), f"SELECT 'SMA' AS indicator, 'gs' AS type, score FROM ({sweep_sql().replace('/*count: combo_id*/', '')}) WHERE best /*round: score*/")

    # datasets
    chosen = {"SMA": {}, "WILLR": {}, "MOM": {}}
    parts = {n: sql_indicator(n) for n in chosen}
    joined = " JOIN ".join(f"({q}) i{k}" + (f" ON i0.symbol = i{k}.symbol AND i0.bar_idx = i{k}.bar_idx" if k else "") for k, q in enumerate(parts.values()))
    names = [f"{n}_gs_{side}" for n in chosen for side in ("entry", "exit")]
    wide = f"SELECT i0.symbol, i0.bar_ts, i0.bar_idx, {', '.join(f'CAST(i{k}.{side} AS INT) AS {n}_gs_{side}' for k, n in enumerate(chosen) for side in ('entry', 'exit'))}, l.signal, l.tradeable FROM {joined} JOIN ({labelled_sql()}) l ON l.symbol = i0.symbol AND l.bar_idx = i0.bar_idx"
    tables = lambda b: dataset.build(labels.label_periods(b), chosen)
    shown = ("symbol", "bar_ts", "bar_idx", *names)
    register("ds1_binary", "bars", lambda b: tables(b).select(*shown), f"SELECT {', '.join(shown)} FROM ({wide}) /*count: {', '.join(['bar_idx', *names])}*/")
    register("prd11_without_metadata", "bars", lambda b: dataset.without_metadata(tables(b)), f"SELECT {', '.join(names)} FROM ({wide}) /*count: {', '.join(names)}*/")
    register("ds1_raw", "bars", lambda b: dataset.build(b, {"SMA": {}, "WILLR": {}}, mode="raw").select("symbol", "bar_ts", "SMA_gs_sma_fast", "SMA_gs_sma_slow", "WILLR_gs_willr"), f"SELECT a.symbol, a.bar_ts, a.sma_fast AS SMA_gs_sma_fast, a.sma_slow AS SMA_gs_sma_slow, b.willr AS WILLR_gs_willr FROM ({parts['SMA']}) a JOIN ({parts['WILLR']}) b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx /*round: SMA_gs_sma_fast, SMA_gs_sma_slow, WILLR_gs_willr*/")
    lagged = ", ".join(f"lag({c}, 2) OVER (PARTITION BY symbol ORDER BY bar_ts) AS {c}" for c in names)
    register("ds2_shifted", "bars", lambda b: dataset.build(labels.label_periods(b), chosen, shift=2).select(*shown), f"SELECT * FROM (SELECT symbol, bar_ts, bar_idx, {lagged} FROM ({wide})) WHERE bar_idx >= 2 /*count: {', '.join(['bar_idx', *names])}*/")
    any_fires = " OR ".join(f"coalesce({c}, 0) = 1" for c in names)
    register("ds4_compare", "bars", lambda b: dataset.compare(tables(b), names).select(*shown, "signal"), f"SELECT {', '.join(shown)}, signal FROM ({wide}) WHERE signal IS NOT NULL OR {any_fires} /*count: {', '.join(['bar_idx', *names])}*/")
    register("ds5_explicit_params", "bars", lambda b: dataset.build(b, {"RSI": {"timeperiod": 7, "entry_constant": 25, "exit_constant": 75}}).select("symbol", "bar_ts", "RSI_gs_entry", "RSI_gs_exit"), f"SELECT symbol, bar_ts, CAST(entry AS INT) AS RSI_gs_entry, CAST(exit AS INT) AS RSI_gs_exit FROM ({sql_indicator('RSI', timeperiod=7, entry_constant=25, exit_constant=75)}) /*count: RSI_gs_entry, RSI_gs_exit*/")
    register("jn1_stored_parts", "bars", lambda b: dataset.join_parts(tables(b), with_indicator(b, "BOP").select("symbol", "bar_ts", "bop")).select(*shown, "bop"), f"SELECT w.symbol, w.bar_ts, w.bar_idx, {', '.join(names)}, p.bop FROM ({wide}) w JOIN ({sql_indicator('BOP')}) p ON w.symbol = p.symbol AND w.bar_ts = p.bar_ts /*count: {', '.join(['bar_idx', *names])}*/ /*round: bop*/")
    technical = lambda b: with_indicator(b, "SMA").select("symbol", "bar_ts", "sma_fast", "sma_slow")
    register("jn3_valid_rows", "bars", lambda b: dataset.valid_rows(tables(b), technical(b)).select(*shown), f"SELECT {', '.join('w.' + c for c in shown)} FROM ({wide}) w SEMI JOIN (SELECT * FROM ({parts['SMA']}) WHERE sma_slow IS NOT NULL) p ON w.symbol = p.symbol AND w.bar_ts = p.bar_ts /*count: {', '.join(['bar_idx', *names])}*/")
    aligned = f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({wide}) w SEMI JOIN (SELECT * FROM ({parts['SMA']}) WHERE sma_slow IS NOT NULL) p ON w.symbol = p.symbol AND w.bar_ts = p.bar_ts),
        c AS (SELECT symbol, o, (i - o) // 4 AS c, count(*) AS k, count(DISTINCT tradeable) AS d FROM v, (VALUES (0), (1), (2), (3)) t(o) WHERE i >= o GROUP BY ALL), p AS (SELECT symbol, o, count(*) FILTER (k = 4 AND d = 1) AS p FROM c GROUP BY symbol, o),
        f AS (SELECT symbol, o FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p DESC, o) AS r FROM p) WHERE r = 1) SELECT {', '.join('v.' + c for c in shown)} FROM v JOIN f ON v.symbol = f.symbol WHERE i >= o AND i < o + (n - o) // 4 * 4 /*count: {', '.join(['bar_idx', *names])}*/"""
    register("aln1_align", "bars", lambda b: dataset.align(tables(b), technical(b))[0].select(*shown), aligned)
