import math
import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import dataset, labels, match, trades
from tidemark.operators.indicators import REGISTRY, add, condition
from tidemark.operators.kernels import KINDS
from tidemark.operators.passes import Places
from tidemark.operators.series import SparkSeries
from tidemark.operators.strategies import first_of_shared_outputs, strategy
from tidemark.plans.common import with_indicator
from tidemark.plans.presets import NO_ENTRY, NO_EXIT, PRESETS
from tidemark.sources.views import with_index

START = datetime(2024, 1, 1)


def frame(spark, rows, extra="", symbol="A"):
    """rows: close, or dicts of columns."""
    out = []
    for k, r in enumerate(rows):
        r = r if isinstance(r, dict) else {"close": float(r)}
        c = r["close"]
        out.append((r.get("symbol", symbol), START + timedelta(hours=k), float(r.get("open", c)), float(r.get("high", c)), float(r.get("low", c)), float(c), float(r.get("volume", 1)), *[r.get(n.split()[0]) for n in extra.split(",") if n.strip()]))
    types = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double" + (f", {extra}" if extra else "")
    return with_index(spark.createDataFrame(out, types))


def walk(n, seed=1):
    rng, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o, c = c, max(5.0, c + rng.uniform(-3, 3))
        out.append({"open": o, "close": c, "high": max(o, c) + rng.random(), "low": min(o, c) - rng.random(), "volume": float(rng.randrange(1, 50))})
    return out


def values(spark, rows, name, **params):
    df = with_indicator(frame(spark, rows), name, **params).orderBy("bar_idx").collect()
    return [[r[o] for r in df] for o in REGISTRY[name].outputs]


def close_to(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (a[:40], b[:40])


def ema(xs, n, alpha=None, at=None):
    alpha, out, y, seen = alpha or 2 / (n + 1), [], None, []
    for x in xs:
        if x is None:
            out.append(None)
            continue
        seen.append(x)
        if len(seen) == (at or n):
            y = sum(seen[-n:]) / n
        elif y is not None:
            y += alpha * (x - y)
        out.append(y)
    return out


def test_ema_by_hand(spark):
    assert values(spark, [1, 2, 3, 4, 5], "EMA", fast_period=3, slow_period=10)[0] == [None, None, 2.0, 3.0, 4.0]


def test_rsi_and_cmo(spark):
    rows = walk(80)
    c = [r["close"] for r in rows]
    steps = [None] + [b - a for a, b in zip(c, c[1:])]
    g, l = ([None if s is None else max(k * s, 0) for s in steps] for k in (1, -1))
    g, l = ema(g, 14, 1 / 14), ema(l, 14, 1 / 14)
    close_to(values(spark, rows, "RSI")[0], [None if a is None else 100 * a / (a + b) for a, b in zip(g, l)])
    close_to(values(spark, rows, "CMO")[0], [None if a is None else 100 * (a - b) / (a + b) for a, b in zip(g, l)])


def test_macd(spark):
    rows = walk(90)
    c = [r["close"] for r in rows]
    line = [None if a is None or b is None else a - b for a, b in zip(ema(c, 12, at=26), ema(c, 26))]
    signal = ema(line, 9)
    found = values(spark, rows, "MACD")
    close_to(found[1], signal)
    close_to(found[2], [None if s is None else x - s for x, s in zip(line, signal)])
    assert found[0].index(next(x for x in found[0] if x is not None)) == 33


def test_adx(spark):
    rows, n = walk(120), 14
    tr, plus, minus = [], [], []
    for a, b in zip(rows, rows[1:]):
        up, down = b["high"] - a["high"], a["low"] - b["low"]
        plus.append(up if up > down and up > 0 else 0)
        minus.append(down if down > up and down > 0 else 0)
        tr.append(max(b["high"] - b["low"], abs(b["high"] - a["close"]), abs(b["low"] - a["close"])))

    def smooth(x):
        out = [sum(x[: n - 1])]
        for v in x[n - 1 :]:
            out.append(out[-1] - out[-1] / n + v)
        return out[1:]

    p, m, t = smooth(plus), smooth(minus), smooth(tr)
    dx = [100 * abs(a / c - b / c) / (a / c + b / c) for a, b, c in zip(p, m, t)]
    adx = ema(dx, n, 1 / n)
    close_to(values(spark, rows, "DX")[0], [None] * n + dx)
    close_to(values(spark, rows, "ADX")[0], [None] * n + adx)
    close_to(values(spark, rows, "PLUS_DI")[0], [None] * n + [100 * a / c for a, c in zip(p, t)])


def test_window_indicators(spark):
    rows, n = walk(60), 14
    c, h, l, v = ([r[k] for r in rows] for k in ("close", "high", "low", "volume"))
    full = lambda f, k=n: [None if i < k - 1 else f(i) for i in range(len(rows))]
    last = lambda x, i, k=n: x[i - k + 1 : i + 1]
    close_to(values(spark, rows, "WILLR")[0], full(lambda i: -100 * (max(last(h, i)) - c[i]) / (max(last(h, i)) - min(last(l, i)))))
    tp = [sum(x) / 3 for x in zip(h, l, c)]
    close_to(values(spark, rows, "CCI")[0], full(lambda i: (tp[i] - sum(last(tp, i)) / n) / (0.015 * sum(abs(x - sum(last(tp, i)) / n) for x in last(tp, i)) / n)))
    flow = [None] + [(b * w, b > a, b < a) for a, b, w in zip(tp, tp[1:], v[1:])]
    ups, downs = ([None if f is None else f[0] * f[k] for f in flow] for k in (1, 2))
    close_to(values(spark, rows, "MFI")[0], full(lambda i: 100 * sum(last(ups, i)) / (sum(last(ups, i)) + sum(last(downs, i))), n + 1))
    close_to(values(spark, rows, "WMA", timeperiod=10)[0], full(lambda i: sum(w * x for w, x in zip(range(1, 11), last(c, i, 10))) / 55, 10))
    up = full(lambda i: 100 * (n - (n - max(range(n + 1), key=lambda k: (h[i - n + k], k)))) / n, n + 1)
    close_to(values(spark, rows, "AROON")[1], up)
    mean = full(lambda i: sum(last(c, i, 20)) / 20, 20)
    dev = full(lambda i: math.sqrt(sum((x - mean[i]) ** 2 for x in last(c, i, 20)) / 20), 20)
    close_to(values(spark, rows, "BBANDS")[0], [None if m is None else m + 2 * d for m, d in zip(mean, dev)])


def test_kama_and_t3_and_trix(spark):
    rows, n = walk(90), 10
    c = [r["close"] for r in rows]
    out, y = [None] * n, c[n - 1]
    for t in range(n, len(c)):
        er = abs(c[t] - c[t - n]) / sum(abs(c[k] - c[k - 1]) for k in range(t - n + 1, t + 1))
        y += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[t] - y)
        out.append(y)
    close_to(values(spark, rows, "KAMA")[0], out)
    e = [c]
    for _ in range(6):
        e.append(ema(e[-1], 5))
    v = 0.7
    w = (-(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v)
    close_to(values(spark, rows, "T3")[0], [None if z is None else w[0] * z + w[1] * y + w[2] * x + w[3] * u for u, x, y, z in zip(*e[3:7])])
    x = ema(ema(ema(c, 15), 15), 15)
    close_to(values(spark, rows, "TRIX")[0], [None] + [None if a is None else 100 * (b / a - 1) for a, b in zip(x, x[1:])])


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_indicator_runs_on_degenerate_bars(spark, name):
    flat, short = [{"close": 5.0, "volume": 0}] * 70, walk(3)
    for rows in (flat, short, []):
        df = with_indicator(frame(spark, rows), name)
        assert df.count() == len(rows) and not df.filter("entry IS NULL OR exit IS NULL").count()


def test_first_values(spark):
    first = {"SMA": 8, "RSI": 14, "ATR": 14, "ADX": 27, "ADXR": 40, "TRIX": 43, "TEMA": 57, "STOCH": 17, "ULTOSC": 28, "PLUS_DM": 13, "ADOSC": 9, "SAR": 1, "HT_DCPERIOD": 32, "HT_SINE": 63, "MAMA": 32, "BOP": 0}
    rows = walk(100)
    for name, k in first.items():
        x = values(spark, rows, name)[0]
        assert all(v is None for v in x[:k]) and x[k] is not None, name


def test_scan_in_blocks_is_the_scan_in_order(spark):
    rng = random.Random(4)
    rows = [{"close": rng.random(), "a": None if k < 3 else 0.0 if k == 3 else rng.random(), "b": None if k < 3 else rng.random()} for k in range(200)]
    df = frame(spark, rows, "a double, b double")
    y, expected = None, []
    for r in rows:
        y = None if r["b"] is None else r["b"] if y is None else r["a"] * y + r["b"]
        expected.append(y)
    for block in (None, 7, 64, 1000):
        s = SparkSeries(df, block=block)
        y = s.affine("a", "b")
        close_to([r.y for r in s.select("bar_idx", f"{y} AS y").orderBy("bar_idx").collect()], expected)


@pytest.mark.parametrize("name", ["MACD", "ADX", "TRIX", "KAMA", "RSI", "PLUS_DI", "ADOSC"])
def test_blocks_and_batches_change_nothing(spark, name):
    rows = [{**r, "symbol": s} for s in "AB" for r in walk(150, ord(s))]
    df, outputs = frame(spark, rows), REGISTRY[name].outputs
    order = ("symbol", "bar_ts")
    expected = with_indicator(df, name).orderBy(*order).collect()
    for block in (16, 1000):
        found = with_indicator(df, name, block=block).orderBy(*order).collect()
        for o in (*outputs, "entry", "exit"):
            close_to([r[o] for r in found], [r[o] for r in expected])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        found = with_indicator(df, name).orderBy(*order).collect()
    finally:
        spark.conf.unset(key)
    for o in (*outputs, "entry", "exit"):
        close_to([r[o] for r in found], [r[o] for r in expected])


def run_job(kind, *inputs, cuts=(), **params):
    """A job's outputs over one symbol's values, with the bars cut into batches."""
    import numpy as np

    machine, out = KINDS[kind](**params), []
    for lo, hi in zip([0, *cuts], [*cuts, len(inputs[0])]):
        new = np.zeros(hi - lo, bool)
        new[0] = lo == 0
        out.append(machine(Places(new), *(np.array(x[lo:hi], float) for x in inputs)))
    return [np.concatenate(x) for x in zip(*out)]


SIDES = {f"{k}{side}": v for side in ("long", "short") for k, v in (("init", 0.02), ("step", 0.02), ("max", 0.2))}


def test_stop_and_reverse_stays_on_its_side():
    rows = walk(300, 9)
    h, l = [r["high"] for r in rows], [r["low"] for r in rows]
    out = run_job("stop_and_reverse", h, l, **SIDES)[0]
    assert math.isnan(out[0])
    for t in range(2, len(out)):
        if out[t] > 0 and out[t - 1] > 0:
            assert out[t] <= l[t]
        if out[t] < 0 and out[t - 1] < 0:
            assert -out[t] >= h[t]
    assert any(x > 0 for x in out[1:]) and any(x < 0 for x in out[1:])


def test_machines_go_on_where_a_batch_ended():
    import numpy as np

    rows = walk(400, 3)
    close, cuts = [r["close"] for r in rows], (1, 5, 6, 70, 71, 333)
    whole = run_job("cycle", close)
    smooth, i1, q1, period = whole
    angle, line = run_job("phase", smooth, period)[0], run_job("trendline", close, period)[0]
    cases = {"cycle": ((close,), {}), "phase": ((smooth, period), {}), "trendline": ((close, period), {}), "trend_mode": ((smooth, period, angle, line), {}), "adaptive": ((close, i1, q1), {"fast": 0.5, "slow": 0.05}), "stop_and_reverse": (([r["high"] for r in rows], [r["low"] for r in rows]), SIDES)}
    assert set(cases) == set(KINDS)
    for kind, (inputs, params) in cases.items():
        for a, b in zip(run_job(kind, *inputs, **params), run_job(kind, *inputs, cuts=cuts, **params)):
            assert np.array_equal(a, b, equal_nan=True), kind


def test_cycle_finds_the_period_of_a_sine():
    import numpy as np

    close = 100 + 5 * np.sin(2 * np.pi * np.arange(300) / 20)
    assert abs(run_job("cycle", close)[3][200:].mean() - 20) < 1.5


def test_equal_steps_are_one_step_and_unused_ones_none(spark):
    s = SparkSeries(frame(spark, walk(60)))
    add(s, "EMA")
    steps = len(s.steps)
    out, entry, _ = add(s, "EMA")
    assert len(s.steps) == steps and s.ema("close", 9) == out[0]
    add(s, "HT_SINE")
    plan = s.select(f"{out[0]} AS x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "phase" not in plan and len(s.select(f"{out[0]} AS x").collect()) == 60


def test_conditions_on_unknown_values(spark):
    df = frame(spark, [{"close": 1}, {"close": 3, "x": None}, {"close": 1, "x": 2.0}, {"close": 3, "x": 2.0}, {"close": 2, "x": 2.0}], "x double")
    s = SparkSeries(df)
    above, below, less = condition(s, "close", "crosses_above", "x"), condition(s, "close", "crosses_below", "x"), condition(s, "x", "lt", "close", 0.5)
    rows = s.df.selectExpr("bar_idx", f"{above} AS a", f"{below} AS b", f"{less} AS l").orderBy("bar_idx").collect()
    assert [r.a for r in rows] == [False, False, False, True, False] and not any(r.b for r in rows) and not rows[0].l
    with pytest.raises(ValueError):
        condition(s, "close", "near", "x")


def test_presets():
    assert len(PRESETS) == 83 and len(REGISTRY) == 57 and NO_ENTRY < NO_EXIT
    for kind, params in PRESETS.values():
        REGISTRY[kind].defaults(**params)
    assert first_of_shared_outputs(["RSI_standard"], ["RSI_aggressive", "MOM_fast"]) == {"RSI_standard": "RSI_standard", "RSI_aggressive": "RSI_standard", "MOM_fast": "MOM_fast"}


def test_strategy_sides(spark):
    s = SparkSeries(frame(spark, walk(120)))
    assert strategy(s, ["ATR_tight"], ["NATR_tight", "ATR_wide"]) == (None, None)
    s = SparkSeries(frame(spark, walk(120)))
    entry, exit_ = strategy(s, ["MOM_fast", "ATR_tight"], ["MOM_slow"])
    rows = s.df.select(entry, exit_).collect()
    assert {r[0] for r in rows} == {1, None} == {r[1] for r in rows}


def pairs_by_hand(entries, exits):
    out, held = [], None
    for k, (e, x) in enumerate(zip(entries, exits)):
        if held is None:
            held = k if e else None
        elif x:
            out.append((held, k))
            held = None
    return out + ([(held, None)] if held is not None else [])


def test_pairs_by_hand(spark):
    bars = [(1, 0), (1, 1), (1, 1), (0, 1), (1, 0)]
    df = frame(spark, [{"close": k + 1, "entry": e, "exit": x} for k, (e, x) in enumerate(bars)], "entry int, exit int")
    assert [(r.entry_idx, r.exit_idx, r.open) for r in trades.pair_trades(df).orderBy("trade_id").collect()] == [(0, 1, False), (2, 3, False), (4, None, True)]


def test_pairs_and_statistics_against_brute_force(spark):
    rng, parts, expected = random.Random(2), None, {}
    for k in range(25):
        n = rng.randrange(1, 40)
        rows = [{"close": rng.randrange(1, 100), "entry": rng.choice([0, 1, None]), "exit": rng.choice([0, 1, None])} for _ in range(n)]
        df = frame(spark, rows, "entry int, exit int", symbol=f"S{k}")
        parts = df if parts is None else parts.union(df)
        expected[f"S{k}"] = [(a, b, rows[a]["close"], rows[-1 if b is None else b]["close"]) for a, b in pairs_by_hand([r["entry"] for r in rows], [r["exit"] for r in rows])]
    found = {}
    paired = trades.pair_trades(parts).cache()
    for r in paired.orderBy("symbol", "trade_id").collect():
        found.setdefault(r.symbol, []).append((r.entry_idx, r.exit_idx, r.entry_price, r.exit_price))
    assert found == {k: v for k, v in expected.items() if v}
    for r in trades.trade_stats(paired, parts).collect():
        profits = [(x / e - 1) * 100 for _, _, e, x in expected[r.symbol]]
        assert r.n_trades == len(profits)
        if not profits:
            assert r.final_capital == 10_000 and r.loss_sharpe == math.inf
            continue
        mean = sum(profits) / len(profits)
        dev = math.sqrt(sum((p - mean) ** 2 for p in profits) / len(profits))
        assert math.isclose(r.final_capital, 10_000 * math.prod(1 + p / 100 for p in profits), rel_tol=1e-9) and math.isclose(r.max_drawdown, min(profits), abs_tol=1e-9)
        assert math.isclose(r.sharpe, mean / dev if len(profits) > 1 and dev > 0 else 0, abs_tol=1e-9)


def test_labels_by_hand(spark):
    df = frame(spark, [100, 101.5, 103, 102, 100, 100, 100.2, 99, 100])
    rows = labels.label_periods(df).orderBy("bar_idx").collect()
    assert [r.tradeable for r in rows] == ["trade"] * 4 + ["hold"] * 5
    assert (rows[0].signal, rows[2].signal) == ("entry", "exit") and rows[0].period_id == 0 and math.isclose(rows[2].signal_pct_change, 3.0)
    assert sum(r.signal is not None for r in rows) == 2


def test_offsets_against_brute_force(spark):
    rng, period = random.Random(6), 4
    closes = [100 + rng.uniform(-1, 1) for _ in range(61)]
    hit = lambda t: any((closes[t + k] - closes[t]) / closes[t] * 100 >= 1 for k in range(1, period) if t + k < len(closes))
    expected = {}
    for o in range(period + 1):
        i, n = o, 0
        while i + period <= len(closes):
            n, i = (n + 1, i + period) if hit(i) else (n, i + 1)
        expected[o] = n
    df = frame(spark, closes)
    assert {r.offset: r.signals for r in labels.count_from_offsets(df).collect()} == expected
    best = min(o for o in expected if expected[o] == max(expected.values()))
    assert labels.best_offset(df).first().offset == best and labels.label(df).count() == len(closes) - best


def greedy(ind, tgt, tol):
    used_a, used_b = set(), set()
    for _, a, b in sorted((abs(a - b), a, b) for a in ind for b in tgt if abs(a - b) <= tol):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
    return len(used_a)


def test_matches(spark):
    df = frame(spark, [{"close": 1, "entry": int(k in (1, 4, 5)), "t": int(k in (2, 4, 6))} for k in range(8)], "entry int, t int")
    assert match.matched(df, "entry", "t").first().matches == 3
    rng, parts, sides = random.Random(8), None, {}
    for k in range(20):
        rows = [{"close": 1, "entry": rng.choice([0, 0, 1]), "t": rng.choice([0, 0, 1])} for _ in range(50)]
        one = frame(spark, rows, "entry int, t int", symbol=f"S{k}")
        parts = one if parts is None else parts.union(one)
        sides[f"S{k}"] = [[i for i, r in enumerate(rows) if r[c]] for c in ("entry", "t")]
    for tol in (1, 3):
        found = {r.symbol: r.matches for r in match.match_greedy(parts, "entry", "t", tol).collect()}
        assert found == {s: greedy(a, b, tol) for s, (a, b) in sides.items()}
    best = {s: max(greedy(a, b, 1), len(set(a) & set(b))) for s, (a, b) in sides.items()}
    assert all(r.matches >= best[r.symbol] for r in match.matched(parts, "entry", "t").collect())
    with pytest.raises(ValueError):
        match.matched(df, "entry", "t", 2)


def test_grids():
    assert match.axis(2, 5, True) == [2, 3, 4, 5] and match.axis(0.01, 0.05, False) == [0.01, 0.05]
    assert match.axis(1.0, 1.3, False, clip=False) == [1.0, 1.1, 1.2, 1.3] and match.axis(0.01, 0.05, False, clip=False) == [0.01, 0.11]
    assert len(match.grid("MOM")) == 26 and match.grid("BOP") == [{}] and len(match.grid("MACDEXT", most=100)) <= 2 * 100 * 64


def test_dataset_shift_and_alignment(spark):
    df = labels.label_periods(frame(spark, [r["close"] for r in walk(60)]))
    plain, moved = (dataset.build(df, {"MOM": {}, "SMA": {"fast_period": 3, "slow_period": 10}}, shift=k).orderBy("bar_idx").collect() for k in (0, 2))
    assert [r.MOM_gs_entry for r in moved] == [r.MOM_gs_entry for r in plain[:-2]] and moved[0].bar_idx == 2
    raw = dataset.build(df, {"SMA": {"fast_period": 3, "slow_period": 10}}, mode="raw")
    left, right = dataset.align(dataset.build(df, {"MOM": {}}), raw.select("symbol", "bar_ts", "SMA_gs_sma_slow"))
    assert left.count() == right.count() and left.count() % 4 == 0 and right.filter("SMA_gs_sma_slow IS NULL").count() == 0
    assert dataset.mode_of(dataset.build(df, {"MOM": {}})) == "binary" and dataset.mode_of(raw) == "raw"


def test_add_rejects_unknown_parameters(spark):
    with pytest.raises(ValueError):
        add(SparkSeries(frame(spark, [1, 2])), "RSI", period=3)


def test_candlesticks(spark):
    from tidemark.operators.candles import PATTERNS, add_patterns

    bar = lambda o, h, l, c: {"open": o, "high": h, "low": l, "close": c}
    falling = [bar(100 - k, 100.5 - k, 98.5 - k, 99 - k) for k in range(12)]
    rows = [*falling, bar(88, 88.1, 84, 88.1 - 0.05 + 0.9), bar(88, 92, 87, 91), bar(92, 93, 86, 87), bar(87, 87.5, 86.5, 87)]
    s = SparkSeries(frame(spark, rows))
    found = add_patterns(s)
    out = s.df.selectExpr("bar_idx", *[f"{c} AS {n}" for n, c in found.items()]).orderBy("bar_idx").collect()
    assert len(PATTERNS) == 19 and all(v in (0, 100, -100) for r in out for v in r[1:])
    assert out[14].engulfing == -100 and out[15].doji == 100 and out[2].three_black_crows == -100 and not any(out[0][1:])


def test_matches_at_every_tolerance(spark):
    rng, parts, sides = random.Random(18), None, {}
    for k in range(12):
        dense = [0, 1] if k % 3 else [0, 0, 0, 1]
        rows = [{"close": 1, "entry": rng.choice(dense), "t": rng.choice(dense)} for _ in range(60)]
        one = frame(spark, rows, "entry int, t int", symbol=f"S{k}")
        parts = one if parts is None else parts.union(one)
        sides[f"S{k}"] = [[i for i, r in enumerate(rows) if r[c]] for c in ("entry", "t")]
    parts = parts.cache()
    for tol in (0, 1, 2, 4, 9):
        found = {r.symbol: (r.n_indicator, r.n_target, r.matches) for r in match.match_greedy(parts, "entry", "t", tol).collect()}
        assert found == {s: (len(a), len(b), greedy(a, b, tol)) for s, (a, b) in sides.items()}, tol


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_offsets_in_blocks_are_those_in_order(spark, block):
    for period, n in ((1, 5), (4, 61), (7, 90), (4, 2)):
        rng = random.Random(period)
        closes = [100 + rng.uniform(-1, 1) for _ in range(n)]
        hit = lambda t: any((closes[t + k] - closes[t]) / closes[t] * 100 >= 0.8 for k in range(1, period) if t + k < n)
        expected = {}
        for o in range(min(period + 1, n)):
            i, hits = o, 0
            while i + period <= n:
                hits, i = (hits + 1, i + period) if hit(i) else (hits, i + 1)
            expected[o] = hits
        if block >= period:
            assert {r.offset: r.signals for r in labels.count_from_offsets(frame(spark, closes), period, 0.8, block).collect()} == expected


@pytest.mark.parametrize("name", ["ATR", "BBANDS", "PLUS_DM", "HT_TRENDMODE", "AROON", "RSI", "TRANGE"])
def test_a_sweep_has_each_combinations_own_signals(spark, name):
    df = labels.label_periods(frame(spark, walk(120, 5)))
    combos = match.sampled(match.grid(name, most=50), 4)
    found = match.sweep_signals(df, name, combos).orderBy("combo_id", "bar_idx").collect()
    expected = [(k, r.bar_idx, r.entry, r.exit) for k, c in enumerate(combos) for r in with_indicator(df, name, **c).orderBy("bar_idx").collect()]
    assert [(r.combo_id, r.bar_idx, r.entry, r.exit) for r in found] == expected
    few = match.sweep_signals(df, name, combos, only_signals=True)
    assert match.match_score(few, keys=("combo_id", "symbol")).orderBy("combo_id").collect() == match.match_score(match.sweep_signals(df, name, combos), keys=("combo_id", "symbol")).orderBy("combo_id").collect()
