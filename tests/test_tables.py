import math
import random

import numpy as np
import pytest

from tidemark.functions.tails import fisher_two_sided, student_tail
from tidemark.operators import association, mlprep, population, runlog
from tidemark.sources import files
from tidemark.sources.views import load_view
from tidemark.streaming.live import bars_from_stream


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(2), int(rng.random() < 0.2), 1, rng.choice(["trade", "hold", None])) for _ in range(400)]
    return spark.createDataFrame(rows, "A_gs_entry int, A_gs_exit int, B_gs_entry int, K_gs_exit int, tradeable string").cache()


NAMES = ["A_gs_entry", "A_gs_exit", "B_gs_entry", "K_gs_exit"]


def test_statistics_by_hand(features):
    stats = {r.feature: r for r in association.all_statistics(association.feature_counts(features, NAMES)).collect()}
    rows = features.collect()
    n, n1 = len(rows), sum(r.tradeable == "trade" for r in rows)
    for f in NAMES:
        sx, sxy = sum(r[f] for r in rows), sum(r[f] for r in rows if r.tradeable == "trade")
        e1, e0 = sx * n1 / n, sx * (n - n1) / n
        chi2 = (sxy - e1) ** 2 / e1 + (sx - sxy - e0) ** 2 / e0
        assert math.isclose(stats[f].chi2, chi2, abs_tol=1e-9) and math.isclose(stats[f].chi2_p, math.erfc(math.sqrt(chi2 / 2)), abs_tol=1e-9)
        cells = [(sxy, sx, n1), (sx - sxy, sx, n - n1), (n1 - sxy, n - sx, n1), (n - sx - n1 + sxy, n - sx, n - n1)]
        assert math.isclose(stats[f].mi, sum(c / n * math.log(c * n / (a * b)) for c, a, b in cells if c), abs_tol=1e-9)
    assert stats["K_gs_exit"].lift == 1 and stats["K_gs_exit"].r_pb == 0 and stats["K_gs_exit"].r_pb_p == 1


def test_fisher():
    # a well-known table: eight of ten against one of seven
    assert math.isclose(fisher_two_sided(8, 2, 1, 5), 0.0349650349, abs_tol=1e-8)
    for a, b, c, d in ((3, 1, 2, 6), (0, 5, 5, 0), (10, 0, 0, 0), (40, 60, 55, 45)):
        row, col, n = a + b, a + c, a + b + c + d
        p = lambda x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col)
        exact = sum(p(x) for x in range(max(0, row + col - n), min(row, col) + 1) if p(x) <= p(a) * (1 + 1e-7))
        assert math.isclose(fisher_two_sided(a, b, c, d), exact, rel_tol=1e-6)


def test_fisher_of_large_tables():
    # 4 million rows: the sum over all tables, term by term in logarithms
    a, b, c, d = 500_100, 499_900, 1_500_000, 1_500_000
    row, col, n = a + b, a + c, a + b + c + d
    log = lambda k: math.lgamma(k + 1)
    p = lambda x: math.exp(log(row) + log(n - row) + log(col) + log(n - col) - log(n) - log(x) - log(row - x) - log(col - x) - log(n - row - col + x))
    exact = math.fsum(v for x in range(a - 6000, a + 6000) if (v := p(x)) <= p(a) * (1 + 1e-7))
    assert math.isclose(fisher_two_sided(a, b, c, d), exact, rel_tol=1e-6)


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10, 199, 200, 201, 5000])
def test_student_against_its_finite_sums(df):
    for t in (0.0, 0.1, 1.0, 2.5, 6.0):
        angle = math.atan(t / math.sqrt(df))
        s, c = math.sin(angle), math.cos(angle)
        if df % 2:
            terms, term = [], c
            for k in range(1, df - 1, 2):
                terms.append(term)
                term *= c * c * (k + 1) / (k + 2)
            inside = 2 / math.pi * (angle + s * math.fsum(terms))
        else:
            terms, term = [], 1.0
            for k in range(2, df + 1, 2):
                terms.append(term)
                term *= c * c * (k - 1) / k
            inside = s * math.fsum(terms)
        assert math.isclose(student_tail(t, df), 1 - inside, rel_tol=1e-6, abs_tol=1e-12)


def test_rules_against_brute_force(features):
    import itertools

    rows = features.collect()
    n, n1 = len(rows), sum(r.tradeable == "trade" for r in rows)
    expected = {}
    for k in (1, 2, 3):
        for s in itertools.combinations(sorted(NAMES), k):
            on = [r for r in rows if all(r[f] for f in s)]
            both = sum(r.tradeable == "trade" for r in on)
            if both >= 0.01 * n and both / len(on) >= 0.3 and both / len(on) / (n1 / n) >= 1:
                expected[s] = both / len(on)
    found = {tuple(r.antecedent): r.confidence for r in association.rules(features, NAMES).collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k]) for k in found)


def test_by_indicator_and_mask(features):
    stats = association.all_statistics(association.feature_counts(features, NAMES))
    rows = {r.indicator: r for r in association.by_indicator(stats).collect()}
    assert set(rows) == {"A", "B", "K"} and rows["B"].exit == 0 and rows["A"].combined == rows["A"].entry + rows["A"].exit
    assert sum(r.selected for r in association.percentile_mask(stats, 50).collect()) == 2


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.7), (0, 0.1), (0, 0.55)], "y_true int, p_trade double")
    row = mlprep.evaluate(mlprep.decode(df, 0.6)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 1, 1, 2) and row.accuracy == 0.6 and row.trade_f1 == 0.5
    none = mlprep.evaluate(mlprep.decode(df.filter("y_true = 0 AND p_trade < 0.5"))).first()
    assert none.trade_precision == none.trade_recall == none.trade_f1 == 0 and none.accuracy == 1
    best = mlprep.threshold_sweep(df).filter("best").first()
    assert best.threshold == 0.75 and best.trade_f1 == pytest.approx(2 / 3)


def test_scaling_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [(r.a, r.b) for r in mlprep.scale(df, ["a", "b"]).collect()] == [(-1, 0), (1, 0)]
    assert [r.a for r in mlprep.scale(df, ["a"], "minmax").collect()] == [0, 1]
    y = spark.createDataFrame([(0,)] * 3 + [(1,)], "y int")
    assert {r["class"]: round(r.weight, 4) for r in mlprep.class_weights(y).collect()} == {0: 0.6667, 1: 2.0}
    assert sum(r.weight for r in mlprep.class_weights(y, power=0.5).collect()) == pytest.approx(2)


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label"):
        mlprep.encode_target(spark.createDataFrame([("buy",)], "tradeable string")).collect()


def test_run_log(spark, sf):
    log = load_view(spark, sf, "opt_log").cache()
    rows = [r for r in log.collect() if r.iteration >= 0]
    bound = sorted(r.fitness for r in rows)
    at = (len(bound) - 1) * 0.1
    bound = bound[int(at)] + (bound[int(at) + 1] - bound[int(at)]) * (at % 1)
    top = [r for r in rows if r.fitness <= bound]
    elite = runlog.elite(log).first()
    assert (elite.n, elite.n_elite) == (len(rows), len(top))
    tests = {r.name: r for r in runlog.elite_tests(log).collect()}
    a, b = [r.dropout for r in top], [r.dropout for r in rows if r.fitness > bound]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    d = max(abs(sum(x <= v for x in a) / len(a) - sum(y <= v for y in b) / len(b)) for v in set(a + b))
    assert math.isclose(tests["dropout"].u, u) and math.isclose(tests["dropout"].ks, d) and 0 <= tests["dropout"].u_p <= 1
    assert runlog.feature_importance(log).count() == 3 and 0 <= runlog.confidence(log).first().confidence <= 1


def test_credit_by_hand(spark):
    rows = [(0, 50.0, ["a"]), (0, -300.0, ["a", "b"]), (1, 100.0, ["b"]), (2, -1000.0, ["b"])]
    df = spark.createDataFrame(rows, "iteration int, fitness double, slots array<string>")
    found = {(r.slot, r.iteration): r.credit for r in population.slot_credit(df).collect()}
    a0 = 0.9 + 100 / 7 - 1
    b0 = 0.9 - 1
    assert found[("a", 0)] == pytest.approx(a0) and found[("b", 0)] == pytest.approx(max(b0, 0.1))
    assert found[("a", 1)] == pytest.approx(a0 * 0.9) and found[("b", 1)] == pytest.approx(0.09 + 100 / 7) and found[("b", 2)] == pytest.approx((0.09 + 100 / 7) * 0.9)
    stats = {r.iteration: r for r in population.iteration_stats(df).collect()}
    assert stats[2].valid == 0 and stats[2]["mean"] == 0 and stats[2].best_so_far == 100


def test_choice_without_replacement(spark):
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1), ("d", 0.0)], "slot string, weight double")
    rows = population.choose(weights, spark.range(400).withColumnRenamed("id", "draw"), 1, 2).collect()
    draws = {}
    for r in rows:
        draws.setdefault(r.draw, []).append(r.slot)
    assert len(draws) == 400 and all(len(v) == len(set(v)) <= 2 for v in draws.values()) and not any("d" in v for v in draws.values())
    assert sum("a" in v for v in draws.values()) > sum("c" in v for v in draws.values())


def test_vectors(spark):
    df = spark.createDataFrame([([1, 0, 1],), ([0, 0, 0],)], "vector array<int>")
    names = ["x", "y", "z"]
    rows = population.encode_names(population.decode_vector(df, names), names, out="again").collect()
    assert [r.chosen for r in rows] == [["x", "z"], []] and all(r.again == r.vector for r in rows)


TABLE = """loading
STRATEGY SUMMARY
┏━━━┓
┃ Strategy ┃ Trades ┃ Avg Profit % ┃ Tot Profit USDT ┃ Tot Profit % ┃ Avg Duration ┃ Win  Draw  Loss  Win% ┃ Drawdown ┃
│ ACO_9_9 │ 8 │ 0.26 │ 6.558 │ 0.66 │ 2:15:00 │ 3 4 1 37.5 │ 17.425 USDT 1.71% │
│ ACO_45_22 │ 8 │ 0.9 │ 20.756 │ 2.08 │ 1:00:00 │ 8 0 0 100 │ 0 USDT 0.00% │
└───┘
│ later │ 1 │ 2 │ 3 │ 4 │"""


def test_summary_tables(spark):
    rows = files.summary_rows(spark.createDataFrame([(1, TABLE), (2, "nothing here")], "k int, value string")).orderBy("place").collect()
    assert [r.cells for r in rows] == [["ACO_9_9", "8", "0.26", "6.558", "0.66"], ["ACO_45_22", "8", "0.9", "20.756", "2.08"]]
    lines = spark.createDataFrame([(x,) for x in TABLE.split("\n")], "line string")
    header = next(x for x in TABLE.split("\n") if "Trades" in x)
    row = files.strategy_row(lines, header, "ACO_9_9").first()
    assert (row.trades, row.profit, row.win_rate, row.drawdown) == (8, 6.558, 0.375, 17.425)


def test_logs_and_exports(spark, sf, tmp_path):
    log = load_view(spark, sf, "opt_log")
    files.append_log(log.select("run_id", "iteration", "fitness").limit(50), f"{tmp_path}/a")
    files.append_log(log.select("run_id", "iteration", "fitness", "dropout").limit(30), f"{tmp_path}/b")
    back = files.load_logs(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert set(back.columns) == {"run_id", "iteration", "fitness", "dropout"} and back.filter("iteration < 0").count() == 0
    assert files.load_logs(spark, [f"{tmp_path}/a"], ["R"]).filter("run_id <> 'R'").count() == 0
    bars = load_view(spark, sf, "bars")
    for symbol in ("click", "error"):
        part = bars.filter(f"symbol = '{symbol}'").drop("symbol", "bar_idx").withColumnRenamed("bar_ts", "date")
        part.coalesce(1).write.parquet(f"{tmp_path}/{symbol}")
        next((tmp_path / symbol).glob("part-*")).rename(tmp_path / f"{symbol.upper()}_USDT-1h.parquet")
    loaded = files.load_bars(spark, f"{tmp_path}/*_USDT-1h.parquet")
    assert sorted(r.symbol for r in files.symbols(loaded).collect()) == ["CLICK", "ERROR"]
    (tmp_path / "c.json").write_text('{"iteration": 5, "best_fitness": 1.5, "fitness_history": [1.0, 1.5]}')
    assert [(r.step, r.fitness) for r in files.fitness_history(files.load_json(spark, f"{tmp_path}/c.json")).collect()] == [(0, 1.0), (1, 1.5)]
    files.export(bars, f"{tmp_path}/out", partition_by="symbol")
    assert spark.read.parquet(f"{tmp_path}/out").count() == bars.count()
    found = files.load_indicator_config('{"indicators": {"RSI": {"category": "momentum", "params": {"timeperiod": {"default": 14}}, "outputs": ["rsi"]}}}')
    assert found["RSI"]["outputs"] == ["rsi"] and files.categories() == ["cycle", "momentum", "overlap", "volatility", "volume"] and len(files.by_category("cycle")) == 5


def test_stream_and_batch_agree(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet".replace("events.parquet", "event*.parquet"))
    query = bars_from_stream(stream).writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.symbol, r.bar_ts): (r.open, r.high, r.low, r.close, r.volume) for r in load_view(spark, sf, "bars").collect()}
    live = {(r.symbol, r.bar_ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("live").collect()}
    assert live and all(batch[k] == v for k, v in live.items())


def test_percentiles_are_exact(spark):
    import numpy as np

    from tidemark.functions.percentiles import percentiles

    rng = np.random.default_rng(2)
    groups = {"one": [3.5], "equal": [2.0] * 9, "few": [1.0, 2.0, 2.0, 7.0], "normal": rng.normal(size=500).tolist(), "wide": (10 ** rng.uniform(-300, 300, 300)).tolist(), "steps": rng.integers(0, 5, 400).astype(float).tolist()}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in [*own, None]], "g string, v double").repartition(4)
    shares = [0.0, 0.05, 0.5, 0.9, 1.0]
    for bins in (2, 4096):
        found = {r.g: r.q for r in percentiles(df, "v", shares, ("g",), bins).collect()}
        assert set(found) == set(groups)
        for g, own in groups.items():
            assert np.allclose(found[g], np.quantile(own, shares), rtol=1e-12, atol=0), (g, bins)
    every = [v for own in groups.values() for v in own]
    assert np.allclose(percentiles(df, "v", [0.3]).first().q, np.quantile(every, [0.3]))
    assert not percentiles(df.filter("v IS NULL"), "v", [0.5]).collect()


def test_clamped_maps_compose():
    import numpy as np

    from tidemark.operators.passes import folded, folded_between

    rng = np.random.default_rng(4)
    for n in (1, 127, 128, 1000):
        a, b, low = rng.uniform(0, 1.2, n), rng.normal(0, 3, n), rng.uniform(-2, 0, n)
        high = low + rng.uniform(0, 4, n)
        y, z, expected, plain = 0.5, 0.5, [], []
        for k in range(n):
            y, z = min(max(a[k] * y + b[k], low[k]), high[k]), a[k] * 0.5 * z + b[k]
            expected.append(y)
            plain.append(z)
        assert np.allclose(folded_between(a, b, low, high, 0.5), expected) and np.allclose(folded(a * 0.5, b, 0.5), plain)


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_rules_are_those_of_all_sets(spark, longest):
    import itertools

    rng = random.Random(3)
    names = [f"f{k}" for k in range(7)]
    rows = [([rng.choice([None, 0, 1]) if rng.random() < 0.4 else int(rng.random() < 0.6) for _ in names], rng.choice(["trade", "hold", None])) for _ in range(300)]
    df = spark.createDataFrame([(*r, t) for r, t in rows], ", ".join(f"{n} int" for n in reversed(names)) + ", tradeable string").repartition(5)
    order = list(reversed(names))
    expected, n1 = {}, sum(t == "trade" for _, t in rows)
    for size in range(1, longest + 1):
        for s in itertools.combinations(names, size):
            held = [t for r, t in rows if all(r[order.index(f)] == 1 for f in s)]
            both = sum(t == "trade" for t in held)
            if both >= 0.05 * len(rows):
                expected[s] = (both, both / len(held), both / len(held) / (n1 / len(rows)))
    found = {tuple(r.antecedent): (r.n_both, r.confidence, r.lift) for r in association.rules(df, names, least_support=0.05, least_confidence=0.0, least_lift=0.0, longest=longest).collect()}
    assert set(found) == set(expected)
    for s, values in expected.items():
        assert found[s][0] == values[0] and abs(found[s][1] - values[1]) < 1e-12 and abs(found[s][2] - values[2]) < 1e-9
    assert association.rules(df.filter("false"), names, longest=longest).count() == 0


def test_exact_tails_are_those_of_all_orders():
    import itertools

    from tidemark.functions.tails import rank_sum_two_sided, smirnov_two_sided

    for n1, n2 in ((2, 3), (4, 4), (3, 7), (6, 5)):
        ds, us = [], []
        for first in itertools.combinations(range(n1 + n2), n1):
            a, b, gap = 0, 0, 0.0
            for k in range(n1 + n2):
                a, b = a + (k in first), b + (k not in first)
                gap = max(gap, abs(a / n1 - b / n2))
            ds.append(gap)
            us.append(sum(first) + n1 - n1 * (n1 + 1) // 2)
        for d in set(ds):
            assert math.isclose(smirnov_two_sided(d, n1, n2), sum(x >= d - 1e-9 for x in ds) / len(ds), abs_tol=1e-12)
        for u in set(us):
            far = max(u, n1 * n2 - u)
            assert math.isclose(rank_sum_two_sided(u, n1, n2), min(1.0, 2 * sum(x >= far for x in us) / len(us)))
    assert 0.001 < smirnov_two_sided(0.03, 5000, 9000) < 0.01 and math.isclose(rank_sum_two_sided(0, 3, 4000), 2 / math.comb(4003, 3))


def test_arrow_files_round_trip(spark, tmp_path, sf):
    import pandas as pd
    import pyarrow as pa
    from pyarrow import feather

    bars = load_view(spark, sf, "bars")
    upper = bars.selectExpr("upper(symbol) AS symbol", *[c for c in bars.columns if c != "symbol"])
    files.export_arrow_bars(upper, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == bars.select("symbol").distinct().count() and all("_USDT-" in n and n.endswith(".feather") for n in names)
    found = files.load_arrow_bars(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, found.select(upper.columns).collect())) == sorted(map(tuple, upper.collect()))
    # files as other tools write them: zoned times, further columns, another order, no rows, names without a symbol
    frame = pd.DataFrame({"volume": [1, 2], "date": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00"], utc=True), "close": [1.5, 2.5], "open": [1.0, 1.5], "high": [2.0, 3.0], "low": [0.5, 1.0], "extra": ["a", "b"]})
    for name, rows in (("BTC_USDT-1h.feather", frame), ("ETH_USDT-1h.feather", frame[:0]), ("XRP_USDT-1h.feather", frame[1:]), ("notes.feather", frame)):
        feather.write_feather(pa.Table.from_pandas(rows, preserve_index=False), str(tmp_path / name))
    (tmp_path / "BTC_USDT.txt").write_text("no table")
    found = [(r.symbol, str(r.bar_ts), r.close, r.volume, r.bar_idx) for r in files.load_arrow_bars(spark, str(tmp_path)).orderBy("symbol", "bar_ts").collect()]
    assert found == [("BTC", "2024-01-01 00:00:00", 1.5, 1.0, 0), ("BTC", "2024-01-01 01:00:00", 2.5, 2.0, 1), ("XRP", "2024-01-01 01:00:00", 2.5, 2.0, 0)]
    (tmp_path / "XRP_USDT-1h.feather").write_bytes(b"damaged")  # a file that the filter leaves out is not opened
    assert files.load_arrow_bars(spark, str(tmp_path), only=["BTC"]).count() == 2
    empty = tmp_path / "none"
    empty.mkdir()
    assert files.load_arrow_bars(spark, str(empty)).count() == 0


def test_config_from_a_file():
    text = '{"operators": {"lt": "<"}, "indicators": {"A": {"name": "Alpha", "category": "x", "params": {"n": {"default": 3, "range": [1, 5]}, "fixed": 7}, "outputs": ["a"]}, "B": {"category": "y"}}}'
    found = files.load_config(text)
    assert found.names() == ["A", "B"] and found.categories() == ["x", "y"] and list(found.by_category("y")) == ["B"] and len(found.by_category()) == 2
    assert found.indicator("A")["params"] == {"n": {"default": 3, "range": [1, 5]}} and found.indicator("B")["full_name"] == "B"
    assert found.symbol("lt") == "<" and found.symbol("crosses_above") == "crosses_above"
    with pytest.raises(ValueError):
        found.indicator("C")


def test_running_sums_and_ranks_over_ranges(spark):
    """A key with nearly all rows, nulls, ties and one value of many rows: sums and ranks as of one window, no range with more than a small part."""
    from pyspark.sql import functions as F

    from tidemark.functions import running

    df = spark.range(6000).selectExpr("if(id % 50 = 0, null, if(id % 50 = 1, 'b', 'a')) AS g", "CAST(id * 7919 % 6007 AS DOUBLE) AS o", "if(id % 7 = 0 OR id < 100, null, id) AS v").cache()
    w = "OVER (PARTITION BY g ORDER BY o ROWS UNBOUNDED PRECEDING)"
    expected = sorted(map(str, df.selectExpr("*", f"sum(v) {w} AS s").collect()))
    for each in (50, 700, 10**6):
        found = running.running_sums(df, ["g"], ["o"], {"s": "v"}, each=each)
        assert sorted(map(str, found.collect())) == expected
    found = running.running_sums(df, ["g"], ["o"], {"s": "v"}, each=50)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 600
    values = df.selectExpr("CASE WHEN o < 2000 THEN -0.0D WHEN o = 2500 THEN null WHEN o = 2600 THEN double('NaN') ELSE floor(o / 3) END AS x").cache()
    ranks = running.mean_ranks(values, [], "x", "r", values.count())
    plain = values.filter("x IS NOT NULL").selectExpr("x", "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0D AS r")
    for each in (50, 10**6):
        assert sorted(map(str, running.join_ranks(values, ranks, "x", values.count(), each=each).selectExpr("x + 0.0D AS x", "r").collect())) == sorted(map(str, plain.selectExpr("x + 0.0D AS x", "r").collect()))


def test_spearman_of_nulls_and_ties(spark):
    rng = np.random.default_rng(4)
    n = 3000
    fitness = np.where(rng.random(n) < 0.3, 1000.0, rng.normal(size=n))
    a = np.where(rng.random(n) < 0.5, np.round(fitness, 1), rng.normal(size=n))
    rows = [(0, float(f), float(x), None if k % 3 else float(x > 0), 1.0) for k, (f, x) in enumerate(zip(fitness, a))]
    log = spark.createDataFrame(rows, "iteration int, fitness double, a double, b double, c double").selectExpr("*", *[f"0D AS {p}_{s}" for p in "abc" for s in ("lower", "upper")])
    found = {r.name: r.rho for r in runlog.spearman(log).collect()}

    def ranks(x):
        _, at, count = np.unique(x, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[at]

    gain, some = ranks(-fitness), np.arange(n) % 3 == 0
    assert found["a"] == pytest.approx(np.corrcoef(ranks(a), gain)[0, 1], abs=1e-12)
    assert found["b"] == pytest.approx(np.corrcoef(ranks(a[some] > 0), gain[some])[0, 1], abs=1e-12)
    assert found["c"] == 0


@pytest.fixture
def asked(monkeypatch):
    """What running sums are asked for, all in ranges of 64 rows."""
    from tidemark.functions import running
    from tidemark.operators import trades

    found, plain = [], running.running_sums

    def seen(df, keys, order, sums, most=None, each=64):
        found.append(sorted(sums.values()))
        return plain(df, keys, order, sums, most, each)

    for module in (running, trades, runlog):
        monkeypatch.setattr(module, "running_sums", seen, raising=False)
    return found


def test_no_task_ranks_a_whole_parameter(spark, asked):
    log = spark.range(5000).selectExpr("1 AS iteration", "CAST(id * 7919 % 6007 AS DOUBLE) AS fitness", "CAST(id AS DOUBLE) AS a", "0D AS a_lower", "0D AS a_upper")
    assert abs(runlog.spearman(log).first().rho) < 0.1 and asked == [["rows_"], ["rows_"]]


def test_no_task_sums_a_whole_pair(spark, asked):
    from tidemark.operators import trades

    df = spark.range(5000).selectExpr("'p' AS pair", "timestamp_seconds(id * 7919 % 6007) AS close_date", "timestamp_seconds(0) AS open_date", "id AS l_orderkey", "1 AS l_linenumber", "CAST(id % 11 - 5 AS DOUBLE) AS profit_abs")
    total, rows = 0, sorted(trades.cumulative_profit(df).collect(), key=lambda r: r.close_date)
    for r in rows:
        total += r.profit_abs
        assert r.running_profit == total
    assert len(rows) == 5000 and asked == [["profit_abs"]]
