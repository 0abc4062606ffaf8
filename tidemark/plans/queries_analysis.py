"""Queries on optimization logs, strategy populations and text tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import population, runlog
from tidemark.sources import files
from tidemark.plans.common import sql_erfc, sql_student
from tidemark.sources.views import sql_view

L, TEXT = sql_view("opt_log"), sql_view("bt_text")
V = f"SELECT * FROM ({L}) WHERE iteration >= 0"
TOP = f"SELECT *, fitness <= (SELECT quantile_cont(fitness, 0.1) FROM ({V})) AS top FROM ({V})"
FEATS, PARAMS = ("feat_0", "feat_1", "feat_2"), ("dropout", "hidden_size")
LONG_F = " UNION ALL ".join(f"SELECT '{f}' AS name, {f}::DOUBLE AS value, fitness, top, iteration FROM ({TOP})" for f in FEATS)
LONG_P = " UNION ALL ".join(f"SELECT '{p}' AS name, {p}::DOUBLE AS value, {p}_lower AS lo, {p}_upper AS hi, fitness, top FROM ({TOP})" for p in PARAMS)
IMPORTANCE = f"SELECT name, coalesce(corr(value, -fitness), 0.0) AS r, abs(coalesce(corr(value, -fitness), 0.0)) AS abs_r, avg(value) FILTER (top) AS frequency FROM ({LONG_F}) GROUP BY name"
RANGES = f"""SELECT *, CASE WHEN used < 0.3 * span THEN 'narrow' WHEN low_share > 0.3 THEN 'lower_bound' WHEN high_share > 0.3 THEN 'upper_bound' ELSE 'centered' END AS proximity, CASE WHEN span <= 0 THEN 1.0 ELSE least(used / nullif(span, 0), 1.0) END AS utilization, 0.2 * used AS margin
FROM (SELECT name, n, lower, upper, p5, p10, p90, p95, upper - lower AS span, p90 - p10 AS used, (SELECT avg(CASE WHEN t.value <= b.lower + 0.2 * (b.upper - b.lower) THEN 1.0 ELSE 0.0 END) FROM ({LONG_P}) t WHERE t.top AND t.name = b.name) AS low_share,
(SELECT avg(CASE WHEN t.value >= b.upper - 0.2 * (b.upper - b.lower) THEN 1.0 ELSE 0.0 END) FROM ({LONG_P}) t WHERE t.top AND t.name = b.name) AS high_share
FROM (SELECT name, count(*) AS n, min(lo) AS lower, max(hi) AS upper, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95 FROM ({LONG_P}) WHERE top GROUP BY name) b)"""
PROGRESS = f"SELECT iteration, -min(fitness) AS best FROM ({V}) GROUP BY iteration"
CONVERGENCE = f"SELECT CASE WHEN n < 2 THEN 0.0 WHEN f = 0 THEN CASE WHEN l = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - l / f) END AS rate FROM (SELECT arg_min(v, iteration) AS f, arg_max(v, iteration) AS l, count(*) AS n FROM (SELECT iteration, var_samp(fitness) AS v FROM ({V}) GROUP BY iteration))"
TESTS = f"""WITH x AS (SELECT name, value, top FROM ({LONG_P})), s AS (SELECT name, count(*) FILTER (top) AS n1, count(*) FILTER (NOT top) AS n0, avg(value) FILTER (top) AS m1, avg(value) FILTER (NOT top) AS m0, var_samp(value) FILTER (top) AS v1, var_samp(value) FILTER (NOT top) AS v0 FROM x GROUP BY name),
c AS (SELECT name, value, count(*) FILTER (top) AS c1, count(*) FILTER (NOT top) AS c0 FROM x GROUP BY name, value), f AS (SELECT *, sum(c1) OVER w AS f1, sum(c0) OVER w AS f0 FROM c WINDOW w AS (PARTITION BY name ORDER BY value)),
k AS (SELECT f.name, max(abs(f1::DOUBLE / n1 - f0::DOUBLE / n0)) AS ks, sum(c1 * (f1 + f0 - (c1 + c0) + (c1 + c0 + 1) / 2.0)) AS ranks FROM f JOIN s ON f.name = s.name GROUP BY f.name)
SELECT s.name, coalesce(CASE WHEN n1 + n0 > 2 THEN (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) END, 0.0) AS cohens_d, ks, ranks - n1 * (n1 + 1) / 2.0 AS u FROM s JOIN k ON s.name = k.name"""
#: A population of individuals from the log: profit around zero, and the slots that an individual chose.
POP = f"SELECT iteration, CAST(-fitness * 100 - 8 AS DOUBLE) AS fitness, feat_0, feat_1, feat_2 FROM ({V})"
CREDIT = f"""WITH RECURSIVE p AS MATERIALIZED ({POP}), b AS (SELECT iteration, max(max(fitness)) OVER (ORDER BY iteration) AS best FROM p GROUP BY iteration),
d AS (SELECT iteration, slot, sum(CASE WHEN on_ = 0 THEN 0.0 WHEN fitness > -1000 AND fitness < 0 THEN -100.0 * abs(fitness) / 30000 WHEN fitness > 0 AND best > 0 THEN 100.0 * pow(fitness / best, 2) / 7 ELSE 0.0 END) AS d FROM (SELECT p.*, best, slot, CASE slot WHEN 'feat_0' THEN feat_0 WHEN 'feat_1' THEN feat_1 ELSE feat_2 END AS on_ FROM p JOIN b ON p.iteration = b.iteration, (VALUES ('feat_0'), ('feat_1'), ('feat_2')) v(slot)) GROUP BY iteration, slot),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY iteration) AS k FROM d),
r(slot, k, credit) AS (SELECT slot, 0, 1.0::DOUBLE FROM o GROUP BY slot UNION ALL SELECT o.slot, o.k, least(greatest(r.credit * 0.9 + o.d, 0.1), 15.0) FROM r JOIN o ON o.slot = r.slot AND o.k = r.k + 1)
SELECT r.slot, o.iteration, r.credit FROM r JOIN o ON o.slot = r.slot AND o.k = r.k"""
LAST = f"SELECT slot, arg_max(credit, iteration) AS credit FROM ({CREDIT}) GROUP BY slot"
ETA = {"feat_0": 1.1, "feat_1": 0.9}


def individuals(log: DataFrame) -> DataFrame:
    rows = runlog.valid(log).select("iteration", (-F.col("fitness") * 100 - 8).alias("fitness"), *FEATS)
    return rows.withColumn("slots", F.filter(F.array(*[F.when(F.col(f) == 1, f) for f in FEATS]), lambda x: x.isNotNull()))


def last_credit(log: DataFrame) -> DataFrame:
    return population.slot_credit(individuals(log)).groupBy("slot").agg(F.max_by("credit", "iteration").alias("credit"))


def add_to(register) -> None:
    log = "opt_log"
    keys = ("run_id", "iteration", "individual_idx", "fitness")
    register("log1_top", log, lambda d: runlog.with_top(runlog.valid(d)).filter("top").select(*keys), f"SELECT {', '.join(keys)} FROM ({TOP}) WHERE top /*round: fitness*/ /*count: iteration, individual_idx*/")
    register("log2_3_importance", log, lambda d: runlog.feature_importance(d).select("name", "r", "abs_r", "frequency"), f"SELECT * FROM ({IMPORTANCE}) /*round: r, abs_r, frequency*/")
    columns = [c for c in ("name", "r", "abs_r", "frequency")]
    register("log2_p_values", log, lambda d: runlog.feature_importance(d).select(*columns, "p"), f"SELECT {', '.join(columns)}, {sql_student('r', 'n')} AS p FROM (SELECT * FROM ({IMPORTANCE}), (SELECT count(*) AS n FROM ({V}))) /*round: r, abs_r, frequency, p*/")
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum({a} * {b})::DOUBLE / sqrt((CASE WHEN sum({a}) = 0 THEN 1 ELSE sum({a}) END * CASE WHEN sum({b}) = 0 THEN 1 ELSE sum({b}) END)::DOUBLE) AS cosine FROM ({V})" for a in FEATS for b in FEATS if a < b)
    register("log4_cosine", log, runlog.feature_cosine, f"SELECT * FROM ({pairs}) /*round: cosine*/")
    ranked = f"SELECT name, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY name ORDER BY -fitness) + (count(*) OVER (PARTITION BY name, fitness) - 1) / 2.0 AS b FROM ({LONG_P})"
    register("log5_spearman", log, runlog.spearman, f"SELECT name, coalesce(corr(a, b), 0.0) AS rho FROM ({ranked}) GROUP BY name /*round: rho*/")
    names = ("name", "n", "lower", "upper", "p5", "p10", "p90", "p95", "utilization", "proximity")
    register("log6_7_ranges", log, lambda d: runlog.parameter_ranges(d).select(*names), f"SELECT {', '.join(names)} FROM ({RANGES}) /*round: lower, upper, p5, p10, p90, p95, utilization*/")
    bounds = f"""SELECT name, CASE WHEN proximity = 'lower_bound' THEN lower - 0.5 * span WHEN proximity = 'upper_bound' THEN lower WHEN utilization < 0.3 THEN greatest(p5 - margin, 0.5 * lower) ELSE lower END AS new_lower,
        CASE WHEN proximity = 'upper_bound' THEN upper + 0.5 * span WHEN proximity = 'lower_bound' THEN upper WHEN utilization < 0.3 THEN least(p95 + margin, 1.5 * upper) ELSE upper END AS new_upper FROM ({RANGES}) /*round: new_lower, new_upper*/"""
    register("log8_bounds", log, lambda d: runlog.parameter_ranges(d).select("name", "new_lower", "new_upper"), bounds)
    register("log9_progression", log, runlog.progression, f"SELECT * FROM ({PROGRESS}) /*round: best*/ /*count: iteration*/")
    register("log10_convergence", log, runlog.convergence, f"SELECT rate, rate >= 0.7 AS converged FROM ({CONVERGENCE}) /*round: rate*/")
    register("log11_stability", log, runlog.feature_stability, f"SELECT name, 1 - var_pop(rate) AS stability, avg(rate) AS mean_rate FROM (SELECT name, iteration, avg(value) AS rate FROM ({LONG_F}) GROUP BY name, iteration) GROUP BY name /*round: stability, mean_rate*/")
    register("log12_elite", log, runlog.elite, f"SELECT count(*) AS n, count(*) FILTER (top) AS n_elite, avg(CASE WHEN top THEN 1.0 ELSE 0.0 END) AS fraction, min(fitness) AS best, {', '.join(f'avg({f}) FILTER (top) AS {f}_rate' for f in FEATS)} FROM ({TOP}) /*round: fraction, best, {', '.join(f + '_rate' for f in FEATS)}*/")
    register("log13_15_tests", log, lambda d: runlog.elite_tests(d).select("name", "cohens_d", "ks", "u"), f"SELECT * FROM ({TESTS}) /*round: cohens_d, ks, u*/")
    quantiles = f"SELECT name, quantile_cont(CAST(value AS DOUBLE), 0.05) FILTER (top) AS low, quantile_cont(CAST(value AS DOUBLE), 0.95) FILTER (top) AS high FROM ({LONG_P}) GROUP BY name"
    ties = f"SELECT name, sum(c * c * c - c) AS ties FROM (SELECT name, value, count(*)::DOUBLE AS c FROM ({LONG_P}) GROUP BY name, value) GROUP BY name"
    sizes = f"SELECT name, count(*) FILTER (top)::DOUBLE AS n1, count(*) FILTER (NOT top)::DOUBLE AS n0 FROM ({LONG_P}) GROUP BY name"
    deviation = "greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0)"
    tests = f"SELECT t.*, low, high, ks * sqrt(n1 * n0 / (n1 + n0)) AS x, {deviation} / sqrt(2) AS z FROM ({TESTS}) t JOIN ({sizes}) s ON t.name = s.name JOIN ({quantiles}) q ON t.name = q.name JOIN ({ties}) e ON t.name = e.name"
    tails = f"SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2 * k * k * x * x))))) END AS ks_p, coalesce({sql_erfc('z')}, 1.0) AS u_p FROM ({tests})"
    scores = f"SELECT *, 0.4 * least(abs(cohens_d), 2) / 2 + 0.3 * ks + 0.3 * (1 - least(ks_p, u_p)) AS influence FROM ({tails})"
    words = """concat_ws('; ', CASE WHEN abs(cohens_d) >= 0.8 THEN 'very large' WHEN abs(cohens_d) >= 0.5 THEN 'medium' WHEN abs(cohens_d) >= 0.2 THEN 'small' ELSE 'negligible' END || ' effect (' || CASE WHEN cohens_d > 0 THEN 'higher' ELSE 'lower' END || ' in elites)',
        CASE WHEN ks_p < 0.01 THEN 'highly significant (p<0.01)' WHEN ks_p < 0.05 THEN 'significant (p<0.05)' ELSE 'not significant' END, CASE WHEN ks > 0.3 THEN 'distinct distribution' WHEN ks > 0.15 THEN 'moderate distribution shift' END, printf('elite range: [%.4f, %.4f]', low, high))"""
    register("log16_influence", log, runlog.elite_tests, f"SELECT name, cohens_d, ks, ks_p, u, u_p, influence, low, high, row_number() OVER (ORDER BY influence DESC, name) AS rank, {words} AS effect FROM ({scores}) /*round: cohens_d, ks, ks_p, u, u_p, influence, low, high*/ /*count: rank*/")
    suggest = f"SELECT name, abs_r, frequency, CASE WHEN abs_r > 0.1 AND frequency > 0.5 THEN 'keep' WHEN abs_r < 0.02 AND frequency < 0.2 THEN 'consider_removing' ELSE 'neutral' END AS suggestion FROM ({IMPORTANCE}) /*round: abs_r, frequency*/"
    register("log17_suggestions", log, lambda d: runlog.suggestions(runlog.feature_importance(d)), suggest)
    advice = f"""SELECT n, early, late, CASE WHEN n > 5 AND late > 0.1 * early THEN 150.0 ELSE 100.0 END AS iterations, CASE WHEN rate > 0.8 THEN least(0.2, 0.15) ELSE 0.1 END AS pf_max FROM (SELECT max(n) AS n, max(best) FILTER (i <= 5) - min(best) FILTER (i <= 5) AS early,
        max(best) FILTER (i > n - 5) - min(best) FILTER (i > n - 5) AS late FROM (SELECT *, row_number() OVER (ORDER BY iteration) AS i, count(*) OVER () AS n FROM ({PROGRESS}))), ({CONVERGENCE}) /*round: early, late, iterations, pf_max*/"""
    register("log18_settings", log, runlog.settings_advice, advice)
    certain = f"SELECT (least(5 * a, 1.0) + b + least((top - first) / nullif(abs(first), 0), 1.0)) / 3 AS confidence FROM (SELECT max(abs_r) AS a FROM ({IMPORTANCE})), (SELECT 1 - stddev_pop(utilization) AS b FROM ({RANGES})), (SELECT arg_min(best, iteration) AS first, max(best) AS top FROM ({PROGRESS})) /*round: confidence*/"
    register("log19_confidence", log, runlog.confidence, certain)
    totals = f"SELECT list_sort(list(DISTINCT run_id)) AS run_ids, count(*) AS n, count(DISTINCT iteration) AS iterations, min(fitness) AS best_fitness FROM ({V}) /*round: best_fitness*/"
    register("log20_report", log, lambda d: runlog.report(d).select("run_ids", "n", "iterations", "best_fitness"), totals)
    hp = ("dropout", "hidden_size")
    plain = lambda text: re.sub(r"/\*(round|count): [^*]*\*/", "", text)
    best = f"SELECT run_id, iteration, individual_idx, {', '.join((*FEATS, *hp))} FROM ({V}) ORDER BY fitness, run_id, iteration, individual_idx LIMIT 1"
    sides = ", ".join(f"max(new_{side}) FILTER (name = '{k}') AS {k}_{side}" for k in hp for side in ("lower", "upper"))
    joined = f"SELECT t.*, b.*, rate, rate >= 0.7 AS converged, confidence, r.*, iterations_ AS advised, pf_max, 10.0 AS top_percentile FROM ({plain(totals)}) t, ({best}) b, ({CONVERGENCE}) c, ({plain(certain)}) e, (SELECT {sides} FROM ({plain(bounds)})) r, (SELECT iterations AS iterations_, pf_max FROM ({plain(advice)})) a"
    notes = f"/*round: best_fitness, dropout, hidden_size, rate, confidence, {', '.join(f'{k}_{side}' for k in hp for side in ('lower', 'upper'))}, advised, pf_max, top_percentile*/ /*count: iteration, individual_idx, {', '.join(FEATS)}*/"
    flat = lambda r: r.select("run_ids", "n", "iterations", "best_fitness", *[f"best.{c}" for c in ("run_id", "iteration", "individual_idx", *FEATS, *hp)], "rate", "converged", "confidence", *[F.col("bounds")[k][side].alias(f"{k}_{side}") for k in hp for side in ("lower", "upper")], F.col("settings.iterations").alias("advised"), "settings.pf_max", "top_percentile")
    register("log20_full_report", log, lambda d: flat(runlog.report(d)), f"SELECT * FROM ({joined}) {notes}")
    individual = f"run_id string, iteration int, individual_idx int, {', '.join(f'{f} int' for f in FEATS)}, dropout double, hidden_size double"
    kinds = f"run_ids array<string>, n long, iterations long, best_fitness double, best struct<{individual.replace(' ', ': ').replace(',: ', ', ')}>, rate double, converged boolean, confidence double, bounds map<string, struct<lower: double, upper: double>>, settings struct<iterations: double, pf_max: double>, top_percentile double"
    parsed = lambda d: files.report_json(runlog.report(d)).select(F.from_json("report", kinds).alias("r")).select("r.*")
    register("snk4_full_report_json", log, lambda d: flat(parsed(d)), f"SELECT * FROM ({joined}) {notes}")

    def through(write, read):
        """Rows written by ``write`` (rows, path) and what ``read`` (session, path) finds there."""

        def run(rows: DataFrame) -> DataFrame:
            path = files.scratch(rows.sparkSession, "export")
            write(rows, path)
            return read(rows.sparkSession, path)

        return run

    fields = "n long, iterations long, best_fitness double, rate double, converged boolean"
    register("snk4_report_json", log, lambda d: files.report_json(runlog.report(d)).select(F.from_json("report", fields).alias("r")).select("r.*"), f"SELECT count(*) AS n, count(DISTINCT iteration) AS iterations, min(fitness) AS best_fitness, any_value(rate) AS rate, any_value(rate) >= 0.7 AS converged FROM ({V}), ({CONVERGENCE}) /*round: best_fitness, rate*/")
    chosen = ("run_id", "iteration", "individual_idx", *FEATS, "dropout", "hidden_size", "fitness")
    logs = through(lambda d, path: files.append_log(d.select(*chosen), path), lambda spark, path: files.load_logs(spark, [path], ["A", "R"]))
    register("src3_csv_logs", log, logs, f"SELECT {', '.join(chosen)} FROM ({V}) WHERE run_id IN ('A', 'R') /*round: dropout, hidden_size, fitness*/ /*count: iteration, individual_idx, {', '.join(FEATS)}*/", 9)
    wide = through(lambda d, path: files.export(d, path, "csv"), lambda spark, path: files.load_table(spark, path))
    register("src4_wide_csv", "features01", wide, f"SELECT * FROM ({sql_view('features01')}) /*count: l_orderkey, l_linenumber, QTY_gs_entry, DISC_gs_entry, TAX_gs_exit, STAT_gs_exit*/")
    parts = through(lambda d, path: files.export(d, path, partition_by="tradeable"), lambda spark, path: spark.read.parquet(path).filter("tradeable = 'trade'"))
    register("snk1_partitioned_export", "features01", parts, f"SELECT * FROM ({sql_view('features01')}) WHERE tradeable = 'trade' /*count: l_orderkey, l_linenumber, QTY_gs_entry, DISC_gs_entry, TAX_gs_exit, STAT_gs_exit*/")
    history = through(
        lambda d, path: runlog.progression(d).groupBy().agg(F.max("iteration").alias("iteration"), F.transform(F.sort_array(F.collect_list(F.struct("iteration", "best"))), lambda x: x["best"]).alias("fitness_history")).write.json(path),  # a number for each iteration
        lambda spark, path: files.fitness_history(spark.read.json(path)),
    )
    register("src5_checkpoint_history", log, history, f"SELECT max(iteration) OVER () AS iteration, row_number() OVER (ORDER BY iteration) - 1 AS step, best AS fitness FROM ({PROGRESS}) /*round: fitness*/ /*count: iteration, step*/")

    stats = f"SELECT iteration, max(max(fitness)) OVER (ORDER BY iteration) AS best_so_far, max(fitness) AS iteration_best, avg(fitness) AS mean, stddev_pop(fitness) AS std, count(*) AS valid FROM ({POP}) GROUP BY iteration /*round: best_so_far, iteration_best, mean, std*/ /*count: iteration*/"
    register("pop1_iterations", log, lambda d: population.iteration_stats(individuals(d)), stats)
    register("pop2_credit", log, lambda d: population.slot_credit(individuals(d)), f"SELECT * FROM ({CREDIT}) /*round: credit*/ /*count: iteration*/")
    sides = " UNION ALL ".join(f"SELECT '{side}' AS side, row_number() OVER (ORDER BY credit {way}, slot) AS place, slot, credit FROM ({LAST})" for side, way in (("top", "DESC"), ("bottom", "ASC")))
    register("pop3_top_bottom", log, lambda d: population.top_and_bottom(population.slot_credit(individuals(d)), 2), f"SELECT * FROM ({sides}) WHERE place <= 2 /*round: credit*/ /*count: place*/")
    register("pop4_weights", log, lambda d: population.slot_weights(last_credit(d).withColumn("category", F.col("slot")), ETA), f"SELECT slot, w / sum(w) OVER () AS weight FROM (SELECT slot, credit * pow(CASE slot WHEN 'feat_0' THEN 1.1 WHEN 'feat_1' THEN 0.9 ELSE 1.0 END, 2) AS w FROM ({LAST})) /*round: weight*/")
    draws = lambda d: population.choose(population.slot_weights(last_credit(d).withColumn("category", F.col("slot")), ETA), d.select(F.col("iteration").cast("long").alias("draw")).distinct(), 2, 3)
    register("pop5_choice", log, draws)
    register("pop6_success", log, lambda d: population.success(individuals(d).withColumn("fitness", population.fitness_of(F.col("fitness"), F.col("fitness") < -8))), f"SELECT count(*) AS evaluations, count(*) FILTER (fitness >= -8) AS successful, (count(*) FILTER (fitness >= -8))::DOUBLE / count(*) AS rate FROM ({POP}) /*round: rate*/")
    register("pop7_credit_summary", log, lambda d: population.credit_summary(population.slot_credit(individuals(d))), f"SELECT iteration, avg(credit) AS mean, stddev_pop(credit) AS std, min(credit) AS min, max(credit) AS max FROM ({CREDIT}) GROUP BY iteration /*round: mean, std, min, max*/ /*count: iteration*/")
    register("prd9_vectors", log, lambda d: population.decode_vector(runlog.valid(d).select("run_id", "iteration", "individual_idx", F.array(*FEATS).alias("vector"), "fitness"), list(FEATS)).select("run_id", "iteration", F.array_join("chosen", ",").alias("chosen"), population.is_valid(F.col("chosen"), F.col("chosen")).alias("valid"), "fitness"), f"SELECT run_id, iteration, array_to_string(c, ',') AS chosen, len(c) BETWEEN 2 AND 5 AS valid, fitness FROM (SELECT *, list_filter([CASE WHEN feat_0 = 1 THEN 'feat_0' END, CASE WHEN feat_1 = 1 THEN 'feat_1' END, CASE WHEN feat_2 = 1 THEN 'feat_2' END], lambda v: v IS NOT NULL) AS c FROM ({V})) /*round: fitness*/ /*count: iteration*/", 9)

    cell = lambda k: f"trim(string_split(line, '|')[{k}])"
    register("txt1_cells", "bt_text", lambda t: t.select("k", F.explode(F.slice(files.cells(F.col("line")), 1, 5)).alias("cell")), "SELECT k, cell FROM (SELECT k, unnest([" + ", ".join(cell(k) for k in range(2, 7)) + f"]) AS cell FROM ({TEXT}))")

    def table(t: DataFrame) -> DataFrame:
        header = "| Strategy | Trades | Avg Profit | Tot Profit | Win% |"
        whole = t.groupBy((F.col("k") % 7).alias("k")).agg(F.concat_ws("\n", F.lit("STRATEGY SUMMARY"), F.lit("+---+"), F.lit(header), F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("cache saved"), F.lit("| not | a | row | at | all |")).alias("value"))
        return files.summary_rows(whole).filter(F.col("cells")[0] != "Strategy").select("k", F.col("cells")[0].alias("strategy"), files.number(F.col("cells")[1]).alias("trades"), files.number(F.col("cells")[3]).alias("profit"))

    register("txt1_summary", "bt_text", table, f"SELECT k % 7 AS k, {cell(2)} AS strategy, {cell(3)}::DOUBLE AS trades, {cell(5)}::DOUBLE AS profit FROM ({TEXT}) /*round: trades, profit*/")
    register("txt2_strategy_row", "bt_text", lambda t: files.strategy_row(t, "| Strategy | Trades | Avg Profit | Tot Profit | Win% |", "S_7"), f"SELECT {cell(2)} AS strategy, {cell(3)}::DOUBLE AS trades, {cell(5)}::DOUBLE AS profit, {cell(6)}::DOUBLE / 100 AS win_rate, NULL::DOUBLE AS drawdown FROM ({TEXT}) WHERE {cell(2)} = 'S_7' /*round: trades, profit, win_rate, drawdown*/")
