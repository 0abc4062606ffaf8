"""Queries on model preparation, evaluation and feature-class association."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import association, dataset, labels, mlprep
from tidemark.plans.common import sql_erfc, sql_student
from tidemark.plans.queries_bars import labelled_sql
from tidemark.sources import files
from tidemark.sources.views import sql_view

B, F01, P = sql_view("bars"), sql_view("features01"), sql_view("predictions")
FEATURES = ["QTY_gs_entry", "DISC_gs_entry", "TAX_gs_exit", "STAT_gs_exit"]
ENCODED = f"SELECT *, CASE WHEN tradeable = 'trade' THEN 1 ELSE 0 END AS y FROM ({labelled_sql()})"


def encoded(bars: DataFrame) -> DataFrame:
    return mlprep.encode_target(labels.label_periods(bars))


def confusion(source: str, keys: str = "") -> str:
    """Counts, then metrics by class and weighted, of y_true and predicted."""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    ratio = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"
    c = f"SELECT {keys}count(*) FILTER (y_true = 1 AND predicted = 1) AS tp, count(*) FILTER (y_true <> 1 AND predicted = 1) AS fp, count(*) FILTER (y_true = 1 AND predicted <> 1) AS fn, count(*) FILTER (y_true <> 1 AND predicted <> 1) AS tn FROM ({source}) {group}"
    p = f"SELECT *, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {ratio('tp', 'tp + fp')} AS trade_precision, {ratio('tp', 'tp + fn')} AS trade_recall, tp + fn AS trade_support, {ratio('tn', 'tn + fn')} AS hold_precision, {ratio('tn', 'tn + fp')} AS hold_recall, tn + fp AS hold_support FROM ({c})"
    f = f"SELECT *, {ratio('2 * trade_precision * trade_recall', 'trade_precision + trade_recall')} AS trade_f1, {ratio('2 * hold_precision * hold_recall', 'hold_precision + hold_recall')} AS hold_f1 FROM ({p})"
    weighted = ", ".join(f"{ratio(f'trade_{m} * trade_support + hold_{m} * hold_support', 'trade_support + hold_support')} AS weighted_{m}" for m in ("precision", "recall", "f1"))
    return f"SELECT *, {weighted} FROM ({f})"


METRICS = "accuracy, trade_precision, trade_recall, trade_f1, hold_precision, hold_recall, hold_f1, weighted_precision, weighted_recall, weighted_f1"
DECODED = f"SELECT *, CASE WHEN p_trade > 1 - p_trade AND p_trade >= 0.6 THEN 1 ELSE 0 END AS predicted, greatest(p_trade, 1 - p_trade) AS confidence FROM ({P})"
THRESHOLDS = ", ".join(f"({round(0.3 + 0.05 * k, 2)}::DOUBLE)" for k in range(13))

SIDES = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, CASE WHEN tradeable = 'trade' THEN 1 ELSE 0 END AS y FROM ({F01})" for f in FEATURES)
COUNTS = f"SELECT feature, count(*) AS n, sum(y) AS n1, sum(x) AS sx, sum(x * y) AS sxy FROM ({SIDES}) GROUP BY feature"
CELLS = f"SELECT *, sxy::DOUBLE AS a, (sx - sxy)::DOUBLE AS b, (n1 - sxy)::DOUBLE AS c, (n - sx - n1 + sxy)::DOUBLE AS d, n::DOUBLE AS m FROM ({COUNTS})"
NUMBERS = f"""SELECT feature, n, n1, sx, sxy, pow(a - sx * n1 / m, 2) / (sx * n1 / m) + pow(b - sx * (m - n1) / m, 2) / (sx * (m - n1) / m) AS chi2,
greatest(0, a / m * ln(a * m / nullif((a + b) * (a + c), 0)) + b / m * ln(b * m / nullif((a + b) * (b + d), 0)) + c / m * ln(c * m / nullif((c + d) * (a + c), 0)) + d / m * ln(d * m / nullif((c + d) * (b + d), 0))) AS mi,
(a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)) AS r_pb, (a * d) / nullif(b * c, 0) AS odds_ratio, a / m AS trade_support, b / m AS hold_support, (a * m) / nullif((a + b) * (a + c), 0) AS lift FROM ({CELLS})"""
RULES = f"""WITH r AS (SELECT CASE WHEN tradeable = 'trade' THEN 1 ELSE 0 END AS y, {', '.join(FEATURES)} FROM ({F01})), t AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS n1 FROM r), s AS ({{sets}}),
c AS (SELECT antecedent, n_set::DOUBLE AS ns, n_both::DOUBLE AS nb, n, n1 FROM s, t WHERE n_both >= 0.01 * n)
SELECT antecedent, CAST(nb AS BIGINT) AS n_both, nb / n AS support, nb / ns AS confidence, nb / ns / (n1 / n) AS lift, nb / n - ns / n * (n1 / n) AS leverage, CASE WHEN nb >= ns THEN 1000.0 ELSE (1 - n1 / n) / (1 - nb / ns) END AS conviction FROM c WHERE nb / ns >= {{conf}} AND nb / ns / (n1 / n) >= {{lift}}"""


def rules_sql(confidence: float, lift: float) -> str:
    import itertools

    names = sorted(FEATURES)
    sets = [s for k in (1, 2, 3) for s in itertools.combinations(names, k)]
    parts = " UNION ALL ".join(f"SELECT [{', '.join(repr(c) for c in s)}] AS antecedent, count(*) AS n_set, sum(y) AS n_both FROM r WHERE {' AND '.join(f'{c} = 1' for c in s)}" for s in sets)
    return RULES.format(sets=parts, conf=confidence, lift=lift)


def add_to(register) -> None:
    rows = ("symbol", "bar_ts", "bar_idx")
    register("ml1_encode", "bars", lambda b: encoded(b).select(*rows, "y"), f"SELECT symbol, bar_ts, bar_idx, y FROM ({ENCODED}) /*count: bar_idx, y*/")
    for how, low, other in (("standard", "avg", "stddev_pop"), ("minmax", "min", "max")):
        spread = {"standard": "b", "minmax": "b - a"}[how]
        sql = f"SELECT symbol, bar_ts, (close - a) / CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS close, (volume - va) / CASE WHEN {spread.replace('b', 'vb').replace('a', 'va')} = 0 THEN 1 ELSE {spread.replace('b', 'vb').replace('a', 'va')} END AS volume FROM ({B}), (SELECT {low}(close) AS a, {other}(close) AS b, {low}(volume) AS va, {other}(volume) AS vb FROM ({B})) /*round: close, volume*/"
        register(f"ml2_{how}", "bars", lambda b, how=how: mlprep.scale(b, ["close", "volume"], how).select("symbol", "bar_ts", "close", "volume"), sql)
    register("ml3_shift_target", "bars", lambda b: mlprep.shift_target(encoded(b), 2).select(*rows, "y"), f"SELECT * FROM (SELECT symbol, bar_ts, bar_idx, lead(y, 2) OVER (PARTITION BY symbol ORDER BY bar_ts) AS y FROM ({ENCODED})) WHERE y IS NOT NULL /*count: bar_idx, y*/")
    seq = lambda b, stride: mlprep.sequences(encoded(b), ["close", "volume"], 5 if stride == 1 else 16, stride).select("symbol", "bar_idx", "y", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda s, r: s + r[0] * 2 + r[1]).alias("total"))
    for name, length, stride in (("ml4_sequences", 5, 1), ("ml5_strided_sequences", 16, 4)):
        frame = f"OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)"
        sql = f"SELECT symbol, bar_idx, y, n, total FROM (SELECT symbol, bar_idx, lead(y, {length}) OVER (PARTITION BY symbol ORDER BY bar_ts) AS y, count(*) {frame} AS n, sum(close * 2 + volume) {frame} AS total FROM ({ENCODED})) WHERE n = {length} AND y IS NOT NULL AND bar_idx % {stride} = 0 /*round: total*/ /*count: bar_idx, y, n*/"
        register(name, "bars", lambda b, stride=stride: seq(b, stride), sql)
    register("ml6_class_weights", "bars", lambda b: mlprep.class_weights(encoded(b)), f"SELECT class, n, sum(n) OVER () / (2 * n + 1e-6) AS weight FROM (SELECT y AS class, count(*) AS n FROM ({ENCODED}) GROUP BY y) /*round: weight*/ /*count: class*/")
    register("ml7_powered_weights", "bars", lambda b: mlprep.class_weights(encoded(b), power=0.5), f"SELECT class, n, w / avg(w) OVER () AS weight FROM (SELECT class, n, pow(sum(n) OVER () / (2 * greatest(n, 1)), 0.5) AS w FROM (SELECT y AS class, count(*) AS n FROM ({ENCODED}) GROUP BY y)) /*round: weight*/ /*count: class*/")
    register("ml8_split", "bars", lambda b: mlprep.split(b).select(*rows, "part"), f"SELECT symbol, bar_ts, bar_idx, CASE WHEN bar_idx < n - 2 * floor(n * 0.2) THEN 'train' WHEN bar_idx < n - floor(n * 0.2) THEN 'validation' ELSE 'test' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ({B})) /*count: bar_idx*/")
    register("ml9_decode", "predictions", lambda p: mlprep.decode(p, 0.6), f"SELECT * FROM ({DECODED}) /*round: p_trade, confidence*/ /*count: y_true, predicted*/")
    register("ml10_evaluate", "predictions", lambda p: mlprep.evaluate(mlprep.decode(p, 0.6)), f"SELECT * FROM ({confusion(DECODED)}) /*round: {METRICS}*/")
    swept = confusion(f"SELECT y_true, t AS threshold, CASE WHEN p_trade > 1 - p_trade AND p_trade >= t THEN 1 ELSE 0 END AS predicted FROM ({P}), (VALUES {THRESHOLDS}) v(t)", "threshold, ")
    register("ml11_threshold_sweep", "predictions", mlprep.threshold_sweep, f"SELECT *, row_number() OVER (ORDER BY trade_f1 DESC, threshold) = 1 AS best FROM ({swept}) /*round: threshold, {METRICS}*/")
    fit = f"SELECT *, -pow(trade_precision + 1e-10, 1.0 / 3) * pow(trade_recall + 1e-10, 2.0 / 3) * hold_f1 * least(trade_recall / 0.3, 1.0) AS fitness, -trade_f1 * hold_f1 AS product_fitness FROM ({confusion(DECODED)}) /*round: {METRICS}, fitness, product_fitness*/"
    register("ml12_17_fitness", "predictions", lambda p: mlprep.fitness(mlprep.evaluate(mlprep.decode(p, 0.6))), fit, 5)
    prices = ["open", "high", "low", "close", "volume"]
    eta = " UNION ALL ".join(f"SELECT '{f}' AS feature, least(1.0, coalesce((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / nullif(sum(q) - sum(s) * sum(s) / sum(n), 0), 0.0)) AS eta2 FROM (SELECT y, count({f}) AS n, sum({f}) AS s, sum({f} * {f}) AS q FROM ({ENCODED}) GROUP BY y)" for f in prices)
    register("ml13_eta_squared", "bars", lambda b: mlprep.eta_squared(encoded(b), prices, "y"), f"SELECT * FROM ({eta}) /*round: eta2*/")
    to_y = lambda f: f.withColumn("y", (F.col("tradeable") == "trade").cast("int"))
    phi = f"SELECT feature, coalesce(abs((a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0)), 0.0) AS phi FROM ({CELLS})"
    register("ml13_phi", "features01", lambda f: mlprep.phi(to_y(f), FEATURES, "y"), f"SELECT * FROM ({phi}) /*round: phi*/")
    mask = f"SELECT feature, r, value, scaled_r, tier, value > -100 * scaled_r * tier AS selected FROM (SELECT *, CASE WHEN max(r) OVER () > min(r) OVER () THEN (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) ELSE 0.0 END AS scaled_r, CASE WHEN r < 0.01 THEN -0.9 WHEN r < 0.05 THEN -0.8 WHEN r > 0.8 THEN 0.55 WHEN r > 0.9 THEN 0.65 ELSE 0.5 END AS tier FROM (SELECT feature, phi AS r, -30.0 AS value FROM ({phi}))) /*round: r, value, scaled_r, tier*/"
    register("ml14_feature_mask", "features01", lambda f: mlprep.feature_mask(mlprep.phi(to_y(f), FEATURES, "y").select("feature", F.col("phi").alias("r"), F.lit(-30.0).alias("value"))).select("feature", "r", "value", "scaled_r", "tier", "selected"), mask)
    register("ml15_latest_window", "bars", lambda b: mlprep.latest_window(b, 16, 1).select(*rows, "close"), f"SELECT symbol, bar_ts, bar_idx, close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ({B})) WHERE bar_idx >= n - 17 AND n >= 17 /*round: close*/ /*count: bar_idx*/")
    kinds = "CASE WHEN len(list_filter(s, lambda v: v <> 'hold')) = 0 THEN 'ALL_HOLD' WHEN s[1] = 'entry' AND list_contains(s, 'exit') AND len(list_filter(s, lambda v: v = 'entry')) = 1 THEN 'ENTRY_EXIT' ELSE 'INVALID' END"
    register("ml16_patterns", "bars", lambda b: mlprep.target_patterns(labels.label_periods(b)), f"SELECT {kinds} AS pattern, count(*) AS n FROM (SELECT list(coalesce(signal, 'hold') ORDER BY bar_idx) AS s FROM ({labelled_sql()}) GROUP BY symbol, bar_idx // 4) WHERE len(s) = 4 GROUP BY 1")
    register("prd10_columns_by_suffix", "features01", lambda f: f.select(*dataset.columns_by_suffix(f)).agg(*[F.sum(c).alias(c) for c in dataset.columns_by_suffix(f)]), f"SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in FEATURES)} FROM ({F01})")

    # association
    counts = lambda f: association.feature_counts(f, FEATURES)
    base = ("feature", "n", "n1", "sx", "sxy")
    cast = "/*count: n, n1, sx, sxy*/"
    register("as0_counts", "features01", counts, f"SELECT * FROM ({COUNTS}) {cast}")
    register("as1_chi_square", "features01", lambda f: association.chi_square(counts(f)).select(*base, "chi2"), f"SELECT feature, n, n1, sx, sxy, chi2 FROM ({NUMBERS}) /*round: chi2*/ {cast}")
    register("as2_mutual_information", "features01", lambda f: association.mutual_information(counts(f)).select(*base, "mi"), f"SELECT feature, n, n1, sx, sxy, mi FROM ({NUMBERS}) /*round: mi*/ {cast}", 9)
    register("as3_point_biserial", "features01", lambda f: association.point_biserial(counts(f)).select(*base, "r_pb"), f"SELECT feature, n, n1, sx, sxy, r_pb FROM ({NUMBERS}) /*round: r_pb*/ {cast}")
    register("as3_p_value", "features01", lambda f: association.point_biserial(counts(f)).select("feature", "r_pb", "r_pb_p"), f"SELECT feature, r_pb, {sql_student('r_pb', 'n')} AS r_pb_p FROM ({NUMBERS}) /*round: r_pb, r_pb_p*/")
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"
    chance = lambda x: f"({choose('row_', x)} + {choose('n - row_', f'col_ - ({x})')} - {choose('n', 'col_')})"
    places = "range(CAST(greatest(0, row_ + col_ - n) AS BIGINT), CAST(least(row_, col_) + 1 AS BIGINT))"
    exact = f"SELECT feature, odds_ratio, least(1.0, list_sum(list_transform(list_filter(list_transform({places}, lambda x: {chance('x')}), lambda v: v <= own + 1e-7), lambda v: exp(v)))) AS fisher_p FROM (SELECT *, {chance('a')} AS own FROM (SELECT feature, odds_ratio, a, a + b AS row_, a + c AS col_, a + b + c + d AS n FROM ({NUMBERS}) JOIN (SELECT feature AS f, a, b, c, d FROM ({CELLS})) ON feature = f)) /*round: odds_ratio, fisher_p*/"
    register("as4_fisher", "features01", lambda f: association.fisher(counts(f)).select("feature", "odds_ratio", "fisher_p"), exact)
    register("as4_odds_ratio", "features01", lambda f: association.fisher(counts(f)).select(*base, "odds_ratio"), f"SELECT feature, n, n1, sx, sxy, odds_ratio FROM ({NUMBERS}) /*round: odds_ratio*/ {cast}")
    register("as5_lift", "features01", lambda f: association.lift(counts(f)).select(*base, "trade_support", "hold_support", "lift"), f"SELECT feature, n, n1, sx, sxy, trade_support, hold_support, lift FROM ({NUMBERS}) /*round: trade_support, hold_support, lift*/ {cast}")
    stats = lambda f: association.all_statistics(counts(f))
    whole = f"""SELECT s.feature, n, n1, sx, sxy, chi2, {sql_erfc('sqrt(chi2 / 2)')} AS chi2_p, mi, r_pb, {sql_student('r_pb', 'n')} AS r_pb_p, e.odds_ratio, e.fisher_p, trade_support, hold_support, lift
        FROM ({NUMBERS}) s JOIN ({exact.replace('/*round: odds_ratio, fisher_p*/', '')}) e ON s.feature = e.feature"""
    scaled = lambda c: f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END"
    composite = f"SELECT *, ({scaled('chi2')} + {scaled('mi')} + {scaled('least(greatest(lift, 0), 10)')} + 1 - fisher_p) / 4 AS composite FROM ({whole})"
    register("as6_all_statistics", "features01", stats, f"SELECT * FROM ({composite}) /*round: chi2, chi2_p, mi, r_pb, r_pb_p, odds_ratio, fisher_p, trade_support, hold_support, lift, composite*/ {cast}")
    register("as7_rules", "features01", lambda f: association.rules(f, FEATURES, least_confidence=0.25), f"SELECT * FROM ({rules_sql(0.25, 1.0)}) /*round: support, confidence, lift, leverage, conviction*/")
    ranks = lambda c, by: c.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), "feature")))
    register("as8_ranked_by_lift", "features01", lambda f: ranks(association.ranked(association.lift(counts(f)), "lift"), "lift").select("feature", "lift", "place"), f"SELECT feature, lift, row_number() OVER (ORDER BY lift DESC, feature) AS place FROM ({NUMBERS}) /*round: lift*/ /*count: place*/")
    register("as9_percentile_mask", "features01", lambda f: association.percentile_mask(association.lift(counts(f)), 50.0, "lift"), f"SELECT feature, lift AS score, lift >= quantile_cont(lift, 0.5) OVER () AS selected FROM ({NUMBERS}) /*round: score*/")
    register("as10_top_features", "features01", lambda f: association.ranked(association.chi_square(counts(f)), "chi2").limit(2).select("feature", "chi2"), f"SELECT feature, chi2 FROM ({NUMBERS}) ORDER BY chi2 DESC, feature LIMIT 2 /*round: chi2*/")
    mined = lambda f: association.rules(f, FEATURES, least_confidence=0.25)
    rule_rows = f"SELECT antecedent, row_number() OVER (ORDER BY lift DESC, antecedent) AS place, support, confidence, lift AS rule_lift FROM ({rules_sql(0.25, 1.0)})"
    facts = f"SELECT max(n) AS total_samples, max(n1) AS trade_samples, count(*) AS num_features, count(*) FILTER (chi2_p < 0.05) AS chi2_significant_count, count(*) FILTER (fisher_p < 0.05) AS fisher_significant_count, count(*) FILTER (lift > 1.5) AS high_lift_count, avg(mi) AS mean_mutual_info FROM ({composite})"
    marked = f"SELECT feature, composite, row_number() OVER (ORDER BY feature) - 1 AS idx, row_number() OVER (ORDER BY composite DESC, feature) AS place, composite >= quantile_cont(composite, 0.5) OVER () AS selected, n1 AS trade, n - n1 AS hold FROM ({composite})"

    def told(f: DataFrame) -> DataFrame:
        """A report's JSON, read back: a row for each of its features and rules by place."""
        fields = "summary struct<total_samples: long, trade_samples: long, num_features: long>, statistics_summary struct<chi2_significant_count: long, fisher_significant_count: long, high_lift_count: long, mean_mutual_info: double>, feature_mask array<boolean>, top_features array<struct<feature: string, composite: double>>, association_rules array<struct<antecedent: array<string>, support: double, confidence: double, lift: double>>"
        report = files.report_json(association.association_report(stats(f), mined(f))).select(F.from_json("report", fields).alias("r")).select("r.*")
        rows = report.select("summary.*", "statistics_summary.*", F.posexplode(F.arrays_zip("top_features", "association_rules")).alias("place", "x"))
        return rows.select("total_samples", "trade_samples", "num_features", "chi2_significant_count", "fisher_significant_count", "high_lift_count", "mean_mutual_info", (F.col("place") + 1).cast("long").alias("place"), "x.top_features.feature", "x.top_features.composite", "x.association_rules.antecedent", "x.association_rules.support", "x.association_rules.confidence", F.col("x.association_rules.lift").alias("rule_lift"))

    told_sql = f"SELECT f.*, coalesce(m.place, r.place) AS place, feature, composite, antecedent, support, confidence, rule_lift FROM ({facts}) f, (SELECT * FROM ({marked}) WHERE place <= 30) m FULL JOIN (SELECT * FROM ({rule_rows}) WHERE place <= 50) r ON m.place = r.place"
    register("snk2_association_report", "features01", told, f"SELECT * FROM ({told_sql}) /*round: mean_mutual_info, composite, support, confidence, rule_lift*/ /*count: total_samples, trade_samples*/")

    def exported(f: DataFrame) -> DataFrame:
        e = association.association_export(stats(f), mined(f), top=2)
        rows = e.select(F.posexplode(F.arrays_zip("feature_columns", "feature_mask")).alias("at", "x"), "feature_scores", "top_features", "top_feature_indices", "class_distribution.*")
        return rows.select(F.col("x.feature_columns").alias("feature"), F.element_at("feature_scores", F.col("x.feature_columns")).alias("composite"), F.col("at").cast("long").alias("idx"), F.col("x.feature_mask").alias("selected"), "trade", "hold", F.array_contains("top_features", F.col("x.feature_columns")).alias("in_top"), F.array_contains("top_feature_indices", F.col("at")).alias("at_top"))

    register("snk3_association_export", "features01", exported, f"SELECT feature, composite, idx, selected, trade, hold, place <= 2 AS in_top, place <= 2 AS at_top FROM ({marked}) /*round: composite*/ /*count: idx, trade, hold*/")
    register("as11_complete", "features01", lambda f: association.best_combinations(association.rules(f, FEATURES, least_confidence=0.25)).select("antecedent", "place", "lift"), f"SELECT antecedent, row_number() OVER (ORDER BY lift DESC, antecedent) AS place, lift FROM ({rules_sql(0.25, 1.0)}) QUALIFY row_number() OVER (ORDER BY lift DESC, antecedent) <= 20 /*round: lift*/ /*count: place*/")
    register("as12_overview", "features01", lambda f: association.overview(association.lift(association.mutual_information(association.chi_square(counts(f))))).select("lift_above_1", "lift_above_1_2", "lift_above_1_5", "lift_above_2", "lift_above_3", "mean_mi"), f"SELECT count(*) FILTER (lift > 1) AS lift_above_1, count(*) FILTER (lift > 1.2) AS lift_above_1_2, count(*) FILTER (lift > 1.5) AS lift_above_1_5, count(*) FILTER (lift > 2) AS lift_above_2, count(*) FILTER (lift > 3) AS lift_above_3, avg(mi) AS mean_mi FROM ({NUMBERS}) /*round: mean_mi*/", 9)
    register("as13_co_occurrence", "features01", lambda f: association.co_occurrence(association.rules(f, FEATURES, least_confidence=0.2, least_lift=0.5)), f"WITH q AS (SELECT lift, antecedent FROM ({rules_sql(0.2, 0.5)}) WHERE len(antecedent) >= 2) SELECT a, b, count(*) AS n_rules, avg(lift) AS mean_lift FROM (SELECT lift, a, unnest(antecedent) AS b FROM (SELECT lift, antecedent, unnest(antecedent) AS a FROM q)) WHERE a < b GROUP BY a, b /*round: mean_lift*/")
    wide = lambda f: association.by_indicator(association.lift(counts(f)).withColumn("composite", F.col("lift")))
    register("as14_by_indicator", "features01", wide, f"SELECT indicator, coalesce(e, 0.0) AS entry, coalesce(x, 0.0) AS exit, coalesce(e, 0.0) + coalesce(x, 0.0) AS combined, coalesce(e, 0.0) > coalesce(x, 0.0) AS entry_dominant FROM (SELECT regexp_replace(feature, '_(gs|ho)_(entry|exit)$', '') AS indicator, max(lift) FILTER (ends_with(feature, '_entry')) AS e, max(lift) FILTER (ends_with(feature, '_exit')) AS x FROM ({NUMBERS}) GROUP BY 1) /*round: entry, exit, combined*/")
