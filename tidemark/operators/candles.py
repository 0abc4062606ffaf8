"""Candlestick patterns as expressions over a bar and the two before it: 100 bullish, -100 bearish, 0 none.

A body is long above, and short below half of, the mean of the last ten bodies; a doji's body is a tenth of its range at most. A trend is the
close's side of the ten-bar mean, on the bar before the pattern.
"""

from __future__ import annotations

from tidemark.operators.series import Series

# pattern: (condition for 100, condition for -100); {} are columns of the bars. Without a side the pattern has none.
PATTERNS: dict[str, tuple[str | None, str | None]] = {
    "engulfing": ("{c1} < {o1} AND {c} > {o} AND {o} <= {c1} AND {c} >= {o1}", "{c1} > {o1} AND {c} < {o} AND {o} >= {c1} AND {c} <= {o1}"),
    "hammer": ("{fall} AND {body} > 0 AND {lower} >= 2 * {body} AND {upper} <= 0.1 * {range}", None),
    "inverted_hammer": ("{fall} AND {body} > 0 AND {upper} >= 2 * {body} AND {lower} <= 0.1 * {range}", None),
    "hanging_man": (None, "{rise} AND {body} > 0 AND {lower} >= 2 * {body} AND {upper} <= 0.1 * {range}"),
    "shooting_star": (None, "{rise} AND {body} > 0 AND {upper} >= 2 * {body} AND {lower} <= 0.1 * {range}"),
    "morning_star": ("{c2} < {o2} AND {long2} AND {short1} AND greatest({o1}, {c1}) < {c2} AND {c} > {o} AND {c} > ({o2} + {c2}) / 2", None),
    "morning_doji_star": ("{c2} < {o2} AND {long2} AND {doji1} AND greatest({o1}, {c1}) < {c2} AND {c} > {o} AND {c} > ({o2} + {c2}) / 2", None),
    "evening_star": (None, "{c2} > {o2} AND {long2} AND {short1} AND least({o1}, {c1}) > {c2} AND {c} < {o} AND {c} < ({o2} + {c2}) / 2"),
    "evening_doji_star": (None, "{c2} > {o2} AND {long2} AND {doji1} AND least({o1}, {c1}) > {c2} AND {c} < {o} AND {c} < ({o2} + {c2}) / 2"),
    "three_white_soldiers": ("{c2} > {o2} AND {c1} > {o1} AND {c} > {o} AND {c} > {c1} AND {c1} > {c2} AND {o1} BETWEEN {o2} AND {c2} AND {o} BETWEEN {o1} AND {c1}", None),
    "three_black_crows": (None, "{c2} < {o2} AND {c1} < {o1} AND {c} < {o} AND {c} < {c1} AND {c1} < {c2} AND {o1} BETWEEN {c2} AND {o2} AND {o} BETWEEN {c1} AND {o1}"),
    "dark_cloud_cover": (None, "{c1} > {o1} AND {long1} AND {c} < {o} AND {o} > {h1} AND {c} > {o1} AND {c} < ({o1} + {c1}) / 2"),
    "piercing": ("{c1} < {o1} AND {long1} AND {c} > {o} AND {o} < {l1} AND {c} < {o1} AND {c} > ({o1} + {c1}) / 2", None),
    "doji": ("{doji}", None),
    "dragonfly_doji": ("{doji} AND {range} > 0 AND {upper} <= 0.1 * {range} AND {lower} > 0.5 * {range}", None),
    "gravestone_doji": (None, "{doji} AND {range} > 0 AND {lower} <= 0.1 * {range} AND {upper} > 0.5 * {range}"),
    "harami": ("{c1} < {o1} AND {long1} AND {o} > {c1} AND {c} < {o1} AND {c} > {o}", "{c1} > {o1} AND {long1} AND {o} < {c1} AND {c} > {o1} AND {c} < {o}"),
    "three_inside": ("{c2} < {o2} AND {long2} AND {o1} > {c2} AND {c1} < {o2} AND {c1} > {o1} AND {c} > {o} AND {c} > {o2}", "{c2} > {o2} AND {long2} AND {o1} < {c2} AND {c1} > {o2} AND {c1} < {o1} AND {c} < {o} AND {c} < {o2}"),
    "three_outside": ("{c2} < {o2} AND {c1} > {o1} AND {o1} <= {c2} AND {c1} >= {o2} AND {c} > {o} AND {c} > {c1}", "{c2} > {o2} AND {c1} < {o1} AND {o1} >= {c2} AND {c1} <= {o2} AND {c} < {o} AND {c} < {c1}"),
}


def add_patterns(s: Series, names: list[str] | None = None) -> dict[str, str]:
    """Adds the patterns (or the named ones) to a series; returns the column of each."""
    body = s.put("abs(close - open)")
    mean, trend = s.sma(body, 10), s.sma("close", 10)
    # a row's measures, and those of one and two bars before
    own = {"o": "open", "c": "close", "h": "high", "l": "low"}
    flags = {"long": f"{body} > {mean}", "short": f"{body} < 0.5 * {mean}", "doji": f"{body} <= 0.1 * (high - low)", "above": f"close > {trend}", "under": f"close < {trend}"}
    measured = {k: s.put(f"coalesce({v}, false)") for k, v in flags.items()}
    columns = own | {"body": body, "range": "(high - low)", "upper": "(high - greatest(open, close))", "lower": "(least(open, close) - low)", "doji": measured["doji"]}
    for k in (1, 2):
        columns |= {f"{n}{k}": s.lag(c, k) for n, c in (own | {m: measured[m] for m in ("long", "short", "doji")}).items()}
    columns |= {"rise": s.lag(measured["above"]), "fall": s.lag(measured["under"])}
    out = {}
    for name in names or PATTERNS:
        cases = [f"WHEN coalesce({c.format(**columns)}, false) THEN {v}" for c, v in zip(PATTERNS[name], (100, -100)) if c]
        out[name] = s.put(f"CASE {' '.join(cases)} ELSE 0 END")
    return out
