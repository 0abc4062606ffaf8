"""The sequential jobs as recursive SQL, for the check by another engine: written from the definitions, and apart from ``operators.kernels``."""

from __future__ import annotations


def _numbered(s, *xs: str) -> tuple[str, list[str]]:
    """The number (from 0) of each bar that has all values, null for others; and the values."""
    some = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    k = s.put(f"CASE WHEN {some} THEN sum(CASE WHEN {some} THEN 1 ELSE 0 END) {s.window('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} - 1 END")
    return k, [s.put(f"CAST({x} AS DOUBLE)") for x in xs]


def _past(s, x: str, k: str, n: int) -> str:
    """x of the n-th bar before among the numbered ones (a prefix of the bars may have none)."""
    return s.put(f"CASE WHEN {k} >= {n} THEN lag({x}, {n}) {s.window()} END")


def cycle(s, x: str) -> list[str]:
    k, (x,) = _numbered(s, x)
    smooth = s.put(f"CASE WHEN {k} >= 3 THEN (4 * {x} + 3 * {_past(s, x, k, 1)} + 2 * {_past(s, x, k, 2)} + {_past(s, x, k, 3)}) / 10 ELSE {x} END")
    back = [_past(s, smooth, k, n) for n in (2, 4, 6)]
    i1, q1, period = s.name(), s.name(), s.name()
    keys, place = ", ".join("s." + c for c in s.keys), s.put(k)
    arm = lambda a, b, c, d: f"(0.0962::DOUBLE * {a} + 0.5769::DOUBLE * {b} - 0.5769::DOUBLE * {c} - 0.0962::DOUBLE * {d})"
    columns = [i1, q1, period, "raw", "i2", "q2", "re", "im", "ds", "qs"]

    def body(v: str, r: str, on: str) -> str:
        zeros = "list_transform(range(0, 9), lambda z: 0.0::DOUBLE)"
        first = f"SELECT {', '.join(s.keys)}, {place}, {', '.join(['0.0::DOUBLE'] * 8)}, {zeros}, {zeros} FROM {v} WHERE {place} = 0"
        own = ", ".join(s.keys)
        bars = f"SELECT {keys}, s.{place}, s.{smooth} AS x0, s.{back[0]} AS x2, s.{back[1]} AS x4, s.{back[2]} AS x6, r.raw, r.{period} AS sp, r.i2, r.q2, r.re, r.im, r.ds, r.qs, 0.075::DOUBLE * r.raw + 0.54::DOUBLE AS f FROM {r} r JOIN {v} s ON {on} AND s.{place} = r.{place} + 1"
        one = f"SELECT *, CASE WHEN {place} < 6 THEN 0.0 ELSE {arm('x0', 'x2', 'x4', 'x6')} * f END AS d FROM ({bars})"
        two = f"SELECT *, CASE WHEN {place} < 6 THEN 0.0 ELSE {arm('d', 'ds[2]', 'ds[4]', 'ds[6]')} * f END AS q, CASE WHEN {place} < 6 THEN 0.0 ELSE ds[3] END AS i FROM ({one})"
        three = f"SELECT *, {arm('i', 'ds[5]', 'ds[7]', 'ds[9]')} * f AS ji, {arm('q', 'qs[2]', 'qs[4]', 'qs[6]')} * f AS jq FROM ({two})"
        four = f"SELECT *, 0.2::DOUBLE * (i - jq) + 0.8::DOUBLE * i2 AS i2n, 0.2::DOUBLE * (q + ji) + 0.8::DOUBLE * q2 AS q2n FROM ({three})"
        five = f"SELECT *, 0.2::DOUBLE * (i2n * i2 + q2n * q2) + 0.8::DOUBLE * re AS ren, 0.2::DOUBLE * (i2n * q2 - q2n * i2) + 0.8::DOUBLE * im AS imn FROM ({four})"
        six = f"SELECT *, CASE WHEN ren <> 0 AND imn <> 0 THEN coalesce(360 / nullif(degrees(atan(imn / ren)), 0), raw) ELSE raw END AS p FROM ({five})"
        seven = f"SELECT *, CASE WHEN raw <> 0 THEN least(greatest(p, 0.67::DOUBLE * raw), 1.5::DOUBLE * raw) ELSE p END AS p2 FROM ({six})"
        eight = f"SELECT *, CASE WHEN {place} < 6 THEN 0.0 ELSE 0.2::DOUBLE * least(greatest(p2, 6.0::DOUBLE), 50.0::DOUBLE) + 0.8::DOUBLE * raw END AS rawn FROM ({seven})"
        late = lambda new: f"CASE WHEN {place} < 6 THEN 0.0::DOUBLE ELSE {new} END"
        after = f"SELECT {own}, {place}, i, q, {late('0.33::DOUBLE * rawn + 0.67::DOUBLE * sp')}, rawn, {late('i2n')}, {late('q2n')}, {late('ren')}, {late('imn')}, list_prepend(d, ds[1:8]), list_prepend(q, qs[1:8]) FROM ({eight})"
        return f"{first} UNION ALL {after}"

    s.recursive(columns, body, place)
    return [smooth, i1, q1, period]


def phase(s, smooth: str, period: str) -> list[str]:
    k, (smooth, period) = _numbered(s, smooth, period)
    last = s.put(f"list_reverse(list({smooth}) {s.frame(64)})")
    span = s.put(f"CAST(floor({period} + 0.5) AS INT)")
    wave = lambda f: s.put(f"coalesce(list_sum(list_transform(range(0, {span}), lambda z: {f}(2 * pi() * z / {span}) * coalesce({last}[z + 1], 0.0))), 0.0)")
    re, im = wave("sin"), wave("cos")
    angle = s.put(f"CASE WHEN abs({im}) > 0.001 THEN degrees(atan({re} / {im})) WHEN {re} = 0 THEN 0.0 WHEN {re} > 0 THEN 90.0 ELSE -90.0 END + 90.0 + coalesce(360.0 / nullif({period}, 0.0), 0.0) + CASE WHEN {im} < 0 THEN 180.0 ELSE 0.0 END")
    return [s.put(f"CASE WHEN {k} < 6 THEN 0.0 WHEN {angle} > 315.0 THEN {angle} - 360.0 ELSE {angle} END")]


def trendline(s, x: str, period: str) -> list[str]:
    k, (x, period) = _numbered(s, x, period)
    last = s.put(f"list_reverse(list({x}) {s.frame(64)})")
    span = s.put(f"CAST(floor({period} + 0.5) AS INT)")
    mean = s.put(f"CASE WHEN {k} >= 6 AND {span} > 0 THEN list_avg({last}[1:{span}]) ELSE {x} END")
    return [s.put(f"CASE WHEN {k} >= 3 THEN (4 * {mean} + 3 * {_past(s, mean, k, 1)} + 2 * {_past(s, mean, k, 2)} + {_past(s, mean, k, 3)}) / 10 ELSE {mean} END")]


def trend_mode(s, smooth: str, period: str, angle: str, line: str) -> list[str]:
    k, (smooth, period, angle, line) = _numbered(s, smooth, period, angle, line)
    leads = s.put(f"sin(radians({angle})) > sin(radians({angle} + 45))")
    crossed = s.put(f"{k} > 0 AND {leads} <> lag({leads}) {s.window()}")
    since = s.put(f"{k} - coalesce(max(CASE WHEN {crossed} THEN {k} END) {s.window('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} - 1, 0)")
    turn = s.put(f"{angle} - lag({angle}) {s.window()}")
    ordinary = f"{period} <> 0 AND {turn} > 0.67 * 360 / nullif({period}, 0) AND {turn} < 1.5 * 360 / nullif({period}, 0)"
    return [s.put(f"CASE WHEN {k} = 0 THEN 0.0 WHEN {line} <> 0 AND abs(({smooth} - {line}) / nullif({line}, 0)) >= 0.015 THEN 1.0 WHEN {crossed} OR {since} < 0.5 * {period} OR ({ordinary}) THEN 0.0 ELSE 1.0 END")]


def adaptive(s, x: str, i1: str, q1: str, fast: float, slow: float) -> list[str]:
    k, (x, i1, q1) = _numbered(s, x, i1, q1)
    angle = s.put(f"CASE WHEN {k} >= 1 THEN coalesce(degrees(atan({q1} / nullif({i1}, 0))), 0.0) ELSE 0.0 END")
    weight = s.put(f"greatest({fast!r}::DOUBLE / greatest(lag({angle}) {s.window()} - {angle}, 1.0), {slow!r}::DOUBLE)")
    mama = s.affine(f"CASE WHEN {k} = 0 THEN 0.0 ELSE 1 - {weight} END", f"CASE WHEN {k} = 0 THEN {x} ELSE {weight} * {x} END")
    fama = s.affine(f"CASE WHEN {k} = 0 THEN 0.0 ELSE 1 - 0.5 * {weight} END", f"CASE WHEN {k} = 0 THEN {x} ELSE 0.5 * {weight} * {mama} END")
    return [s.put(f"CASE WHEN {k} >= 32 THEN {y} END") for y in (mama, fama)]


def stop_and_reverse(s, high: str, low: str, initlong: float, steplong: float, maxlong: float, initshort: float, stepshort: float, maxshort: float, startvalue: float = 0.0, offset: float = 0.0) -> list[str]:
    """State after a bar: side (1 or -1), the stop for the next bar, the extreme and the factor; all in prices times the side, so that both sides are one rule."""
    k, (high, low) = _numbered(s, high, low)
    place, out = s.put(k), s.name()
    old = {c: _past(s, c, k, 1) for c in (high, low)}
    keys, own = ", ".join("s." + c for c in s.keys), ", ".join(s.keys)
    pick = lambda long, short: f"CASE WHEN side = 1 THEN {long!r}::DOUBLE ELSE {short!r}::DOUBLE END"

    def body(v: str, r: str, on: str) -> str:
        first = f"SELECT {own}, {place}, NULL::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {v} WHERE {place} = 0"
        bars = f"SELECT {keys}, s.{place}, s.{high} AS h, s.{low} AS l, s.{old[high]} AS oh, s.{old[low]} AS ol, r.side AS was, r.stop AS was_stop, r.extreme AS was_extreme, r.factor AS was_factor FROM {r} r JOIN {v} s ON {on} AND s.{place} = r.{place} + 1"
        begin = f"CASE WHEN {startvalue!r} > 0 THEN 1 WHEN {startvalue!r} < 0 THEN -1 WHEN ol - l > 0 AND ol - l > h - oh THEN -1 ELSE 1 END"
        one = f"SELECT *, CASE WHEN was = 0 THEN {begin} ELSE was END AS side FROM ({bars})"
        # near: the price that moves towards the stop; far: the one that makes new extremes
        two = f"SELECT *, CASE WHEN side = 1 THEN l ELSE -h END AS near, CASE WHEN side = 1 THEN h ELSE -l END AS far, CASE WHEN side = 1 THEN ol ELSE -oh END AS old_near, CASE WHEN side = 1 THEN oh ELSE -ol END AS old_far FROM ({one})"
        given = "old_near" if not startvalue else f"side * {abs(startvalue)!r}::DOUBLE"
        three = f"SELECT *, CASE WHEN was = 0 THEN {given} ELSE was_stop END AS st, CASE WHEN was = 0 THEN far ELSE was_extreme END AS ex, CASE WHEN was = 0 THEN {pick(initlong, initshort)} ELSE was_factor END AS fa FROM ({two})"
        four = f"SELECT *, near <= st AS turned, greatest(ex, old_far, far) AS edge FROM ({three})"
        # after a turn everything has the other sign
        five = f"""SELECT *, CASE WHEN turned THEN -edge - abs(edge) * {offset!r} * 1.0 ELSE st END AS st2, CASE WHEN turned THEN -near WHEN far > ex THEN far ELSE ex END AS ex2,
            CASE WHEN turned THEN {pick(initshort, initlong)} WHEN far > ex THEN least(fa + {pick(steplong, stepshort)}, {pick(maxlong, maxshort)}) ELSE fa END AS fa2,
            CASE WHEN turned THEN -side ELSE side END AS side2, CASE WHEN turned THEN -far ELSE near END AS near2, CASE WHEN turned THEN -old_far ELSE old_near END AS old2 FROM ({four})"""
        after = f"SELECT {own}, {place}, st2, side2, least(st2 + fa2 * (ex2 - st2), old2, near2), ex2, fa2 FROM ({five})"
        return f"{first} UNION ALL {after}"

    s.recursive([out, "side", "stop", "extreme", "factor"], body, place)
    return [out]


def dx(s, plus: str, minus: str, tr: str, n: int) -> list[str]:
    plus, minus = (s.put(f"CASE WHEN bar_idx >= {n} THEN coalesce(100.0 * {x} / nullif({tr}, 0.0), 0.0) END") for x in (plus, minus))
    raw = s.put(f"100.0 * abs({plus} - {minus}) / nullif({plus} + {minus}, 0.0)")
    latest = s.running(f"last_value({raw} IGNORE NULLS)")
    return [s.put(f"CASE WHEN {plus} IS NOT NULL THEN coalesce({latest}, 0.0) END")]


RECURSIONS = {"dx": dx, "cycle": cycle, "phase": phase, "trendline": trendline, "trend_mode": trend_mode, "adaptive": adaptive, "stop_and_reverse": stop_and_reverse}
