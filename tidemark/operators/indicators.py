"""Technical indicators over each symbol's bars, as steps of a Series, with their default signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from tidemark.operators.kernels import LONG, SHORT
from tidemark.operators.series import Series


@dataclass(frozen=True)
class Param:
    default: float
    low: float
    high: float

    @property
    def whole(self) -> bool:
        return isinstance(self.default, int)


@dataclass(frozen=True)
class Indicator:
    """``build`` adds the output columns to a series (returns their names); ``entry`` and ``exit`` give conditions on (series, outputs, params)."""

    name: str
    category: str
    params: dict[str, Param]
    outputs: tuple[str, ...]
    build: Callable
    entry: Callable | None = None
    exit: Callable | None = None
    aliases: tuple[str, ...] = field(default=())

    def defaults(self, **given: float) -> dict[str, float]:
        unknown = set(given) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        return {k: p.default for k, p in self.params.items()} | given


REGISTRY: dict[str, Indicator] = {}


def _side(s: Series, a: str, b: str, close: str) -> str:
    """1, 0 or -1 as a is above, at or below b; differences below 1e-9 of the price (of one, for higher prices), which the order of additions makes, are none."""
    gap = f"(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE))"
    return s.put(f"CASE WHEN abs({gap}) <= 1e-9 * least(1.0, abs({close})) THEN 0 WHEN {gap} > 0 THEN 1 WHEN {gap} < 0 THEN -1 END")


def _sides(s: Series, a: str, b: str) -> tuple[str, str]:
    """The side now and on the bar before."""
    return _side(s, a, b, "close"), _side(s, s.lag(a), s.lag(b), s.lag("close"))


def crossed_above(s: Series, a: str, b: str) -> str:
    """a > b now and a <= b on the bar before; false where unknown, so on a symbol's first bar."""
    now, before = _sides(s, a, b)
    return f"coalesce({now} > 0 AND {before} <= 0, false)"


def crossed_below(s: Series, a: str, b: str) -> str:
    now, before = _sides(s, a, b)
    return f"coalesce({now} < 0 AND {before} >= 0, false)"


COMPARISONS = {"lt": "<", "gt": ">", "lte": "<=", "gte": ">="}


def compare(a: str, operator: str, b: str) -> str:
    return f"coalesce({a} {COMPARISONS[operator]} {b}, false)"


def condition(s: Series, left: str, operator: str, right: str, factor: float | None = None) -> str:
    """A condition {left, operator, right (column or constant), factor of the right side}."""
    right = right if factor is None else f"({right} * {factor!r})"
    if operator == "crosses_above":
        return crossed_above(s, left, right)
    if operator == "crosses_below":
        return crossed_below(s, left, right)
    if operator not in COMPARISONS:
        raise ValueError(f"no operator {operator}")
    return compare(left, operator, right)


def indicator(category: str, outputs: str, entry=None, exit=None, **params: tuple) -> Callable:
    def register(build: Callable) -> Callable:
        name = build.__name__.upper().strip("_")
        REGISTRY[name] = Indicator(name, category, {k: Param(*v) for k, v in params.items()}, tuple(outputs.split()), build, entry, exit)
        return build

    return register


def _above(k: int, value: str | float) -> Callable:
    return lambda s, o, p: crossed_above(s, o[k], _value(o, p, value))


def _below(k: int, value: str | float) -> Callable:
    return lambda s, o, p: crossed_below(s, o[k], _value(o, p, value))


def _value(o: list[str], p: dict, value) -> str:
    return o[value] if isinstance(value, int) else number(p, value) if value in p else value


def number(p: dict, name: str) -> str:
    """A parameter as SQL text: of a number its value; a text stands as it is."""
    return p[name] if isinstance(p[name], str) else repr(float(p[name]))


def _is(operator: str, param: str, k: int = 0) -> Callable:
    return lambda s, o, p: compare(o[k], operator, number(p, param))


ZERO = {"entry": _above(0, "0.0"), "exit": _below(0, "0.0")}
PRICE = {"entry": lambda s, o, p: crossed_above(s, "close", o[0]), "exit": lambda s, o, p: crossed_below(s, "close", o[0])}
LOW_HIGH = {"entry": _is("lt", "entry_constant"), "exit": _is("gt", "exit_constant")}
HIGH_LOW = {"entry": _is("gt", "entry_constant"), "exit": _is("lt", "exit_constant")}
PAIR = {"entry": _above(0, 1), "exit": _below(0, 1)}


def _ratio(x: str, y: str, otherwise: str = "0.0") -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN coalesce(({x}) / nullif({y}, 0.0), {otherwise}) END"


# momentum


@indicator("momentum", "rsi", timeperiod=(14, 2, 30), entry_constant=(30, 20, 40), exit_constant=(70, 60, 80), **LOW_HIGH)
def rsi(s: Series, timeperiod: int, **_) -> list[str]:
    gain, loss = _wilder_moves(s, timeperiod)
    return [s.put(_ratio(f"100.0 * {gain}", f"({gain} + {loss})"))]


def _wilder_moves(s: Series, n: int) -> list[str]:
    """Smoothed gains and losses from one close to the next."""
    step = s.put(f"close - {s.lag('close')}")
    return s.emas([s.put(f"CASE WHEN {step} IS NOT NULL THEN greatest({step}, 0.0) END"), s.put(f"CASE WHEN {step} IS NOT NULL THEN greatest(-{step}, 0.0) END")], n, alpha=1.0 / n)


def _macd(s: Series, fast: str, slow: str, signal: Callable) -> list[str]:
    line = s.minus(fast, slow)
    sig = signal(line)
    apart = s.minus(line, sig)
    return [s.put(f"CASE WHEN {sig} IS NOT NULL THEN {line} END"), sig, apart]


@indicator("momentum", "macd macdsignal macdhist", fastperiod=(12, 5, 20), slowperiod=(26, 15, 40), signalperiod=(9, 5, 15), **PAIR)
def macd(s: Series, fastperiod: int, slowperiod: int, signalperiod: int) -> list[str]:
    fast, slow = min(fastperiod, slowperiod), max(fastperiod, slowperiod)
    return _macd(s, *s.emas_of([("close", fast, None, slow), ("close", slow, None, None)]), lambda x: s.ema(x, signalperiod))


@indicator("momentum", "macd macdsignal macdhist", fastperiod=(12, 5, 20), fastmatype=(0, 0, 8), slowperiod=(26, 15, 40), slowmatype=(0, 0, 8), signalperiod=(9, 5, 15), signalmatype=(0, 0, 8), **PAIR)
def macdext(s: Series, fastperiod: int, slowperiod: int, signalperiod: int, fastmatype: int, slowmatype: int, signalmatype: int) -> list[str]:
    return _macd(s, moving_average(s, "close", fastperiod, fastmatype), moving_average(s, "close", slowperiod, slowmatype), lambda x: moving_average(s, x, signalperiod, signalmatype))


@indicator("momentum", "macd macdsignal macdhist", signalperiod=(9, 5, 15), **PAIR)
def macdfix(s: Series, signalperiod: int) -> list[str]:
    return _macd(s, *s.emas_of([("close", 12, 0.15, 26), ("close", 26, 0.075, None)]), lambda x: s.ema(x, signalperiod))


def _position(s: Series, x: str, high: str, low: str, n: int) -> str:
    """Place of x between the lowest low and the highest high of n bars, in percent."""
    top, bottom = s.roll("max", high, n), s.roll("min", low, n)
    return s.put(_ratio(f"100.0 * ({x} - {bottom})", f"({top} - {bottom})"))


@indicator("momentum", "slowk slowd", fastk_period=(14, 5, 21), slowk_period=(3, 1, 5), slowd_period=(3, 1, 5), entry_constant=(20, 10, 30), exit_constant=(80, 70, 90), **LOW_HIGH)
def stoch(s: Series, fastk_period: int, slowk_period: int, slowd_period: int, **_) -> list[str]:
    k = s.sma(_position(s, "close", "high", "low", fastk_period), slowk_period)
    d = s.sma(k, slowd_period)
    return [s.put(f"CASE WHEN {d} IS NOT NULL THEN {k} END"), d]


@indicator("momentum", "fastk fastd", fastk_period=(5, 3, 14), fastd_period=(3, 1, 5), entry_constant=(20, 10, 30), exit_constant=(80, 70, 90), **LOW_HIGH)
def stochf(s: Series, fastk_period: int, fastd_period: int, **_) -> list[str]:
    k = _position(s, "close", "high", "low", fastk_period)
    d = s.sma(k, fastd_period)
    return [s.put(f"CASE WHEN {d} IS NOT NULL THEN {k} END"), d]


@indicator("momentum", "fastk fastd", timeperiod=(14, 5, 21), fastk_period=(5, 3, 10), fastd_period=(3, 1, 5), entry_constant=(20, 10, 30), exit_constant=(80, 70, 90), **LOW_HIGH)
def stochrsi(s: Series, timeperiod: int, fastk_period: int, fastd_period: int, **_) -> list[str]:
    x = rsi(s, timeperiod)[0]
    k = _position(s, x, x, x, fastk_period)
    d = s.sma(k, fastd_period)
    return [s.put(f"CASE WHEN {d} IS NOT NULL THEN {k} END"), d]


@indicator("momentum", "cci", timeperiod=(14, 5, 30), entry_constant=(-100, -200, -50), exit_constant=(100, 50, 200), **LOW_HIGH)
def cci(s: Series, timeperiod: int, **_) -> list[str]:
    typical = s.put("(high + low + close) / 3.0")
    mean = s.sma(typical, timeperiod)
    values = f"({typical}) {s.frame(timeperiod)}"
    values = s.put(f"collect_list{values}", f"list{values}")
    apart = s.put(f"aggregate({values}, 0.0D, (t, x) -> t + abs(x - {mean})) / {timeperiod}", f"list_sum(list_transform({values}, lambda x: abs(x - {mean}))) / {timeperiod}")
    return [s.put(f"CASE WHEN {mean} IS NOT NULL THEN CASE WHEN abs({typical} - {mean}) < 1e-12 OR {apart} < 1e-12 THEN 0.0 ELSE ({typical} - {mean}) / (0.015 * {apart}) END END")]


@indicator("momentum", "mfi", timeperiod=(14, 5, 30), entry_constant=(20, 10, 30), exit_constant=(80, 70, 90), **LOW_HIGH)
def mfi(s: Series, timeperiod: int, **_) -> list[str]:
    typical = s.put("(high + low + close) / 3.0")
    before = s.lag(typical)
    up = s.roll("sum", s.put(f"CASE WHEN {before} IS NOT NULL THEN CASE WHEN {typical} > {before} THEN {typical} * volume ELSE 0.0 END END"), timeperiod)
    down = s.roll("sum", s.put(f"CASE WHEN {before} IS NOT NULL THEN CASE WHEN {typical} < {before} THEN {typical} * volume ELSE 0.0 END END"), timeperiod)
    return [s.put(_ratio(f"100.0 * {up}", f"({up} + {down})"))]


@indicator("momentum", "willr", timeperiod=(14, 5, 30), entry_constant=(-80, -90, -70), exit_constant=(-20, -30, -10), **LOW_HIGH)
def willr(s: Series, timeperiod: int, **_) -> list[str]:
    top, bottom = s.roll("max", "high", timeperiod), s.roll("min", "low", timeperiod)
    return [s.put(_ratio(f"-100.0 * ({top} - close)", f"({top} - {bottom})"))]


@indicator("momentum", "cmo", timeperiod=(14, 5, 30), entry_constant=(-50, -70, -30), exit_constant=(50, 30, 70), **LOW_HIGH)
def cmo(s: Series, timeperiod: int, **_) -> list[str]:
    gain, loss = _wilder_moves(s, timeperiod)
    return [s.put(_ratio(f"100.0 * ({gain} - {loss})", f"({gain} + {loss})"))]


def _true_range(s: Series) -> str:
    before = s.lag("close")
    return s.put(f"CASE WHEN {before} IS NOT NULL THEN greatest(high - low, abs(high - {before}), abs(low - {before})) END")


def _moves(s: Series) -> tuple[str, str]:
    """Directional movement up and down from the bar before."""
    up, down = s.put(f"high - {s.lag('high')}"), s.put(f"{s.lag('low')} - low")
    return tuple(s.put(f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0.0 END END") for a, b in ((up, down), (down, up)))


def _directional(s: Series, n: int) -> tuple[str, str]:
    """+DI and -DI, from bar n on."""
    plus, minus, tr = s.wilder_sums([*_moves(s), _true_range(s)], n)
    ready = f"bar_idx >= {n}"
    return tuple(s.put(f"CASE WHEN {ready} THEN coalesce(100.0 * {x} / nullif({tr}, 0.0), 0.0) END") for x in (plus, minus))


def _dx(s: Series, n: int) -> str:
    plus, minus, tr = s.wilder_sums([*_moves(s), _true_range(s)], n)
    return s.sequential("dx", [plus, minus, tr], 1, n=n)[0]


@indicator("momentum", "adx", timeperiod=(14, 7, 28), entry_constant=(25, 20, 40), exit_constant=(20, 15, 25), **HIGH_LOW)
def adx(s: Series, timeperiod: int, **_) -> list[str]:
    return [s.wilder(_dx(s, timeperiod), timeperiod)]


@indicator("momentum", "adxr", timeperiod=(14, 7, 28), entry_constant=(25, 20, 40), exit_constant=(20, 15, 25), **HIGH_LOW)
def adxr(s: Series, timeperiod: int, **_) -> list[str]:
    x = adx(s, timeperiod)[0]
    return [s.put(f"({x} + lag({x}, {timeperiod - 1}) {s.window()}) / 2.0")]


@indicator("momentum", "dx", timeperiod=(14, 5, 30), entry_constant=(25, 20, 40), exit_constant=(20, 10, 25), **HIGH_LOW)
def dx(s: Series, timeperiod: int, **_) -> list[str]:
    return [_dx(s, timeperiod)]


@indicator("momentum", "plus_di", timeperiod=(14, 5, 30), entry_constant=(25, 15, 40), exit_constant=(20, 10, 30), **HIGH_LOW)
def plus_di(s: Series, timeperiod: int, **_) -> list[str]:
    return [_directional(s, timeperiod)[0]]


@indicator("momentum", "minus_di", timeperiod=(14, 5, 30), entry_constant=(25, 15, 40), exit_constant=(20, 10, 30), entry=_is("lt", "entry_constant"), exit=_is("gt", "exit_constant"))
def minus_di(s: Series, timeperiod: int, **_) -> list[str]:
    return [_directional(s, timeperiod)[1]]


@indicator("momentum", "plus_dm", timeperiod=(14, 5, 30), entry=lambda s, o, p: crossed_above(s, o[0], s.lag(o[0])), exit=lambda s, o, p: crossed_below(s, o[0], s.lag(o[0])))
def plus_dm(s: Series, timeperiod: int) -> list[str]:
    return s.wilder_sums([_moves(s)[0]], timeperiod)


@indicator("momentum", "minus_dm", timeperiod=(14, 5, 30), entry=lambda s, o, p: crossed_below(s, o[0], s.lag(o[0])), exit=lambda s, o, p: crossed_above(s, o[0], s.lag(o[0])))
def minus_dm(s: Series, timeperiod: int) -> list[str]:
    return s.wilder_sums([_moves(s)[1]], timeperiod)


@indicator("momentum", "mom", timeperiod=(10, 5, 30), **ZERO)
def mom(s: Series, timeperiod: int) -> list[str]:
    return [s.put(f"close - lag(close, {timeperiod}) {s.window()}")]


@indicator("momentum", "roc", timeperiod=(10, 5, 30), **ZERO)
def roc(s: Series, timeperiod: int) -> list[str]:
    before = s.lag("close", timeperiod)
    return [s.put(_ratio(f"100.0 * (close - {before})", before))]


@indicator("momentum", "rocp", timeperiod=(10, 5, 30), **ZERO)
def rocp(s: Series, timeperiod: int) -> list[str]:
    before = s.lag("close", timeperiod)
    return [s.put(_ratio(f"(close - {before})", before))]


@indicator("momentum", "rocr", timeperiod=(10, 5, 30), entry_constant=(1.02, 1.0, 1.05), exit_constant=(0.98, 0.95, 1.0), **HIGH_LOW)
def rocr(s: Series, timeperiod: int, **_) -> list[str]:
    return [s.put(_ratio("close", s.lag("close", timeperiod)))]


@indicator("momentum", "rocr100", timeperiod=(10, 5, 30), entry_constant=(102, 100, 105), exit_constant=(98, 95, 100), **HIGH_LOW)
def rocr100(s: Series, timeperiod: int, **_) -> list[str]:
    return [s.put(_ratio("100.0 * close", s.lag("close", timeperiod)))]


@indicator("momentum", "trix", timeperiod=(15, 5, 30), **ZERO)
def trix(s: Series, timeperiod: int) -> list[str]:
    x = _chain(s, "close", timeperiod, 3)[-1]
    before = s.lag(x)
    return [s.put(_ratio(f"100.0 * ({x} - {before})", before))]


@indicator("momentum", "ultosc", timeperiod1=(7, 3, 14), timeperiod2=(14, 7, 28), timeperiod3=(28, 14, 56), entry_constant=(30, 20, 40), exit_constant=(70, 60, 80), **LOW_HIGH)
def ultosc(s: Series, timeperiod1: int, timeperiod2: int, timeperiod3: int, **_) -> list[str]:
    before = s.lag("close")
    buying, tr = s.put(f"CASE WHEN {before} IS NOT NULL THEN close - least(low, {before}) END"), _true_range(s)
    parts = [s.put(_ratio(s.roll("sum", buying, n), s.roll("sum", tr, n))) for n in sorted((timeperiod1, timeperiod2, timeperiod3))]
    return [s.put(f"100.0 * (4.0 * {parts[0]} + 2.0 * {parts[1]} + {parts[2]}) / 7.0")]


def _fast_slow(s: Series, fastperiod: int, slowperiod: int, matype: int = 0) -> tuple[str, str]:
    return moving_average(s, "close", min(fastperiod, slowperiod), matype), moving_average(s, "close", max(fastperiod, slowperiod), matype)


@indicator("momentum", "apo", fastperiod=(12, 5, 20), slowperiod=(26, 15, 40), **ZERO)
def apo(s: Series, fastperiod: int, slowperiod: int) -> list[str]:
    fast, slow = _fast_slow(s, fastperiod, slowperiod)
    return [s.put(f"{fast} - {slow}")]


@indicator("momentum", "ppo", fastperiod=(12, 5, 20), slowperiod=(26, 15, 40), **ZERO)
def ppo(s: Series, fastperiod: int, slowperiod: int) -> list[str]:
    fast, slow = _fast_slow(s, fastperiod, slowperiod)
    return [s.put(_ratio(f"100.0 * ({fast} - {slow})", slow))]


@indicator("momentum", "bop", **ZERO)
def bop(s: Series) -> list[str]:
    return [s.put("CASE WHEN high - low > 0 THEN (close - open) / nullif(high - low, 0.0) ELSE 0.0 END")]


def _aroon(s: Series, n: int) -> tuple[str, str]:
    """Down and up: bars since the last extreme of n + 1 bars; of equal ones the latest."""
    frame, ready = s.frame(n + 1), f"bar_idx >= {n}"
    top = s.put(f"max(struct(high AS x, bar_idx AS i)) {frame}", f"max({{'x': high, 'i': bar_idx}}) {frame}")
    bottom = s.put(f"min(struct(low AS x, -bar_idx AS i)) {frame}", f"min({{'x': low, 'i': -bar_idx}}) {frame}")
    up = s.put(f"CASE WHEN {ready} THEN CAST(100 AS DOUBLE) * ({n} - (bar_idx - {top}.i)) / {n} END")
    return s.put(f"CASE WHEN {ready} THEN CAST(100 AS DOUBLE) * ({n} - (bar_idx + {bottom}.i)) / {n} END"), up


@indicator("momentum", "aroondown aroonup", timeperiod=(14, 5, 30), entry=_above(1, 0), exit=_below(1, 0))
def aroon(s: Series, timeperiod: int) -> list[str]:
    return list(_aroon(s, timeperiod))


@indicator("momentum", "aroonosc", timeperiod=(14, 5, 30), **ZERO)
def aroonosc(s: Series, timeperiod: int) -> list[str]:
    down, up = _aroon(s, timeperiod)
    return [s.put(f"{up} - {down}")]


# overlap


def _chain(s: Series, x: str, n: int, times: int) -> list[str]:
    """Averages of averages, each begun with the first n values of the one before."""
    return s.cascade(x, n, times)


@indicator("overlap", "sma_fast sma_slow", fast_period=(9, 3, 50), slow_period=(21, 10, 200), **PAIR)
def sma(s: Series, fast_period: int, slow_period: int) -> list[str]:
    return [s.sma("close", fast_period), s.sma("close", slow_period)]


@indicator("overlap", "ema_fast ema_slow", fast_period=(9, 3, 50), slow_period=(21, 10, 200), **PAIR)
def ema(s: Series, fast_period: int, slow_period: int) -> list[str]:
    return s.emas_of([("close", fast_period, None, None), ("close", slow_period, None, None)])


def _dema(s: Series, x: str, n: int) -> str:
    a, b = _chain(s, x, n, 2)
    return s.put(f"2.0 * {a} - {b}")


def _tema(s: Series, x: str, n: int) -> str:
    a, b, c = _chain(s, x, n, 3)
    return s.put(f"3.0 * {a} - 3.0 * {b} + {c}")


def _kama(s: Series, x: str, n: int) -> str:
    """An average whose weight follows how straight the last n steps were."""
    k = s.total(f"count({x})")
    path = s.roll("sum", s.put(f"abs({x} - lag({x}) {s.window()})"), n)
    straight = s.put(f"coalesce(abs({x} - lag({x}, {n}) {s.window()}) / nullif({path}, 0.0), 1.0)")
    fast, slow = 2.0 / 3.0, 2.0 / 31.0
    weight = s.put(f"power({straight} * {fast - slow!r} + {slow!r}, 2)")
    y = s.affine(f"CASE WHEN {k} = {n} THEN 0.0 WHEN {k} > {n} THEN 1.0 - {weight} END", f"CASE WHEN {k} = {n} THEN {x} WHEN {k} > {n} THEN {weight} * {x} END")
    return s.put(f"CASE WHEN {k} > {n} THEN {y} END")


def _wma(s: Series, x: str, n: int) -> str:
    # weights 1 to n by place in the frame, so no number grows with the bar's place
    values = s.put(f"collect_list({x}) {s.frame(n)}", f"list({x}) {s.frame(n)}")
    total = s.put(f"aggregate(transform({values}, (v, i) -> v * (i + 1)), 0.0D, (t, v) -> t + v)", f"list_sum(list_transform({values}, lambda v, i: v * i))")
    return s.put(f"CASE WHEN count({x}) {s.frame(n)} = {n} THEN {total} / {n * (n + 1) / 2!r} END")


def _trima(s: Series, x: str, n: int) -> str:
    first, second = ((n + 1) // 2,) * 2 if n % 2 else (n // 2, n // 2 + 1)
    return s.sma(s.sma(x, first), second)


def _t3(s: Series, x: str, n: int, v: float = 0.7) -> str:
    e = _chain(s, x, n, 6)
    c = (-(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2)
    return s.put(" + ".join(f"({w!r}) * {y}" for w, y in zip(c, (e[5], e[4], e[3], e[2]))))


def _cycle(s: Series, x: str = "close") -> list[str]:
    """Smoothed price, in-phase and quadrature parts, and period of the dominant cycle; whatever asks for it, it is found once."""
    return s.sequential("cycle", [x], 4)


def _mama(s: Series, x: str, fast: float = 0.5, slow: float = 0.05) -> list[str]:
    _, i1, q1, _ = _cycle(s, x)
    return s.sequential("adaptive", [x, i1, q1], 2, fast=float(fast), slow=float(slow))


def moving_average(s: Series, x: str, n: int, matype: int = 0) -> str:
    """Kinds 0 to 8 in the usual numbering; 7 (MAMA, with its usual limits) follows the cycle and not n."""
    if n <= 1:
        return x
    kinds = {
        0: s.sma, 1: s.ema, 2: lambda x, n: _wma(s, x, n), 3: lambda x, n: _dema(s, x, n), 4: lambda x, n: _tema(s, x, n), 5: lambda x, n: _trima(s, x, n), 6: lambda x, n: _kama(s, x, n),
        7: lambda x, n: _mama(s, x)[0], 8: lambda x, n: _t3(s, x, n),
    }
    if matype not in kinds:
        raise ValueError(f"no moving average of kind {matype}")
    return kinds[matype](x, n)


@indicator("overlap", "dema", timeperiod=(20, 5, 100), **PRICE)
def dema(s: Series, timeperiod: int) -> list[str]:
    return [_dema(s, "close", timeperiod)]


@indicator("overlap", "tema", timeperiod=(20, 5, 100), **PRICE)
def tema(s: Series, timeperiod: int) -> list[str]:
    return [_tema(s, "close", timeperiod)]


@indicator("overlap", "kama", timeperiod=(10, 5, 30), **PRICE)
def kama(s: Series, timeperiod: int) -> list[str]:
    return [_kama(s, "close", timeperiod)]


@indicator("overlap", "wma", timeperiod=(20, 5, 100), **PRICE)
def wma(s: Series, timeperiod: int) -> list[str]:
    return [_wma(s, "close", timeperiod)]


@indicator("overlap", "trima", timeperiod=(20, 5, 100), **PRICE)
def trima(s: Series, timeperiod: int) -> list[str]:
    return [_trima(s, "close", timeperiod)]


@indicator("overlap", "t3", timeperiod=(5, 3, 25), vfactor=(0.7, 0.0, 1.0), **PRICE)
def t3(s: Series, timeperiod: int, vfactor: float) -> list[str]:
    return [_t3(s, "close", timeperiod, vfactor)]


@indicator("overlap", "ma", timeperiod=(20, 5, 100), matype=(0, 0, 8), **PRICE)
def ma(s: Series, timeperiod: int, matype: int) -> list[str]:
    return [moving_average(s, "close", timeperiod, matype)]


@indicator(
    "overlap", "upperband middleband lowerband", timeperiod=(20, 10, 50), nbdevup=(2.0, 1.0, 3.0), nbdevdn=(2.0, 1.0, 3.0), entry_factor=(1.02, 1.0, 1.05), exit_factor=(0.98, 0.95, 1.0),
    entry=lambda s, o, p: compare("close", "lt", f"{o[2]} * {number(p, 'entry_factor')}"), exit=lambda s, o, p: compare("close", "gt", f"{o[0]} * {number(p, 'exit_factor')}"),
)
def bbands(s: Series, timeperiod: int, nbdevup: float, nbdevdn: float, **_) -> list[str]:
    middle, spread = s.sma("close", timeperiod), s.roll("stddev_pop", "close", timeperiod)
    return [s.put(f"{middle} + {float(nbdevup)!r} * {spread}"), middle, s.put(f"{middle} - {float(nbdevdn)!r} * {spread}")]


@indicator("overlap", "midpoint", timeperiod=(14, 5, 50), **PRICE)
def midpoint(s: Series, timeperiod: int) -> list[str]:
    return [s.put(f"({s.roll('max', 'close', timeperiod)} + {s.roll('min', 'close', timeperiod)}) / 2.0")]


@indicator("overlap", "midprice", timeperiod=(14, 5, 50), **PRICE)
def midprice(s: Series, timeperiod: int) -> list[str]:
    return [s.put(f"({s.roll('max', 'high', timeperiod)} + {s.roll('min', 'low', timeperiod)}) / 2.0")]


# volume


@indicator("volume", "obv obv_sma", sma_period=(20, 5, 50), **PAIR)
def obv(s: Series, sma_period: int) -> list[str]:
    before = s.lag("close")
    x = s.total(f"sum({s.put(f'CASE WHEN {before} IS NULL OR close > {before} THEN volume WHEN close < {before} THEN -volume ELSE 0.0 END')})")
    return [x, s.sma(x, sma_period)]


def _accumulation(s: Series) -> str:
    return s.total(f"sum({s.put('CASE WHEN high > low THEN ((close - low) - (high - close)) / nullif(high - low, 0.0) * volume ELSE 0.0 END')})")


@indicator("volume", "ad ad_sma", sma_period=(20, 5, 50), **PAIR)
def ad(s: Series, sma_period: int) -> list[str]:
    x = _accumulation(s)
    return [x, s.sma(x, sma_period)]


@indicator("volume", "adosc", fastperiod=(3, 2, 10), slowperiod=(10, 5, 20), **ZERO)
def adosc(s: Series, fastperiod: int, slowperiod: int) -> list[str]:
    x = _accumulation(s)
    fast, slow = s.emas_of([(x, 1, 2.0 / (n + 1), None) for n in (fastperiod, slowperiod)])
    return [s.put(f"CASE WHEN bar_idx >= {max(fastperiod, slowperiod) - 1} THEN {fast} - {slow} END")]


# volatility


@indicator(
    "volatility", "atr", timeperiod=(14, 7, 28), stop_loss_multiplier=(2.0, 1.5, 4.0),
    entry=lambda s, o, p: compare(f"(close - {s.lag('close')})", "gt", f"({o[0]} * {number(p, 'stop_loss_multiplier')} * 0.5)"),
    exit=lambda s, o, p: compare(f"(close - {s.lag('close')})", "lt", f"(-{o[0]} * {number(p, 'stop_loss_multiplier')} * 0.5)"),
)
def atr(s: Series, timeperiod: int, **_) -> list[str]:
    return [s.wilder(_true_range(s), timeperiod)]


@indicator(
    "volatility", "natr", timeperiod=(14, 7, 28), entry_constant=(2.0, 1.0, 5.0),
    entry=_is("gt", "entry_constant"), exit=lambda s, o, p: compare(o[0], "lt", f"({number(p, 'entry_constant')} * 0.5)"),
)
def natr(s: Series, timeperiod: int, **_) -> list[str]:
    return [s.put(f"100.0 * {s.wilder(_true_range(s), timeperiod)} / nullif(close, 0.0)")]


@indicator(
    "volatility", "trange trange_avg", entry_multiplier=(1.5, 1.0, 3.0), exit_multiplier=(0.5, 0.3, 1.0),
    entry=lambda s, o, p: compare(o[0], "gt", f"{o[1]} * {number(p, 'entry_multiplier')}"), exit=lambda s, o, p: compare(o[0], "lt", f"{o[1]} * {number(p, 'exit_multiplier')}"),
)
def trange(s: Series, **_) -> list[str]:
    x = _true_range(s)
    return [x, s.sma(x, 14)]


# sequential: a machine goes through a symbol's bars in order


def _ready(s: Series, first: int, *xs: str) -> list[str]:
    """Values from the bar of that place on; the bars before warm up."""
    return [s.put(f"CASE WHEN bar_idx >= {first} THEN {x} END") for x in xs]


def _stop(s: Series, long: tuple, short: tuple, **rest: float) -> str:
    sides = {f"{k}{side}": float(v) for side, own in (("long", long), ("short", short)) for k, v in zip(("init", "step", "max"), own)}
    return s.sequential("stop_and_reverse", ["high", "low"], 1, **sides, **rest)[0]


@indicator("overlap", "sar", **PRICE, acceleration=(0.02, 0.01, 0.05), maximum=(0.2, 0.1, 0.4))
def sar(s: Series, acceleration: float, maximum: float) -> list[str]:
    return [s.put(f"abs({_stop(s, *[(acceleration, acceleration, maximum)] * 2)})")]


@indicator(
    "overlap", "sarext", **PRICE, startvalue=(0.0, 0.0, 0.0), offsetonreverse=(0.0, 0.0, 0.1), accelerationinitlong=(0.02, 0.01, 0.05), accelerationlong=(0.02, 0.01, 0.05),
    accelerationmaxlong=(0.2, 0.1, 0.4), accelerationinitshort=(0.02, 0.01, 0.05), accelerationshort=(0.02, 0.01, 0.05), accelerationmaxshort=(0.2, 0.1, 0.4),
)
def sarext(s: Series, startvalue: float, offsetonreverse: float, **p: float) -> list[str]:
    sides = [[p[f"acceleration{k}{side}"] for k in ("init", "", "max")] for side in ("long", "short")]
    return [_stop(s, *sides, startvalue=float(startvalue), offset=float(offsetonreverse))]


@indicator("overlap", "mama fama", **PAIR, fastlimit=(0.5, 0.1, 0.9), slowlimit=(0.05, 0.01, 0.2))
def mama(s: Series, fastlimit: float, slowlimit: float) -> list[str]:
    return _mama(s, "close", fastlimit, slowlimit)


@indicator("overlap", "ht_trendline", **PRICE)
def ht_trendline(s: Series) -> list[str]:
    return _ready(s, LONG, *s.sequential("trendline", ["close", _cycle(s)[3]], 1))


@indicator("cycle", "ht_dcperiod", **LOW_HIGH, entry_constant=(20, 10, 40), exit_constant=(30, 20, 50))
def ht_dcperiod(s: Series, **_) -> list[str]:
    return _ready(s, SHORT, _cycle(s)[3])


def _phase(s: Series) -> str:
    smooth, _, _, period = _cycle(s)
    return s.sequential("phase", [smooth, period], 1)[0]


@indicator("cycle", "ht_dcphase", **LOW_HIGH, entry_constant=(-45, -90, 0), exit_constant=(45, 0, 90))
def ht_dcphase(s: Series, **_) -> list[str]:
    return _ready(s, LONG, _phase(s))


@indicator("cycle", "inphase quadrature", **PAIR)
def ht_phasor(s: Series) -> list[str]:
    return _ready(s, SHORT, *_cycle(s)[1:3])


@indicator("cycle", "sine leadsine", **PAIR)
def ht_sine(s: Series) -> list[str]:
    angle = _phase(s)
    return _ready(s, LONG, f"sin(radians({angle}))", f"sin(radians({angle} + 45))")


@indicator(
    "cycle", "trendmode", entry=lambda s, o, p: f"coalesce({o[0]} = 1 AND {s.lag(o[0])} = 0, false)", exit=lambda s, o, p: f"coalesce({o[0]} = 0 AND {s.lag(o[0])} = 1, false)",
)
def ht_trendmode(s: Series) -> list[str]:
    smooth, _, _, period = _cycle(s)
    line = s.sequential("trendline", ["close", period], 1)[0]
    return _ready(s, LONG, *s.sequential("trend_mode", [smooth, period, _phase(s), line], 1))


def add(s: Series, name: str, **given: float) -> tuple[list[str], str | None, str | None]:
    """Outputs of an indicator and its entry and exit conditions, added to a series."""
    spec = REGISTRY[name]
    params = spec.defaults(**given)
    outputs = spec.build(s, **params)
    return outputs, spec.entry(s, outputs, params) if spec.entry else None, spec.exit(s, outputs, params) if spec.exit else None
