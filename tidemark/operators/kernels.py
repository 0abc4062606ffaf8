"""Machines for jobs whose next value depends on the ones before in ways that no recurrence of ``passes`` expresses.

Each goes through a symbol's bars one by one, keeps a fixed state (the longest is a ring of the last 64 values) and begins anew with the next symbol. Nulls are
passed over. Batches may end anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tidemark.operators.passes import Places

#: First bars without a value: the Hilbert transform's warm-up, and that of what is smoothed from it.
SHORT, LONG = 32, 63
#: Places of a ring of past values; the longest cycle has 50 bars.
_RING = 64


class Machine:
    """``start`` sets the state for a symbol, ``step`` takes a bar's values and gives its outputs."""

    outputs = 1

    def start(self) -> None:
        raise NotImplementedError

    def step(self, *values: float) -> tuple[float, ...]:
        raise NotImplementedError

    def __init__(self) -> None:
        self.start()

    def __call__(self, places: Places, *inputs: np.ndarray) -> list[np.ndarray]:
        out = np.full((len(places.new), self.outputs), np.nan)
        some = ~np.isnan(np.stack(inputs)).any(axis=0)
        rows = np.flatnonzero(some | places.new)
        for t, new, good, *values in zip(rows.tolist(), places.new[rows].tolist(), some[rows].tolist(), *(x[rows].tolist() for x in inputs)):
            if new:
                self.start()
            if good:
                out[t] = self.step(*values)
        return list(out.T)


class StopAndReverse(Machine):
    """Wilder's stop of (high, low) from the second bar on, negative while short. Factors: initial, step, most. startvalue: 0 (direction from the second bar's movement) or a first stop."""

    def __init__(self, initlong: float, steplong: float, maxlong: float, initshort: float, stepshort: float, maxshort: float, startvalue: float = 0.0, offset: float = 0.0) -> None:
        self.sides = {True: (initlong, steplong, maxlong), False: (initshort, stepshort, maxshort)}
        self.first, self.offset = startvalue, offset
        self.start()

    def start(self) -> None:
        self.before, self.stop = None, None

    def step(self, high: float, low: float) -> tuple[float, ...]:
        if self.before is None:
            self.before = high, low
            return (math.nan,)
        old_high, old_low = self.before
        if self.stop is None:
            down = old_low - low
            self.long = self.first > 0 if self.first else not (down > 0 and down > high - old_high)
            self.stop = abs(self.first) or (old_low if self.long else old_high)
            self.extreme, self.factor = high if self.long else low, self.sides[self.long][0]
        if (low <= self.stop) if self.long else (high >= self.stop):
            # touched: turn, with the old extreme as the stop, beyond the last two bars
            self.long = not self.long
            edge = max(self.extreme, old_high, high) if not self.long else min(self.extreme, old_low, low)
            self.stop = edge + (-1 if self.long else 1) * abs(edge) * self.offset
            self.extreme, self.factor = high if self.long else low, self.sides[self.long][0]
            out = self.stop if self.long else -self.stop
        else:
            out = self.stop if self.long else -self.stop
            if (high > self.extreme) if self.long else (low < self.extreme):
                _, step, most = self.sides[self.long]
                self.extreme, self.factor = high if self.long else low, min(self.factor + step, most)
        self.stop += self.factor * (self.extreme - self.stop)
        self.stop = min(self.stop, old_low, low) if self.long else max(self.stop, old_high, high)
        self.before = high, low
        return (out,)


class Cycle(Machine):
    """Ehlers' homodyne discriminator: smoothed price, in-phase and quadrature parts, and the smoothed period."""

    outputs = 4

    def start(self) -> None:
        self.t = -1
        self.close, self.smooth, self.detrender, self.q1, self.i1 = ([0.0] * 8 for _ in range(5))
        self.i2 = self.q2 = self.re = self.im = self.period = self.smooth_period = 0.0

    def _hilbert(self, ring: list[float], scale: float) -> float:
        t = self.t
        return (0.0962 * ring[t & 7] + 0.5769 * ring[t - 2 & 7] - 0.5769 * ring[t - 4 & 7] - 0.0962 * ring[t - 6 & 7]) * scale

    def step(self, close: float) -> tuple[float, ...]:
        self.t = t = self.t + 1
        now, c = t & 7, self.close
        c[now] = close
        self.smooth[now] = smooth = (4 * close + 3 * c[t - 1 & 7] + 2 * c[t - 2 & 7] + c[t - 3 & 7]) / 10 if t >= 3 else close
        if t < 6:
            return smooth, 0.0, 0.0, 0.0
        before = self.period
        scale = 0.075 * before + 0.54
        self.detrender[now] = self._hilbert(self.smooth, scale)
        self.q1[now], self.i1[now] = self._hilbert(self.detrender, scale), self.detrender[t - 3 & 7]
        ji, jq = self._hilbert(self.i1, scale), self._hilbert(self.q1, scale)
        i2, q2 = 0.2 * (self.i1[now] - jq) + 0.8 * self.i2, 0.2 * (self.q1[now] + ji) + 0.8 * self.q2
        self.re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        self.im = 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2, period = i2, q2, before
        if self.im and self.re and (angle := math.degrees(math.atan(self.im / self.re))):
            period = 360 / angle
        period = min(max(period, 0.67 * before), 1.5 * before) if before else period
        self.period = period = 0.2 * min(max(period, 6.0), 50.0) + 0.8 * before
        self.smooth_period = 0.33 * period + 0.67 * self.smooth_period
        return smooth, self.i1[now], self.q1[now], self.smooth_period


class _Ring:
    """The last values, the latest first."""

    def __init__(self) -> None:
        self.twice, self.at, self.count = np.zeros(2 * _RING), _RING, 0

    def add(self, value: float) -> None:
        self.at = (self.at - 1) % _RING
        self.twice[self.at] = self.twice[self.at + _RING] = value
        self.count += 1

    def last(self, n: int) -> np.ndarray:
        return self.twice[self.at : self.at + n]


class Phase(Machine):
    """The dominant cycle's phase in degrees, of (smoothed price, period)."""

    turns = [np.array([np.sin(x), np.cos(x)]) for x in (2 * math.pi * np.arange(n) / max(n, 1) for n in range(_RING))]

    def start(self) -> None:
        self.ring = _Ring()

    def step(self, smooth: float, period: float) -> tuple[float, ...]:
        self.ring.add(smooth)
        if self.ring.count <= 6:
            return (0.0,)
        span = int(period + 0.5)
        re, im = (self.turns[span] * self.ring.last(span)).sum(axis=1).tolist()
        angle = math.degrees(math.atan(re / im)) if abs(im) > 0.001 else math.copysign(90.0, re) if re else 0.0
        angle += 90.0 + (360.0 / period if period else 0.0) + (180.0 if im < 0 else 0.0)
        return (angle - 360.0 if angle > 315.0 else angle,)


class Trendline(Machine):
    """The mean of (price, period) over a dominant cycle, smoothed over four bars."""

    def start(self) -> None:
        self.ring, self.means = _Ring(), []

    def step(self, close: float, period: float) -> tuple[float, ...]:
        self.ring.add(close)
        span = min(int(period + 0.5), self.ring.count)
        self.means = [*self.means[-3:], float(self.ring.last(span).mean()) if span and self.ring.count > 6 else close]
        m = self.means
        return ((4 * m[3] + 3 * m[2] + 2 * m[1] + m[0]) / 10 if len(m) == 4 else m[-1],)


class TrendMode(Machine):
    """1 in a trend, 0 in a cycle, of (smoothed price, period, phase, trendline)."""

    def start(self) -> None:
        self.before, self.days = None, 0

    def step(self, smooth: float, period: float, angle: float, line: float) -> tuple[float, ...]:
        leads = math.sin(math.radians(angle)) > math.sin(math.radians(angle + 45))
        before, self.before = self.before, (leads, angle)
        if before is None:
            return (0.0,)
        trend = 1.0
        if leads != before[0]:
            self.days, trend = 0, 0.0
        self.days += 1
        if self.days < 0.5 * period or period and 0.67 * 360 / period < angle - before[1] < 1.5 * 360 / period:
            trend = 0.0
        return (1.0 if line and abs((smooth - line) / line) >= 0.015 else trend,)


class Adaptive(Machine):
    """MAMA and FAMA of (price, in-phase, quadrature): averages whose weight follows how fast the phase turns."""

    outputs = 2

    def __init__(self, fast: float, slow: float) -> None:
        self.fast, self.slow = fast, slow
        self.start()

    def start(self) -> None:
        self.mama, self.fama, self.angle, self.count = None, None, 0.0, 0

    def step(self, close: float, i1: float, q1: float) -> tuple[float, ...]:
        if self.mama is None:
            self.mama = self.fama = close
        else:
            angle = math.degrees(math.atan(q1 / i1)) if i1 else 0.0
            weight = max(self.fast / max(self.angle - angle, 1.0), self.slow)
            self.angle = angle
            self.mama = weight * close + (1 - weight) * self.mama
            self.fama = 0.5 * weight * self.mama + (1 - 0.5 * weight) * self.fama
        self.count += 1
        return (self.mama, self.fama) if self.count > SHORT else (math.nan, math.nan)


KINDS: dict[str, Callable] = {"stop_and_reverse": StopAndReverse, "cycle": Cycle, "phase": Phase, "trendline": Trendline, "trend_mode": TrendMode, "adaptive": Adaptive}
