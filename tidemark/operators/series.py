"""Series operators: columns over each symbol's bars in time order.

A ``Series`` collects steps, each of which adds a column: an SQL expression over the columns so far (window functions included), or a job that goes
through a symbol's bars in order. Equal steps are one step, so indicators that share an average or a range compute it once, whatever asks for it.

``SparkSeries`` runs the steps that a result needs, and only when it is asked for. Expressions share one partitioning and order, so Spark shuffles and sorts
the bars once; all jobs whose inputs are there run in one pass over the sorted bars (``passes.run_pass``). ``SqlSeries`` writes the same steps as SQL text for
a check by another engine. Missing values are null; quotients of zero are null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators.passes import Job, run_blocks, run_pass

_OWN = re.compile(r"\bt\d+_\b")
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"[-+]?[\d.]+(e[-+]?\d+)?", re.IGNORECASE)


class Series:
    """The steps' vocabulary; ``put``, ``affine_all`` and ``sequential`` are left to the engine."""

    def __init__(self, keys: tuple[str, ...] = ("symbol",)) -> None:
        self.keys, self.count = keys, 0
        self.known: dict[tuple, object] = {}

    def name(self) -> str:
        self.count += 1
        return f"t{self.count}_"

    def put(self, spark: str, other: str | None = None) -> str:
        raise NotImplementedError

    def affine_all(self, pairs: list[tuple[str, str]]) -> list[str]:
        raise NotImplementedError

    def sequential(self, kind: str, inputs: list[str], outputs: int, **params: float) -> list[str]:
        raise NotImplementedError

    def affine(self, a: str, b: str) -> str:
        return self.affine_all([(a, b)])[0]

    def window(self, frame: str = "") -> str:
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY bar_ts{' ' + frame if frame else ''})"

    def frame(self, n: int) -> str:
        return self.window(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")

    def running(self, aggregate: str) -> str:
        return f"{aggregate} {self.window('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"

    def lag(self, x: str, k: int = 1) -> str:
        return x if _NUMBER.fullmatch(x) else self.put(f"lag({x}, {k}) {self.window()}")

    def roll(self, aggregate: str, x: str, n: int) -> str:
        """An aggregate of the last n values; null until there are n."""
        return self.put(f"CASE WHEN count({x}) {self.frame(n)} = {n} THEN {aggregate}({x}) {self.frame(n)} END")

    def sma(self, x: str, n: int) -> str:
        return self.roll("avg", x, n)

    def total(self, aggregate: str) -> str:
        return self.put(self.running(aggregate))

    def minus(self, x: str, y: str) -> str:
        return self.put(f"{x} - {y}")

    def ema(self, x: str, n: int, alpha: float | None = None, seed_at: int | None = None) -> str:
        """y = (1 - alpha) * y + alpha * x, from the mean of n values on that end with the ``seed_at``-th one (the n-th by default)."""
        return self.emas([x], n, alpha, seed_at)[0]

    def emas(self, xs: list[str], n: int, alpha: float | None = None, seed_at: int | None = None) -> list[str]:
        return self.emas_of([(x, n, alpha, seed_at) for x in xs])

    def emas_of(self, items: list[tuple[str, int, float | None, int | None]]) -> list[str]:
        """The averages of several (x, n, alpha, seed_at)."""
        pairs = []
        for x, n, alpha, seed_at in items:
            alpha, at = 2.0 / (n + 1) if alpha is None else alpha, seed_at or n
            k, first = self.total(f"count({x})"), self.put(f"avg({x}) {self.frame(n)}")
            pairs.append((f"CASE WHEN {k} = {at} THEN 0.0 WHEN {k} > {at} THEN {1.0 - alpha!r} END", f"CASE WHEN {k} = {at} THEN {first} WHEN {k} > {at} THEN {alpha!r} * {x} END"))
        return self.affine_all(pairs)

    def cascade(self, x: str, n: int, times: int) -> list[str]:
        """An average, the average of that, and so on: each begins with the mean of the first n values of the one before."""
        out = []
        for _ in range(times):
            x = self.ema(x, n)
            out.append(x)
        return out

    def wilder_sums(self, xs: list[str], n: int) -> list[str]:
        """y = y - y / n + x, from the sum of the first n - 1 values on."""
        pairs = []
        for x in xs:
            k, first = self.total(f"count({x})"), self.total(f"sum({x})")
            pairs.append((f"CASE WHEN {k} = {n - 1} THEN 0.0 WHEN {k} > {n - 1} THEN {1.0 - 1.0 / n!r} END", f"CASE WHEN {k} = {n - 1} THEN {first} WHEN {k} > {n - 1} THEN {x} END"))
        return self.affine_all(pairs)

    def wilder(self, x: str, n: int) -> str:
        return self.ema(x, n, alpha=1.0 / n)


@dataclass
class _Step:
    """An expression (``text``) or a job; ``turn``: the number of passes before it, ``depth``: expressions of that turn that it stands on."""

    turn: int
    depth: int
    text: str | None = None
    job: Job | None = None


class SparkSeries(Series):
    """``block``: with it, recurrences of symbols of more bars than that are folded by several tasks at once, a pass for each that stands on another."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...] = ("symbol",), block: int | None = None) -> None:
        super().__init__(keys)
        self.base, self.steps, self.block = df, {}, block

    def _add(self, text: str | None = None, job: Job | None = None) -> list[str]:
        key = ("put", text) if job is None else ("job", job.kind, job.inputs, job.params)
        if key not in self.known:
            names = (self.name(),) if job is None else tuple(self.name() for _ in range(job.outputs))
            on = [self.steps[r] for r in dict.fromkeys(_OWN.findall(text) if job is None else job.inputs) if r in self.steps]
            if job is None:
                turn = max((s.turn + (s.job is not None) for s in on), default=0)
                step = _Step(turn, 1 + max((s.depth for s in on if s.job is None and s.turn == turn), default=-1), text=text)
            else:
                step = _Step(max((s.turn for s in on), default=0), 0, job=job.named(names))
            self.steps |= dict.fromkeys(names, step)
            self.known[key] = list(names)
        return list(self.known[key])

    def put(self, spark: str, other: str | None = None) -> str:
        return spark if _OWN.fullmatch(spark) else self._add(text=spark)[0]

    def _column(self, x: str) -> str:
        return x if self._of_job(x) and not self.block else self.put(f"CAST({x} AS DOUBLE)")

    def job(self, kind: str, inputs: list[str], outputs: int = 1, **params: float) -> list[str]:
        return self._add(job=Job(kind, tuple(self._column(x) for x in inputs), outputs, tuple(sorted(params.items()))))

    sequential = job

    def _of_job(self, x: str) -> bool:
        return x in self.steps and self.steps[x].job is not None

    def lag(self, x: str, k: int = 1) -> str:
        return self.job("lag", [x], k=k)[0] if self._of_job(x) and not self.block else super().lag(x, k)

    def minus(self, x: str, y: str) -> str:
        return self.job("minus", [x, y])[0] if (self._of_job(x) or self._of_job(y)) and not self.block else super().minus(x, y)

    def affine_all(self, pairs: list[tuple[str, str]]) -> list[str]:
        return [self.job("affine", [a, b])[0] for a, b in pairs]

    def emas_of(self, items: list[tuple[str, int, float | None, int | None]]) -> list[str]:
        if self.block:
            return super().emas_of(items)
        return [self.job("ema", [x], n=n, alpha=2.0 / (n + 1) if alpha is None else alpha, seed_at=seed_at or n)[0] for x, n, alpha, seed_at in items]

    def wilder_sums(self, xs: list[str], n: int) -> list[str]:
        if self.block:
            return super().wilder_sums(xs, n)
        return [self.job("wilder_sum", [x], n=n)[0] for x in xs]

    @property
    def df(self) -> DataFrame:
        """All columns, those of every step included."""
        return self.select(*[f"`{c}`" for c in self.base.columns], *self.steps)

    def select(self, *exprs: str) -> DataFrame:
        """The expressions, after the steps that they need."""
        needed, todo = set(), _OWN.findall(" ".join(exprs))
        while todo:
            if (name := todo.pop()) in self.steps and name not in needed:
                step = self.steps[name]
                needed |= {name} if step.job is None else set(step.job.names)
                todo += _OWN.findall(step.text) if step.job is None else step.job.inputs
        steps = {id(s): s for n, s in self.steps.items() if n in needed}.values()
        names = {id(s): n for n, s in self.steps.items()}
        df, carried = self.base, list(self.base.columns)
        for turn in range(max((s.turn for s in steps), default=0) + 1):
            own = [s for s in steps if s.turn == turn and s.job is None]
            for depth in sorted({s.depth for s in own}):
                new = [s for s in own if s.depth == depth]
                df = df.selectExpr("*", *[f"{s.text} AS {names[id(s)]}" for s in new])
                carried += [names[id(s)] for s in new]
            jobs = [s.job for s in steps if s.turn == turn and s.job is not None]
            if jobs:
                later = [s for s in steps if s.turn > turn]
                text = " ".join([*exprs, *[s.text if s.job is None else " ".join(s.job.inputs) for s in later]])
                used = {*_WORD.findall(text), *self.keys, "bar_ts", "bar_idx"}
                keep = [c for c in carried if c in used]
                alone = self.block and all(j.kind == "affine" for j in jobs)
                df = run_blocks(df, self.keys, jobs, keep, self.block) if alone else run_pass(df, self.keys, jobs, keep)
                carried = [*keep, *[n for j in jobs for n in j.names]]
        return df.selectExpr(*exprs)


class SqlSeries(Series):
    """The steps as common table expressions; ``source`` is a subquery with bar_idx."""

    def __init__(self, source: str, keys: tuple[str, ...] = ("symbol",)) -> None:
        super().__init__(keys)
        self.parts = [f"v0 AS MATERIALIZED ({source})"]

    def put(self, spark: str, other: str | None = None) -> str:
        text = other or spark
        if _OWN.fullmatch(text):
            return text
        if ("put", text) not in self.known:
            self.known["put", text] = name = self.name()
            self.parts.append(f"v{len(self.parts)} AS (SELECT *, {text} AS {name} FROM v{len(self.parts) - 1})")
        return self.known["put", text]

    def affine_all(self, pairs: list[tuple[str, str]]) -> list[str]:
        return [self._affine(a, b) for a, b in pairs]

    def _affine(self, a: str, b: str) -> str:
        if ("affine", a, b) in self.known:
            return self.known["affine", a, b]
        key, a, b = ("affine", a, b), self.put(f"CAST({a} AS DOUBLE)"), self.put(f"CAST({b} AS DOUBLE)")
        name = self.known[key] = self.name()
        keys = ", ".join(self.keys)
        self.recursive(
            [name], lambda v, r, on: f"SELECT {keys}, bar_idx, {b} FROM {v} WHERE {a} = 0 UNION ALL SELECT {', '.join('s.' + k for k in self.keys)}, s.bar_idx, s.{a} * r.{name} + s.{b} FROM {r} r JOIN {v} s ON {on} AND s.bar_idx = r.bar_idx + 1"
        )
        return name

    def recursive(self, columns: list[str], body, place: str = "bar_idx") -> None:
        """Columns by bar (of number ``place``) of a recursive query: ``body`` takes the rows so far, the query's own name and the join of keys of s and r; what it selects begins with the keys and the place."""
        last = len(self.parts) - 1
        self.parts[last] = self.parts[last].replace(" AS (", " AS MATERIALIZED (", 1)
        on = " AND ".join(f"s.{k} = r.{k}" for k in self.keys)
        self.parts.append(f"r{last + 1}({', '.join([*self.keys, place, *columns])}) AS ({body(f'v{last}', f'r{last + 1}', on)})")
        shown = [c for c in columns if _OWN.fullmatch(c)]
        self.parts.append(f"v{last + 2} AS MATERIALIZED (SELECT s.*, {', '.join('r.' + c for c in shown)} FROM v{last} s LEFT JOIN r{last + 1} r ON {on} AND s.{place} = r.{place})")

    def sequential(self, kind: str, inputs: list[str], outputs: int, **params: float) -> list[str]:
        from tidemark.plans.recursions import RECURSIONS

        key = (kind, *inputs, *sorted(params.items()))
        if key not in self.known:
            self.known[key] = RECURSIONS[kind](self, *inputs, **params)
        return self.known[key]

    def sql(self, select: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.parts)} SELECT {select} FROM v{len(self.parts) - 1}"
