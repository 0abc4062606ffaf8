"""Jobs over each symbol's bars in order: one pass through Arrow batches runs any number of them and holds a few numbers of each, however long a symbol is.

Linear recurrences ``y = a * y + b`` compose (one after another is again one), so a batch is folded in numpy by doubling, without a loop over rows. What is not
linear is a small machine with a fixed state (``kernels``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows folded by doubling at once.
_LANE = 128


@dataclass(frozen=True)
class Job:
    """``outputs`` columns from ``inputs`` (columns of doubles, or of jobs before it)."""

    kind: str
    inputs: tuple[str, ...]
    outputs: int
    params: tuple[tuple[str, float], ...]
    names: tuple[str, ...] = ()

    def named(self, names: tuple[str, ...]) -> Job:
        return replace(self, names=names)


class Places:
    """Where symbols begin in a batch, and how many of a symbol's rows came before it."""

    def __init__(self, new: np.ndarray) -> None:
        self.new = new
        self.first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))  # -1: begun in an earlier batch

    def counts(self, marked: np.ndarray, before: int) -> np.ndarray:
        """How many marked rows the symbol has, up to each row."""
        total = np.cumsum(marked)
        start = np.where(self.first > 0, total[self.first - 1], 0)
        return total - start + np.where(self.first < 0, before, 0)


def folded(a: np.ndarray, b: np.ndarray, before: float) -> np.ndarray:
    """y[t] = a[t] * y[t - 1] + b[t], with y[-1] = before."""
    n = len(a)
    rows = -(-n // _LANE)
    p, y = np.ones(rows * _LANE), np.zeros(rows * _LANE)
    p[:n], y[:n] = a, b
    p, y = p.reshape(rows, _LANE), y.reshape(rows, _LANE)
    step = 1
    while step < _LANE:
        y[:, step:] = y[:, step:] + p[:, step:] * y[:, :-step]
        p[:, step:] = p[:, step:] * p[:, :-step]
        step *= 2
    into = np.empty(rows)
    for k, (c, d) in enumerate(zip(p[:, -1].tolist(), y[:, -1].tolist())):
        into[k] = before
        before = c * before + d
    return (y + p * into[:, None]).reshape(-1)[:n]


class Affine:
    """y = a * y + b; null where b is null, and then y begins anew. The first b of a symbol has a = 0."""

    def __init__(self) -> None:
        self.y = 0.0

    def __call__(self, places: Places, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        none = np.isnan(b)
        y = folded(np.where(none | places.new | np.isnan(a), 0.0, a), np.where(none, 0.0, b), self.y)
        self.y = y[-1]
        return [np.where(none, np.nan, y)]


def folded_between(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, before: float) -> np.ndarray:
    """y[t] = min(max(a[t] * y[t - 1] + b[t], low[t]), high[t]) for a >= 0, with y[-1] = before: such maps compose to maps of their kind."""
    n = len(a)
    rows = -(-n // _LANE)
    maps = [np.full(rows * _LANE, v) for v in (1.0, 0.0, -np.inf, np.inf)]
    for m, v in zip(maps, (a, b, low, high)):
        m[:n] = v
    a, b, low, high = (m.reshape(rows, _LANE) for m in maps)
    step = 1
    while step < _LANE:
        a2, b2, low2, high2 = (m[:, step:] for m in (a, b, low, high))
        a1, b1, low1, high1 = (m[:, :-step].copy() for m in (a, b, low, high))
        b1, low1, high1 = a2 * b1 + b2, *(np.minimum(np.maximum(a2 * np.nan_to_num(x, posinf=1e300, neginf=-1e300) + b2, low2), high2) for x in (low1, high1))
        a, b, low, high = (np.concatenate([m[:, :step], new], axis=1) for m, new in ((a, a2 * a1), (b, b1), (low, low1), (high, high1)))
        step *= 2
    into = np.empty(rows)
    for k in range(rows):
        into[k] = before
        before = min(max(a[k, -1] * before + b[k, -1], low[k, -1]), high[k, -1])
    return np.minimum(np.maximum(a * into[:, None] + b, low), high).reshape(-1)[:n]


class Clamped:
    """y = a * y + b, held between ``least`` and ``most``; a symbol begins from ``start``."""

    def __init__(self, least: float, most: float, start: float) -> None:
        self.least, self.most, self.first, self.y = least, most, start, start

    def __call__(self, places: Places, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        n = len(a)
        y = folded_between(np.where(places.new, 0.0, a), np.where(places.new, a * self.first + b, b), np.full(n, self.least), np.full(n, self.most), self.y)
        self.y = y[-1]
        return [y]


class Ema:
    """An exponential average from the mean of the n values on that end with the ``seed_at``-th; a null leaves it as it is."""

    def __init__(self, n: int, alpha: float, seed_at: int) -> None:
        self.n, self.alpha, self.seed_at, self.y, self.count = n, alpha, seed_at, 0.0, 0

    def __call__(self, places: Places, x: np.ndarray) -> list[np.ndarray]:
        some = ~np.isnan(x)
        k, x = places.counts(some, self.count), np.where(some, x, 0.0)
        seeding = k <= self.seed_at
        # folded n-fold, so that the first value is a plain mean
        a = np.where(seeding | ~some, 1.0, 1.0 - self.alpha)
        b = np.where(seeding, np.where(k > self.seed_at - self.n, x, 0.0), self.alpha * self.n * x)
        y = folded(np.where(places.new, 0.0, a), b, self.y)
        self.y, self.count = y[-1], int(k[-1])
        return [np.where(some & (k >= self.seed_at), y / self.n, np.nan)]


class WilderSum:
    """y = y - y / n + x, from the sum of the first n - 1 values on."""

    def __init__(self, n: int) -> None:
        self.n, self.y, self.count = n, 0.0, 0

    def __call__(self, places: Places, x: np.ndarray) -> list[np.ndarray]:
        some = ~np.isnan(x)
        k, x = places.counts(some, self.count), np.where(some, x, 0.0)
        a = np.where((k < self.n) | ~some, 1.0, 1.0 - 1.0 / self.n)
        y = folded(np.where(places.new, 0.0, a), x, self.y)
        self.y, self.count = y[-1], int(k[-1])
        return [np.where(some & (k >= self.n - 1), y, np.nan)]


class Lag:
    def __init__(self, k: int) -> None:
        self.k, self.last, self.count = k, np.full(k, np.nan), 0

    def __call__(self, places: Places, x: np.ndarray) -> list[np.ndarray]:
        joined = np.concatenate([self.last, x])
        at = places.counts(np.ones(len(x), bool), self.count)
        self.last, self.count = joined[-self.k :], int(at[-1])
        return [np.where(at > self.k, joined[: len(x)], np.nan)]


class Minus:
    def __call__(self, places: Places, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [x - y]


class Dx:
    """100 * abs(plus - minus) / (plus + minus) of directional indicators (sums over the range's, 0 if that is 0) from bar n on; where both are zero the one before, or 0."""

    def __init__(self, n: int) -> None:
        self.n, self.last, self.count = n, 0.0, 0

    def __call__(self, places: Places, plus: np.ndarray, minus: np.ndarray, tr: np.ndarray) -> list[np.ndarray]:
        at = places.counts(np.ones(len(plus), bool), self.count)
        self.count = int(at[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            plus, minus = (np.where(np.isnan(x / tr) | (tr == 0), 0.0, 100.0 * x / tr) for x in (plus, minus))
            raw = 100.0 * np.abs(plus - minus) / (plus + minus)
        ready = at > self.n
        good = ready & (plus + minus != 0)
        latest = np.maximum.accumulate(np.where(good | places.new, np.arange(len(raw)), -1))
        filled = np.where(latest < 0, self.last, np.where(good, raw, 0.0)[latest])
        self.last = filled[-1]
        return [np.where(ready, filled, np.nan)]


KINDS: dict[str, Callable] = {"affine": Affine, "ema": Ema, "wilder_sum": WilderSum, "lag": Lag, "minus": Minus, "dx": Dx, "clamped": Clamped}


def begins(columns: list[pa.Array], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows whose key differs from the row before, and the last row's key."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        none = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | (none[1:] & none[:-1]))
    new[0] = tuple(c[0].as_py() for c in columns) != last
    return new, tuple(c[-1].as_py() for c in columns)


def run_pass(df: DataFrame, keys: tuple[str, ...], jobs: list[Job], keep: list[str], order: str = "bar_ts") -> DataFrame:
    """Columns ``keep`` and the outputs of all jobs, in one pass over each key's bars by time (or ``order``); Spark shuffles nothing if the bars lie by key already."""
    from tidemark.operators import kernels

    kinds = KINDS | kernels.KINDS
    made = {n for j in jobs for n in j.names}
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, order)
    read = list(dict.fromkeys([*keep, *[x for j in jobs for x in j.inputs if x not in made]]))
    ordered, where = ordered.select(*[f"`{c}`" for c in read]), {c: k for k, c in enumerate(read)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, last = [kinds[j.kind](**dict(j.params)) for j in jobs], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = begins([batch.column(where[k]) for k in keys], last)
            places, columns = Places(new), {}
            for job, machine in zip(jobs, machines):
                for x in job.inputs:
                    if x not in columns:
                        columns[x] = batch.column(where[x]).to_numpy(zero_copy_only=False).astype(float)
                columns |= zip(job.names, machine(places, *(columns[x] for x in job.inputs)))
            out = [pa.array(columns[n], pa.float64(), from_pandas=True) for j in jobs for n in j.names]
            yield pa.RecordBatch.from_arrays([*(batch.column(where[c]) for c in keep), *out], [*keep, *[n for j in jobs for n in j.names]])

    fields = [ordered.schema[c] for c in keep] + [StructField(n, DoubleType()) for j in jobs for n in j.names]
    return ordered.mapInArrow(run, StructType(fields))


def run_blocks(df: DataFrame, keys: tuple[str, ...], jobs: list[Job], keep: list[str], block: int) -> DataFrame:
    """``run_pass`` for affine jobs with several tasks to a symbol: each block of bars is folded from zero together with the product of its a.

    Recurrences compose, so what comes into a block follows from a row for each block before it, and is added to what the block has.
    """
    spark = df.sparkSession
    read = list(dict.fromkeys([*keep, *[x for j in jobs for x in j.inputs]]))
    blocks = df.select(*[f"`{c}`" for c in read], F.floor(F.col("bar_idx") / block).alias("block_"))
    blocks = blocks.repartition(*keys, "block_").sortWithinPartitions(*keys, "block_", "bar_ts")
    where, added = {c: k for k, c in enumerate(blocks.columns)}, [f"{kind}{k}_" for k in range(len(jobs)) for kind in "yp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, [[0.0, 1.0] for _ in jobs]
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = begins([batch.column(where[k]) for k in (*keys, "block_")], last)
            out = []
            for job, into in zip(jobs, state):
                a, b = (batch.column(where[x]).to_numpy(zero_copy_only=False).astype(float) for x in job.inputs)
                none = np.isnan(b)
                a = np.where(none | np.isnan(a), 0.0, a)
                y, p = folded(np.where(new, 0.0, a), np.where(none, 0.0, b), into[0]), folded(np.where(new, 0.0, a), np.where(new, a, 0.0), into[1])
                into[:] = y[-1], p[-1]
                out += [pa.array(y), pa.array(p)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *added])

    fields = [StructField(c, DoubleType()) for c in added]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    parts = blocks.mapInArrow(run, StructType([*blocks.schema.fields, *fields])).checkpoint()
    ends = parts.groupBy(*keys, "block_").agg(F.max_by(F.struct(*added), "bar_idx").alias("end_"))
    past = F.collect_list("end_").over(Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    into = [F.expr(f"aggregate(past_, 0.0D, (y, x) -> x.p{k}_ * y + x.y{k}_) AS in{k}_") for k in range(len(jobs))]
    ends = ends.withColumn("past_", past).select(*keys, "block_", *into)
    outs = [F.when(F.col(j.inputs[1]).isNotNull(), F.col(f"y{k}_") + F.col(f"p{k}_") * F.col(f"in{k}_")).alias(j.names[0]) for k, j in enumerate(jobs)]
    return parts.join(ends, [*keys, "block_"]).select(*[f"`{c}`" for c in keep], *outs)
