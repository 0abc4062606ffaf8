"""Strategies: presets composed into entry and exit rules over one set of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.indicators import REGISTRY, add, crossed_above, crossed_below
from tidemark.operators.series import Series, SparkSeries
from tidemark.plans.presets import NO_ENTRY, NO_EXIT, PRESETS


def preset(s: Series, name: str) -> tuple[list[str], str | None, str | None]:
    """Outputs, entry and exit condition of a named setting."""
    kind, params = PRESETS[name]
    if kind == "PLUS_DI":  # the crossing of both directional indicators
        plus, minus = add(s, "PLUS_DI", **params)[0][0], add(s, "MINUS_DI", **params)[0][0]
        return [plus, minus], crossed_above(s, plus, minus), crossed_below(s, plus, minus)
    outputs, entry, exit_ = add(s, kind, **params)
    return outputs, None if name in NO_ENTRY else entry, None if name in NO_EXIT else exit_


def first_of_shared_outputs(entries: list[str], exits: list[str]) -> dict[str, str]:
    """For each preset the one whose outputs it reads: of presets with the same output columns the first, entries before exits, is computed."""
    owner, out = {}, {}
    for name in dict.fromkeys([*entries, *exits]):
        columns = (PRESETS[name][0],) if PRESETS[name][0] == "PLUS_DI" else REGISTRY[PRESETS[name][0]].outputs
        out[name] = owner.setdefault(columns, name)
    return out


def strategy(s: Series, entries: list[str], exits: list[str]) -> tuple[str | None, str | None]:
    """Names of the entry and exit columns: 1 where all conditions of that side hold, else null; None if no preset of the side has a rule."""
    owner = first_of_shared_outputs(entries, exits)
    built = {name: preset(s, name) for name in dict.fromkeys(owner.values())}

    def side(names: list[str], k: int) -> str | None:
        rules = []
        for name in names:
            kind, params = PRESETS[name]
            outputs = built[owner[name]][0]
            if name in (NO_ENTRY if k == 0 else NO_EXIT):
                continue
            if name == owner[name]:
                rules.append(built[name][k + 1])
            else:  # its own constants on the columns that the first one made
                spec = REGISTRY[kind]
                rules.append((spec.entry, spec.exit)[k](s, outputs, spec.defaults(**params)))
        return s.put(f"CASE WHEN {' AND '.join(s.put(r) for r in rules)} THEN 1 END") if rules else None

    return side(entries, 0), side(exits, 1)


def preset_counts(bars: DataFrame, names: list[str]) -> DataFrame:
    """preset, symbol, entries, exits: how often each preset's conditions hold; all presets are columns of one Series and one aggregation."""
    s, sums = SparkSeries(bars), []
    columns = []
    for k, name in enumerate(names):
        _, *sides = preset(s, name)
        for side, condition in zip(("entries", "exits"), sides):
            columns.append(f"CAST({condition or 'false'} AS INT) AS {side}_{k}")
            sums.append(f"sum({side}_{k}) AS {side}_{k}")
    counts = s.select(*s.keys, *columns).groupBy(*s.keys).agg(*map(F.expr, sums))
    each = ", ".join(f"named_struct('preset', '{name}', 'entries', entries_{k}, 'exits', exits_{k})" for k, name in enumerate(names))
    return counts.selectExpr(*s.keys, f"inline(array({each}))").select("preset", *s.keys, "entries", "exits")


def valid_individual(n_entries: int, n_exits: int, low: int = 2, high: int = 5) -> bool:
    return low <= n_entries <= high and low <= n_exits <= high
