"""Aggregates of many trailing windows from bands between the windows' ends.

Windows end on the same day, so each holds the one before. The days between two windows' starts are
a band: rows are summed once per key and band, and a window adds up its bands. A row costs one
aggregate per column and operation however many windows there are, and the table is read once.
Distinct counts keep the nearest band of each key and value, and count values per window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted, sql_whole
from tablewright.plans.spec import FeatureSpec

BAND = "_band"
Numbered = list[tuple[int, FeatureSpec]]


def with_bands(df: DataFrame, windows: Sequence[int], bounds: Callable[[int], str]) -> DataFrame:
    """Add the number of the shortest window that holds the row; rows in none get the number of windows."""
    cases = " ".join(f"WHEN {bounds(days)} THEN {i}" for i, days in enumerate(windows))
    band = f"CASE {cases} ELSE {len(windows)} END" if windows else "0"
    return df.withColumn(BAND, F.expr(f"CAST({band} AS INT)"))


def window_days(specs: Numbered) -> list[int]:
    return sorted({s.window_days for _, s in specs if s.window_days})


class Partials:
    """What is kept per key and band: each sum, count or extreme once."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def name(self, aggregate: str) -> str:
        return self.names.setdefault(aggregate, f"_p{len(self.names)}")

    def total(self, aggregate: str, last: int | None, how: str = "sum") -> str:
        """SQL for the aggregate over the bands up to ``last``, over all where there is no window."""
        part = self.name(aggregate)
        return f"{how}({part if last is None else f'CASE WHEN {BAND} <= {last} THEN {part} END'})"


def _combined(spec: FeatureSpec, value: str | None, last: int | None, partials: Partials, null_sum: str) -> str:
    """SQL for ``spec`` from partial aggregates, null where no row is in the window."""
    rows = f"coalesce({partials.total('count(1)', last)}, 0L)"
    if spec.op == "RATE":
        return f"coalesce({partials.total(f'count_if({spec.predicate})', last)}, 0L) / nullif({rows}, 0L)"
    value = "1" if value is None else value
    value = f"CASE WHEN {spec.predicate} THEN {value} END" if spec.predicate else value
    if spec.op in ("MAX", "MIN"):
        return partials.total(f"{spec.op.lower()}({value})", last, spec.op.lower())
    count = f"coalesce({partials.total(f'count({value})', last)}, 0L)"
    if spec.op == "COUNT":
        return count if last is None else f"CASE WHEN {rows} > 0L THEN {count} END"
    if spec.scale is None:
        out = partials.total(f"sum({value})", last)
    else:
        out = f"({partials.total(f'sum({sql_whole(value, spec.scale)})', last)} / {10**spec.scale}.0D)"
    if spec.op == "AVG":
        return f"{out} / nullif({count}, 0L)"
    return f"CASE WHEN {rows} > 0L THEN coalesce({out}, 0.0D) END" if null_sum == "zero" else out


def banded(
    df: DataFrame,
    key: Sequence[str],
    specs: Numbered,
    values: Callable[[FeatureSpec], str | None],
    bounds: Callable[[int], str],
    names: Callable[[int], str],
    null_sum: str,
) -> DataFrame:
    """One row per key with all features of ``specs``, whatever the number of windows."""
    windows, partials = window_days(specs), Partials()
    columns = []
    for i, spec in specs:
        last = windows.index(spec.window_days) if spec.window_days else None
        columns.append(f"{_combined(spec, values(spec), last, partials, null_sum)} AS {names(i)}")
    keys = [quoted(k) for k in key]
    per_band = with_bands(df, windows, bounds).groupBy(*keys, BAND).agg(*[F.expr(f"{a} AS {n}") for a, n in partials.names.items()])
    return per_band.groupBy(*keys).agg(*map(F.expr, columns))


def distinct_counts(
    df: DataFrame,
    key: Sequence[str],
    specs: Numbered,
    value: str,
    bounds: Callable[[int], str],
    names: Callable[[int], str],
) -> DataFrame:
    """One row per key with the distinct counts of one value over all its windows, no row repeated.

    Null values count as no value but as rows: a window without rows gives null.
    """
    windows, keys = window_days(specs), [quoted(k) for k in key]
    valued = with_bands(df, windows, bounds).withColumn("_value", F.expr(value))
    nearest = valued.groupBy(*keys, "_value").agg(F.min(BAND).alias(BAND))
    columns = []
    for i, spec in specs:
        if spec.window_days:
            inside = f"{BAND} <= {windows.index(spec.window_days)}"
            columns.append(f"CASE WHEN count_if({inside}) > 0 THEN count_if(_value IS NOT NULL AND {inside}) END AS {names(i)}")
        else:
            columns.append(f"count(_value) AS {names(i)}")
    return nearest.groupBy(*keys).agg(*map(F.expr, columns))
