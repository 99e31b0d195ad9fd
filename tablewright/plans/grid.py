"""Rule-made feature pools."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from tablewright.functions.columns import is_key_like, numeric_columns
from tablewright.plans.spec import FeatureSpec, Relationship

# Windows in days and operations of the grid. Fixed values.
GRID_WINDOWS = (30, 90, 365)
GRID_OPS = ("AVG", "SUM", "MAX", "MIN")

# Features taken from the main table when a plan names none. Fixed values.
DEFAULT_FEATURES = 16


def window_grid(
    tables: Mapping[str, DataFrame],
    relationships: Iterable[Relationship],
    windows: Sequence[int] = GRID_WINDOWS,
    ops: Sequence[str] = GRID_OPS,
    exclude: Iterable[str] = (),
    scales: Mapping[str, int] | None = None,
) -> list[FeatureSpec]:
    """Numeric column x operation x window for each related table with a time column; keys and ids stay out."""
    relationships = list(relationships)
    # Keys of any relationship are no measures, wherever they occur.
    keys = {c for rel in relationships for c in (*rel.key, *rel.main_key)}
    banned, scales, out = set(exclude) | keys, scales or {}, []
    for rel in relationships:
        if rel.unique or rel.time_column is None or rel.table not in tables:
            continue
        skip = banned | set(rel.key) | {rel.time_column}
        for column in numeric_columns(tables[rel.table]):
            if column in skip or is_key_like(column):
                continue
            out += [
                FeatureSpec(op, rel.table, column, days, scale=scales.get(column)) for op in ops for days in windows
            ]
    return out


def default_specs(df: DataFrame, table: str, skip: Iterable[str], limit: int = DEFAULT_FEATURES) -> list[FeatureSpec]:
    """The first columns of the main table as plain projections, for plans without specs."""
    banned = set(skip)
    return [FeatureSpec("LATEST", table, c) for c in df.columns if c not in banned][:limit]
