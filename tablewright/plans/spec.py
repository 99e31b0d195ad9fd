"""Declarative description of a feature table.

A plan names one main table, the tables related to it and an ordered list of
features. It is plain metadata: nothing here touches Spark.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

# Feature operations, fixed values of the plan format.
AGGREGATES = ("AVG", "SUM", "COUNT", "MAX", "MIN")
DECLARED = ("RATE", "COUNT_DISTINCT")
LATEST = "LATEST"
OPS = (LATEST, *AGGREGATES, *DECLARED)

_NOT_IN_NAME = re.compile(r"[^A-Za-z0-9_]+")


class PlanError(ValueError):
    """A plan, its configuration or its tables break a rule."""


def clean_name(name: str) -> str:
    """Runs of characters outside ``A-Za-z0-9_`` become one underscore."""
    return _NOT_IN_NAME.sub("_", name)


def as_tuple(value: str | Iterable[str] | None) -> tuple[str, ...]:
    if value is None:
        return ()
    return (value,) if isinstance(value, str) else tuple(value)


def parse_window(window: object) -> int | None:
    """Window length in days from ``None``, ``90``, ``"90"``, ``"90d"`` or ``{"days": 90}``."""
    if window is None:
        return None
    days = window.get("days") if isinstance(window, Mapping) else window
    if isinstance(days, str):
        matched = re.fullmatch(r"(\d+)d?", days.strip().lower())
        days = int(matched.group(1)) if matched else None
    if isinstance(days, bool) or not isinstance(days, (int, float)) or days != int(days) or days <= 0:
        raise PlanError(f"window must be a positive number of days, got {window!r}")
    return int(days)


@dataclass(frozen=True)
class FeatureSpec:
    """One feature: an operation over a column (or row expression) of a table.

    ``predicate`` restricts the rows that count, ``expr`` replaces the column by
    a row expression, ``order_by`` ranks rows for LATEST (greatest first wins),
    and ``scale`` states how many decimals the column carries, so that sums are
    kept as whole numbers and do not depend on the order of addition.
    """

    op: str
    table: str
    column: str | None = None
    window_days: int | None = None
    predicate: str | None = None
    expr: str | None = None
    order_by: tuple[str, ...] = ()
    scale: int | None = None
    alias: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "op", self.op.upper())
        object.__setattr__(self, "window_days", parse_window(self.window_days))
        object.__setattr__(self, "order_by", as_tuple(self.order_by))

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        parts = [self.op, clean_name(self.table), clean_name(self.column or self.expr or "rows")]
        if self.window_days:
            parts.append(f"{self.window_days}d")
        return "_".join(parts)

    @property
    def identity(self) -> tuple:
        """Two specs with the same identity compute the same feature."""
        return (self.op, self.table, self.column, self.window_days, self.predicate, self.expr, self.order_by)


@dataclass(frozen=True)
class Relationship:
    """``table.key = main.main_key``.

    ``unique`` declares one row per key (a snapshot). ``time_column`` holds either
    a date or timestamp, or a whole number of days relative to the sample date.
    """

    table: str
    key: tuple[str, ...]
    main_key: tuple[str, ...]
    unique: bool = False
    time_column: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", as_tuple(self.key))
        object.__setattr__(self, "main_key", as_tuple(self.main_key))


@dataclass(frozen=True)
class MainSpec:
    """The sample table.

    ``grain``: ``"key"`` requires one row per key, ``"row"`` keeps every row, and
    ``"collapse"`` reduces the table to one row per key. ``time_column`` is what
    windows of a collapsed table compare, as in a relationship.
    """

    table: str
    key: tuple[str, ...]
    label: str | None = None
    grain: str = "key"
    time_column: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", as_tuple(self.key))


@dataclass(frozen=True)
class FeaturePlan:
    main: MainSpec
    specs: tuple[FeatureSpec, ...]
    relationships: tuple[Relationship, ...] = ()
    as_of: dt.date | None = None
    filters: Mapping[str, str] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    upper_bound: bool = True
    null_sum: str = "null"

    def __post_init__(self) -> None:
        as_of = self.as_of
        if isinstance(as_of, str):
            object.__setattr__(self, "as_of", dt.date.fromisoformat(as_of))
        object.__setattr__(self, "specs", distinct_specs(self.specs))
        object.__setattr__(self, "relationships", tuple(self.relationships))
        object.__setattr__(self, "exclude", as_tuple(self.exclude))
        object.__setattr__(self, "passthrough", as_tuple(self.passthrough))

    def relationship(self, table: str) -> Relationship:
        for rel in self.relationships:
            if rel.table == table:
                return rel
        raise PlanError(f"no relationship from {table!r} to {self.main.table!r}")

    def feature_names(self) -> list[str]:
        """The columns the plan promises, in order."""
        return [spec.name for spec in self.specs]

    def table_names(self) -> list[str]:
        """Logical tables the plan reads, the main one first: what ``bindings`` has to name."""
        return list(dict.fromkeys([self.main.table, *(s.table for s in self.specs)]))

    def with_specs(self, specs: Iterable[FeatureSpec]) -> FeaturePlan:
        return replace(self, specs=tuple(specs))


def distinct_specs(specs: Iterable[FeatureSpec]) -> tuple[FeatureSpec, ...]:
    """First occurrence of every identity, in order."""
    first: dict[tuple, FeatureSpec] = {}
    for spec in specs:
        first.setdefault(spec.identity, spec)
    return tuple(first.values())


def infer_main_table(specs: Sequence[FeatureSpec]) -> str:
    """The table most specs name; the first one seen wins a tie."""
    if not specs:
        raise PlanError("no feature specs")
    return Counter(spec.table for spec in specs).most_common(1)[0][0]


def short_aliases(names: Sequence[str], prefix: str = "f", width: int = 3) -> dict[str, str]:
    """``{"f001": first name, "f002": second name, ...}``."""
    return {f"{prefix}{i:0{width}d}": name for i, name in enumerate(names, start=1)}


def plan_diff(left: Iterable[FeatureSpec], right: Iterable[FeatureSpec]) -> dict[str, list[FeatureSpec]]:
    """Specs common to two plans and specs only one of them has."""
    a = {s.identity: s for s in left}
    b = {s.identity: s for s in right}
    return {
        "common": [s for k, s in a.items() if k in b],
        "only_left": [s for k, s in a.items() if k not in b],
        "only_right": [s for k, s in b.items() if k not in a],
    }
