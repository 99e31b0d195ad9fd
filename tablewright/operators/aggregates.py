"""Feature operations as aggregate expressions.

All aggregates of one table and key are evaluated in one pass. Each operation
therefore carries its own row condition instead of filtering the table. They are
SQL text: a plan may have a thousand of them, and a text is one call to Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from tablewright.functions.columns import sql_exact_sum
from tablewright.plans.spec import FeatureSpec


def _sum(spec: FeatureSpec, value: str) -> str:
    return f"sum({value})" if spec.scale is None else sql_exact_sum(value, spec.scale)


def _avg(spec: FeatureSpec, value: str) -> str:
    if spec.scale is None:
        return f"avg({value})"
    return f"{sql_exact_sum(value, spec.scale)} / nullif(count({value}), 0)"


AGGREGATORS: dict[str, Callable[[FeatureSpec, str], str]] = {
    "SUM": _sum,
    "AVG": _avg,
    "COUNT": lambda spec, value: f"count({value})",
    "MAX": lambda spec, value: f"max({value})",
    "MIN": lambda spec, value: f"min({value})",
    "COUNT_DISTINCT": lambda spec, value: f"count(DISTINCT {value})",
}


def feature_aggregate(spec: FeatureSpec, value: str | None, in_window: str | None, null_sum: str = "null") -> str:
    """SQL for the aggregate of ``spec`` over all rows of a key.

    A key with no row inside the window gets null from every operation, COUNT
    included; with rows in the window COUNT is at least 0.
    """
    rows = "count(1)" if in_window is None else f"count_if({in_window})"
    conditions = [f"({c})" for c in (in_window, spec.predicate) if c]
    keep = " AND ".join(conditions)
    if spec.op == "RATE":
        return f"count_if({keep}) / nullif({rows}, 0)"

    value = "1" if value is None else value
    out = AGGREGATORS[spec.op](spec, f"CASE WHEN {keep} THEN {value} END" if keep else value)
    if spec.op in ("COUNT", "COUNT_DISTINCT") and in_window is not None:
        return f"CASE WHEN {rows} > 0 THEN {out} END"
    if spec.op == "SUM" and null_sum == "zero":
        return f"CASE WHEN {rows} > 0 THEN coalesce({out}, 0.0D) END"
    return out
