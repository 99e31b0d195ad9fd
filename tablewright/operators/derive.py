"""Row-level features made from other columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame

from tablewright.functions.columns import bands, quoted, ratio
from tablewright.plans.spec import PlanError

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": ratio,
}


def cross_feature(df: DataFrame, operator: str, features: Sequence[str], name: str) -> DataFrame:
    """An operator over several columns, from left to right. Division by zero gives null."""
    if operator not in OPERATORS:
        raise PlanError(f"unknown operator {operator!r}")
    columns = [quoted(c).cast("double") for c in features]
    return df.withColumn(name, reduce(OPERATORS[operator], columns))


def ratio_bands(
    df: DataFrame, numerator: str, denominator: str, limits: Mapping[str, float], name: str, below: str = "normal"
) -> DataFrame:
    """A ratio and the band it falls into: the highest limit exceeded, else ``below``."""
    value = ratio(quoted(numerator), quoted(denominator))
    levels = [(limit, label) for label, limit in limits.items()]
    return df.withColumn(name, value).withColumn(f"{name}_band", bands(quoted(name), levels, below))
