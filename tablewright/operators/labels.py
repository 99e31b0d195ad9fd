"""The target column: finding, cleaning and checking it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted, to_number
from tablewright.operators.prep import label_encode
from tablewright.plans.spec import PlanError

# Text labels with a fixed meaning. Fixed values.
TEXT_LABELS = {"yes": 1, "no": 0, "y": 1, "n": 0}
# Fewest rows worth screening. Fixed value.
MIN_ROWS = 50


def resolve_label(columns: list[str], target: str) -> str:
    """The column meant by ``target``: the exact name, else ignoring case and underscores."""
    if target in columns:
        return target

    def bare(name: str) -> str:
        return name.lower().replace("_", "")

    for column in columns:
        if bare(column) == bare(target):
            return column
    raise PlanError(f"no target column like {target!r}")


def normalise_label(
    df: DataFrame, column: str, mapping: Mapping[str, int] | None = None, on_bad_label: str = "error"
) -> DataFrame:
    """Label as 0/1.

    Texts in ``mapping`` are replaced first. A value that is no number, or
    missing, is ``"zero"`` (counted as 0), ``"drop"`` or ``"error"``; numbers lose
    their fraction toward zero, and rows whose label is then neither 0 nor 1 are
    dropped. Under ``"error"`` such labels raise, and so do fractions.
    """
    if on_bad_label not in ("zero", "drop", "error"):
        raise PlanError(f"unknown on_bad_label {on_bad_label!r}")
    column = resolve_label(df.columns, column)
    raw = quoted(column).cast("string")
    value = raw
    if mapping:
        known = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, str(v))])
        value = F.coalesce(F.try_element_at(known, raw), raw)
    exact = to_number(value)
    number = F.when(F.abs(exact) < 2, exact.cast("int"))
    if on_bad_label == "zero":
        number = F.when(exact.isNull(), 0).otherwise(number)
    if on_bad_label == "error":
        complaint = F.raise_error(F.concat(F.lit(f"bad label in {column}: "), F.coalesce(raw, F.lit("null"))))
        return df.withColumn(column, F.when(exact.isin(0.0, 1.0), number).otherwise(complaint.cast("int")))
    return df.withColumn(column, number).filter(quoted(column).isin(0, 1))


def text_label_codes(df: DataFrame, column: str, name: str = "label_code") -> DataFrame:
    """yes/no/y/n as 1/0, other texts kept, then alphabetical codes of the result."""
    known = F.create_map(*[F.lit(x) for k, v in TEXT_LABELS.items() for x in (k, str(v))])
    text = quoted(column).cast("string")
    mapped = df.withColumn("_label", F.coalesce(F.try_element_at(known, text), text))
    return label_encode(mapped, ["_label"], "_code").withColumnRenamed("_label_code", name).drop("_label")


def class_check(df: DataFrame, label: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rows, classes, positives and whether the label can be modelled."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(quoted(label)).alias("n_classes"),
        F.count_if(quoted(label) == 1).alias("n_pos"),
    ).withColumn("usable", ((F.col("n_classes") >= 2) & (F.col("n_rows") >= min_rows)).cast("int"))


def require_two_classes(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; raises before fitting when only one class is present."""
    row = df.agg(F.count_if(quoted(label) == 0).alias("n0"), F.count_if(quoted(label) == 1).alias("n1")).first()
    counts = {0: row["n0"], 1: row["n1"]}
    if not all(counts.values()):
        raise PlanError(f"label {label!r} has fewer than two classes: {counts}")
    return counts
