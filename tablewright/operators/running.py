"""Exact running sums and ranks over an order of any length.

``sum(...) over (order by ...)`` without a partition brings all rows into one
task. Here the rows are range-partitioned in that order, each partition adds up
its own rows, and the sums of the partitions before it are joined on where a
group goes on from one to the next. The placed rows are written once, so
partition numbers stay the same for both steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.session import materialise

PART = "_part"


def running_sums(
    df: DataFrame, order: Sequence[str], sums: Sequence[str], group: Sequence[str] = (), totals: bool = True
) -> DataFrame:
    """Add ``<s>_upto`` (sum up to and including the row) and, with ``totals``, ``<s>_total`` for every ``s``.

    ``order`` must tell the rows of a group apart. Null group values form a group.
    """
    group, order = list(group), list(order)
    placed = in_ranges(df, [*group, *order])
    per_part = placed.groupBy(PART, *group).agg(*[F.sum(s).alias(f"_in_{s}") for s in sums])
    earlier = {f"_before_{s}": F.sum(f"_in_{s}") for s in sums}
    if group:
        carried = carried_over(per_part, group, earlier)
    else:  # a row per range, with the totals beside it
        before = Window.partitionBy(F.lit(0)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        whole = [F.sum(f"_in_{s}").over(Window.partitionBy(F.lit(0))).alias(f"{s}_total") for s in sums]
        carried = per_part.select(PART, *[v.over(before).alias(n) for n, v in earlier.items()], *whole)
    local = (
        Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    columns = [(F.sum(s).over(local) + F.coalesce(F.col(f"_before_{s}"), F.lit(0))).alias(f"{s}_upto") for s in sums]
    out = with_carried(placed, carried, group)
    if not totals:
        return out.select(*df.columns, *columns)
    if group:
        whole = per_part.groupBy(*group).agg(*[F.sum(f"_in_{s}").alias(f"{s}_total") for s in sums])
        whole = whole.withColumnsRenamed({c: f"_of_{c}" for c in group})
        out = out.join(whole, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]))
    return out.select(*df.columns, *columns, *[F.col(f"{s}_total") for s in sums])


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt out by ranges of ``order`` and written once, with the number of their range."""
    return materialise(df.repartitionByRange(*[quoted(c) for c in order]).withColumn(PART, F.spark_partition_id()))


def carried_over(per_part: DataFrame, group: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """What the ranges before bring to a group that goes on in a range.

    ``per_part`` has one row per range and group. Only the first group of a range goes on from the
    one before, so there are fewer rows than ranges.
    """
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.count(F.lit(1)).over(earlier).alias("_parts_before")
    rows = per_part.select(PART, *group, seen, *[v.over(earlier).alias(name) for name, v in values.items()])
    return rows.filter("_parts_before > 0").drop("_parts_before")


def with_carried(placed: DataFrame, carried: DataFrame, group: Sequence[str]) -> DataFrame:
    """The placed rows beside what is carried over to them, null for most."""
    side = carried.withColumnsRenamed({c: f"_to_{c}" for c in [PART, *group]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in group], F.col(PART) == F.col(f"_to_{PART}"))
    return placed.join(F.broadcast(side), same, "left").drop(*[f"_to_{c}" for c in [PART, *group]])


def distinct_ranks(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Every distinct value with its number of rows and its position in sorted order, from 0."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    ranked = running_sums(counted, [value], ["_one"], group)
    return ranked.select(*group, value, "n", (F.col("_one_upto") - 1).alias("code"))
