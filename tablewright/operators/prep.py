"""Preparation of feature columns: medians, codes, indicators, scaling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    MISSING_NUMBER,
    MISSING_TEXT,
    category_text,
    is_numeric,
    no_nan,
    quoted,
    safe_log1p,
    sql_category,
    sql_name,
    sql_no_nan,
    sql_text,
    to_number,
)
from tablewright.operators.joins import TASK_ROWS, even_share, left_join_all, pieces
from tablewright.operators.running import distinct_ranks, running_sums
from tablewright.plans.spec import PlanError, clean_name

# Bytes of a column's dictionary that is sent to every task at most.
SENT_BYTES = 8 << 20


def long_values(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per value: ``feature``, ``value`` as double, and the carried columns."""
    pairs = ", ".join(
        f"named_struct('feature', {sql_text(c)}, 'value', CAST({sql_no_nan(sql_name(c), df.schema[c].dataType)} AS DOUBLE))"
        for c in columns
    )
    return df.selectExpr(*map(sql_name, carry), f"inline(array({pairs}))")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column over its present values, as rows ``feature, median``.

    Values are counted per distinct value and the counts added up in order, so no
    task holds a whole column.
    """
    counts = long_values(df, columns).dropna(subset=["value"]).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = running_sums(counts, ["value"], ["n"], ["feature"])
    first, upto, total = F.col("n_upto") - F.col("n"), F.col("n_upto"), F.col("n_total")

    def holds(position):  # whether the value covers a 1-based position
        return (first < position) & (upto >= position)

    low = F.max(F.when(holds(F.floor((total + 1) / 2)), F.col("value")))
    high = F.max(F.when(holds(F.floor(total / 2) + 1), F.col("value")))
    return steps.groupBy("feature").agg(((low + high) / 2.0).alias("median"))


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians by column name: one number per column. Columns without values are absent."""
    return {row["feature"]: row["median"] for row in medians(df, columns).collect()}


def impute(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Replace missing values by the given numbers, all in one projection."""
    return df.select(
        *[
            F.coalesce(no_nan(quoted(f.name).cast("double"), f.dataType), F.lit(float(fills[f.name]))).alias(f.name)
            if f.name in fills
            else quoted(f.name)
            for f in df.schema
        ]
    )


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return impute(df, median_values(df, columns))


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dictionary of several columns, as rows ``column, text, n, code``: distinct texts in alphabetical order."""
    pairs = ", ".join(f"named_struct('column', {sql_text(c)}, 'text', {sql_category(sql_name(c))})" for c in columns)
    return distinct_ranks(df.selectExpr(f"inline(array({pairs}))"), "text", ["column"])


def hot_texts(codes: DataFrame, task_rows: int = TASK_ROWS) -> dict[str, list[tuple[int, int]]]:
    """What ``hot_keys`` gives for each column, read off its dictionary."""
    seen = {
        row["column"]: (row["total"], even_share(codes, row["total"], task_rows), row["most"])
        for row in codes.groupBy("column").agg(F.sum("n").alias("total"), F.max("n").alias("most")).collect()
    }
    out: dict[str, list[tuple[int, int]]] = {column: [] for column in seen}
    for column, (total, even, most) in seen.items():
        if most > even:
            hot = codes.filter((F.col("column") == column) & (F.col("n") > even)).select(F.xxhash64("text"), "n")
            out[column] = [(number, pieces(codes, n, total)) for number, n in hot.collect()]
    return out


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_code", task_rows: int = TASK_ROWS) -> DataFrame:
    """Add alphabetical codes; a missing value has its own code.

    The dictionary stays a table and is joined, whatever its size. One of few bytes is sent to
    every task, so that wide rows are not moved to the few texts they share; else a text that
    most rows share is spread over the tasks of the join.
    """
    if not columns:
        return df
    codes = category_codes(df, columns)
    size = codes.groupBy("column").agg(F.sum(F.octet_length("text") + 16).alias("bytes"))
    sent = {row["column"] for row in size.collect() if row["bytes"] <= SENT_BYTES}  # one row per column
    hot = hot_texts(codes.filter(~F.col("column").isin(*sent)) if sent else codes, task_rows)
    for column in columns:
        text = f"_{column}_text"
        side = codes.filter(F.col("column") == column).select(F.col("text").alias(text), F.col("code").alias(column + suffix))
        df = df.withColumn(text, category_text(quoted(column)))
        if column in sent:
            df = df.join(F.broadcast(side), text, "left").drop(text)
        else:
            df = left_join_all(df, [side], [text], hot.get(column, [])).drop(text)
    return df


def category_list(df: DataFrame, column: str, limit: int) -> list[str]:
    """Distinct texts of a column, refused above ``limit``: one output column each."""
    found = df.select(category_text(quoted(column)).alias("v")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise PlanError(f"{column!r} has more than {limit} categories; encode it with label_encode")
    return sorted(row["v"] for row in found)


def one_hot(
    df: DataFrame, columns: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None, limit: int = 200
) -> DataFrame:
    """0/1 columns ``<column>_<category>``. Values outside ``categories`` give all zeros."""
    categories = categories or {c: category_list(df, c, limit) for c in columns}
    flags = [
        F.when(category_text(quoted(c)) == v, 1).otherwise(0).alias(f"{c}_{clean_name(v)}")
        for c in columns
        for v in categories[c]
    ]
    names = [c for c in df.columns if c not in set(columns)]
    return df.select(*[quoted(c) for c in names], *flags)


def mixed_encode(
    df: DataFrame,
    categorical: Sequence[str],
    drop: Iterable[str] = (),
    fill: float = MISSING_NUMBER,
    limit: int = 200,
) -> DataFrame:
    """Numbers with missing ones as ``fill``, 0/1 columns for categories, the rest dropped.

    Missing categories get no column of their own and are all zeros.
    """
    dropped = set(drop)
    categorical = [c for c in categorical if c not in dropped]
    kept = [c for c in df.columns if c not in dropped]
    numbers = [c for c in kept if c not in categorical]
    levels = {c: [v for v in category_list(df, c, limit) if v != MISSING_TEXT] for c in categorical}
    out = df.select(
        *[F.coalesce(to_number(quoted(c)), F.lit(float(fill))).alias(c) for c in numbers],
        *[quoted(c) for c in categorical],
    )
    return one_hot(out, categorical, levels)


def log_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``log1p_<column>``."""
    return df.withColumns({f"log1p_{c}": safe_log1p(quoted(c)) for c in columns})


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``z_<column>``: distance from the mean in standard deviations, from one aggregate.

    The statistics are two numbers per column and enter the plan as constants.
    """
    values = {c: no_nan(quoted(c).cast("double"), df.schema[c].dataType) for c in columns}
    row = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values.values())],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values.values())],
    ).first()
    scaled = {}
    for i, (c, v) in enumerate(values.items()):
        mean, sd = row[f"m{i}"], row[f"s{i}"]
        scaled[f"z_{c}"] = (v - F.lit(mean)) / F.lit(sd) if sd else v - F.lit(mean)
    return df.withColumns(scaled)


def split_kinds(df: DataFrame, skip: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns, in order."""
    banned = set(skip)
    numeric = [f.name for f in df.schema if f.name not in banned and is_numeric(f.dataType)]
    categorical = [f.name for f in df.schema if f.name not in banned and not is_numeric(f.dataType)]
    return numeric, categorical


def categories_as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categorical columns as text, missing ones as a category of their own."""
    chosen = set(columns)
    return df.select(*[category_text(quoted(c)).alias(c) if c in chosen else quoted(c) for c in df.columns])
