"""Column helpers that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that stands for a missing category, and the number for a missing value
# in the mixed encoding. Fixed values.
MISSING_TEXT = "__missing__"
MISSING_NUMBER = -99.0

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def sql_name(name: str) -> str:
    """A column's literal name in SQL text, also when it holds dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A text constant in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """A column by its literal name."""
    return F.col(sql_name(name))


def type_class(dtype: T.DataType) -> str:
    """integer, number, datetime or string."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def no_nan(col: Column, dtype: T.DataType) -> Column:
    """NaN counts as missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(dtype))
    return col


def nan_as_null(df: DataFrame) -> DataFrame:
    return df.select(*[no_nan(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])


def sql_no_nan(text: str, dtype: T.DataType) -> str:
    """SQL for a value whose NaN counts as missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"nanvl({text}, CAST(NULL AS {dtype.simpleString()}))"
    return text


def sql_category(text: str) -> str:
    """SQL for a category's text, with a text of its own where it is missing."""
    return f"coalesce(CAST({text} AS STRING), {sql_text(MISSING_TEXT)})"


def to_number(col: Column) -> Column:
    """Double, or null where the text is not a number."""
    return F.nanvl(col.cast("string").try_cast("double"), F.lit(None).cast("double"))


def category_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(MISSING_TEXT))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def safe_log1p(col: Column) -> Column:
    """log(1 + x), null for x <= -1."""
    x = col.cast("double")
    return F.when(x > -1, F.log1p(x))


def key_hash(keys: Iterable[str], *salts: object) -> Column:
    """md5 of the key and the salts, the same on every engine and partitioning."""
    parts = [F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, *[F.lit(str(s)) for s in salts]))


def sql_whole(text: str, scale: int) -> str:
    """SQL for a value with ``scale`` decimals as a whole number of its smallest unit."""
    return f"CAST(rint(CAST({text} AS DOUBLE) * {10**scale}.0D) AS BIGINT)"


def sql_exact_sum(text: str, scale: int) -> str:
    """SQL for a sum of values with ``scale`` decimals, kept as whole numbers while adding.

    The result does not depend on the order in which partitions are combined.
    """
    return f"(sum({sql_whole(text, scale)}) / {10**scale}.0D)"


def bands(value: Column, limits: Sequence[tuple[float, str]], below: str) -> Column:
    """The label of the highest limit that ``value`` exceeds, ``below`` under all of them."""
    ordered = sorted(limits, reverse=True)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in ordered:
        out = out.when(value > limit, F.lit(label))
    return out.otherwise(F.lit(below))


def is_key_like(name: str) -> bool:
    """Whether ``id`` is a word of the name, between underscores or its ends."""
    return "id" in name.lower().split("_")
