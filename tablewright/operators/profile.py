"""Facts about tables: relation cardinality, coverage, schema against configuration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import is_key_like, quoted, sql_name, sql_no_nan, sql_text, type_class

# Share of distinct keys above which a table is a snapshot. Fixed value.
SNAPSHOT_SHARE = 0.95


def relation_cardinality(
    aux: DataFrame, key: Sequence[str], relation: str, threshold: float = SNAPSHOT_SHARE, approx: bool = False
) -> DataFrame:
    """Rows, distinct keys, their share and the kind of relation, as one row."""
    if approx:
        distinct = F.approx_count_distinct(F.struct(*[quoted(k) for k in key]))
    else:
        distinct = F.countDistinct(*[quoted(k) for k in key])
    counted = aux.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_keys"))
    share = F.coalesce(F.col("n_keys") / F.nullif(F.col("n_rows"), F.lit(0)), F.lit(0.0))
    return counted.select(
        F.lit(relation).alias("relation"),
        "n_rows",
        "n_keys",
        share.alias("uniqueness"),
        F.when(share > threshold, "1:1").otherwise("1:N").alias("kind"),
    )


def is_snapshot(aux: DataFrame, key: Sequence[str], threshold: float = SNAPSHOT_SHARE, approx: bool = False) -> bool:
    return relation_cardinality(aux, key, "", threshold, approx).first()["kind"] == "1:1"


def column_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Present values per column, all counted in one pass, as rows ``feature, non_null, keep``."""
    columns = list(columns or df.columns)
    counts = df.selectExpr(
        *[f"count({sql_no_nan(sql_name(c), df.schema[c].dataType)}) AS _{i}" for i, c in enumerate(columns)]
    )
    pairs = ", ".join(f"named_struct('feature', {sql_text(c)}, 'non_null', _{i})" for i, c in enumerate(columns))
    return counts.selectExpr(f"inline(array({pairs}))").withColumn("keep", (F.col("non_null") > 0).cast("int"))


def drop_empty_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Without the columns that hold no value. For training only: scoring never drops columns."""
    empty = [row["feature"] for row in column_coverage(df, columns).filter("keep = 0").collect()]
    return df.drop(*empty)


def candidate_columns(df: DataFrame, key: Sequence[str], label: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Columns that may become features: no key, label, excluded or id-like column."""
    banned = {*key, *exclude, *([label] if label else [])}
    return [c for c in df.columns if c not in banned and not is_key_like(c)]


def baseline_matrix(df: DataFrame, label: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Every column but the excluded ones, the label last."""
    banned = {label, *exclude}
    return df.select(*[quoted(c) for c in df.columns if c not in banned], quoted(label))


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table, position, column, type and class of type: one row per column."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), type_class(f.dataType))
        for table, df in sorted(tables.items())
        for i, f in enumerate(df.schema)
    ]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, kind string")


def reconcile(
    spark: SparkSession, declared: Mapping[str, Sequence[str]], tables: Mapping[str, DataFrame], autofill: bool = False
) -> DataFrame:
    """Declared against actual columns, with how many values each actual column holds.

    ``status``: ``matched``, ``only_config``, ``only_data`` or, with ``autofill``,
    ``added`` for an undeclared column of a declared table.
    """
    names = [(t, c) for t, cols in declared.items() for c in cols]
    config = spark.createDataFrame(names, "table string, column string").withColumn("_config", F.lit(1))
    profile = None
    for table, df in tables.items():
        part = column_coverage(df).select(F.lit(table).alias("table"), F.col("feature").alias("column"), "non_null")
        profile = part if profile is None else profile.unionByName(part)
    status = F.when(F.col("_config").isNull(), "only_data").when(F.col("_data").isNull(), "only_config").otherwise("matched")
    if autofill:
        status = F.when(F.col("_config").isNull() & F.col("table").isin(list(declared)), "added").otherwise(status)
    return (
        config.join(profile.withColumn("_data", F.lit(1)), ["table", "column"], "full")
        .select("table", "column", status.alias("status"), F.coalesce("non_null", F.lit(0)).alias("non_null"))
    )


def logical_view(df: DataFrame, renames: Mapping[str, str], exclude: Iterable[str] = ()) -> DataFrame:
    """A table under its standard column names, without the excluded columns."""
    unknown = [c for c in renames if c not in df.columns]
    if unknown:
        raise ValueError(f"no columns {unknown} to rename")
    return df.drop(*exclude).withColumnsRenamed(dict(renames))
