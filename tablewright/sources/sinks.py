"""Where results go: predictions, wide tables, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Replace the predictions at ``path``. Each task writes its own part."""
    writer = df.write.mode("overwrite")
    (writer.options(header="true", escape='"') if fmt == "csv" else writer).format(fmt).save(path)


def write_wide_table(
    df: DataFrame,
    path: str | None = None,
    table: str | None = None,
    period: Sequence[str] = (),
    bucket_by: Sequence[str] = (),
    buckets: int = 0,
) -> None:
    """Replace a wide table, as files or as a catalog table.

    With ``period`` only the partitions present in ``df`` are replaced. A catalog
    table bucketed by the key joins later features of that key without a shuffle;
    with both ``table`` and ``path`` its files are kept at the path.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if period:
        writer = writer.partitionBy(*period).option("partitionOverwriteMode", "dynamic")
    if table:
        if buckets:
            writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        (writer.option("path", path) if path else writer).saveAsTable(table)
    elif path:
        writer.save(path)
    else:
        raise ValueError("name a path or a table")


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
