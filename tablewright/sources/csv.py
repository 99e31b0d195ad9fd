"""CSV folders: one table per file, encoding and quoting found from all lines, the separator from the header."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.plans.spec import PlanError, clean_name

log = logging.getLogger(__name__)

# Encodings tried in turn and separators considered; the first separator wins
# unless another is more frequent in the header. Fixed values.
ENCODINGS = ("utf-8", "gbk")
SEPARATORS = (",", "$", "\t", "|", ";")


def clean_columns(df: DataFrame) -> DataFrame:
    """Columns under clean names; two names that become one raise."""
    names = [clean_name(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise PlanError(f"columns {df.columns} collide after cleaning: {repeated}")
    return df.toDF(*names)


def sniff_separator(header: str) -> str:
    """The most frequent candidate in the header; the comma wins ties."""
    return max(SEPARATORS, key=lambda s: (header.count(s), s == SEPARATORS[0]))


def read_header(spark: SparkSession, path: str) -> bytes:
    """The first line of a file or of the first part that has one, as bytes."""
    lines = spark.read.text(path).filter("_metadata.file_block_start = 0 and length(value) > 0")
    row = lines.select(F.col("value").cast("binary").alias("line")).first()
    return bytes(row["line"]) if row else b""


def look_through(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether every line is UTF-8, and whether a quoted value runs over a line break: one pass over all bytes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False))
    ).first()
    return row[0], row[1]


def csv_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Table name to path: ``name.csv`` may be a file or a folder of parts."""
    root = path.rstrip("/")
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    # What follows the folder's own name: "orders.csv" or "orders.csv/part-0.csv".
    tail = F.substring_index(F.col("path"), "/" + root.rsplit("/", 1)[-1] + "/", -1)
    entry = F.substring_index(tail, "/", 1)
    found = listed.select(entry.alias("entry")).distinct().orderBy("entry").collect()
    return {r["entry"].removesuffix(".csv"): f"{root}/{r['entry']}" for r in found}


def read_csv_table(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    sep: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """One CSV table, quotes within quotes doubled. Without a schema Spark infers types in an extra pass.

    Without ``encoding`` and ``multi_line`` all lines are looked at first. Files in which a quoted
    value holds a line break can't be split over tasks; others are.
    """
    if encoding is None or multi_line is None:
        utf8, broken = look_through(spark, path)
        encoding = encoding or ENCODINGS[0 if utf8 else 1]
        multi_line = broken if multi_line is None else multi_line
    sep = sep or sniff_separator(read_header(spark, path).decode(encoding, errors="ignore"))
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1"):
        # Spark reads only a few charsets unless told otherwise; lasting, as the frame is read later.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    options = {"header": "true", "sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return clean_columns(reader.csv(path))


def read_csv_tables(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    sep: str | None = None,
    schemas: Mapping[str, T.StructType | str] | None = None,
    skip_unreadable: bool = False,
) -> dict[str, DataFrame]:
    """Every CSV table of a folder by name. An unreadable one raises, or is skipped with a warning if asked."""
    out: dict[str, DataFrame] = {}
    for name, table in csv_files(spark, path).items():
        try:
            out[name] = read_csv_table(spark, table, encoding, sep, (schemas or {}).get(name))
        except PySparkException as problem:
            if not skip_unreadable:
                raise PlanError(f"cannot read {table}: {problem}") from problem
            log.warning("skipped %s: %s", table, str(problem).split("\n", 1)[0])
    if not out:
        raise PlanError(f"no readable CSV file in {path}")
    return out
