"""Tables by name from Parquet folders, the catalog or JDBC."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.plans.spec import PlanError, Relationship, as_tuple
from tablewright.sources.csv import clean_columns

# Most keys of a limited main table that are sent to every task.
MAX_SENT_KEYS = 1_000_000

Source = Callable[[str], DataFrame]


def parquet_source(spark: SparkSession, folder: str) -> Source:
    return lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def catalog_source(spark: SparkSession) -> Source:
    return lambda name: spark.table(name)


def jdbc_source(spark: SparkSession, url: str, **options: str) -> Source:
    """Tables of a database. Filters, columns and limits are pushed into its queries.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    to read a table in parallel ranges.
    """
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_table(
    source: Source,
    name: str,
    columns: Sequence[str] | None = None,
    where: str | None = None,
    limit: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """A table with projection, condition and row limit. ``order_by`` makes the limit repeatable."""
    df = source(name)
    if where:
        df = df.filter(F.expr(where))
    if columns:
        df = df.select(*[quoted(c) for c in columns])
    if limit is not None:
        df = (df.orderBy(*[quoted(c) for c in order_by]) if order_by else df).limit(limit)
    return clean_columns(df)


def split_names(names: str | Iterable[str] | None) -> list[str]:
    """Names from a list or a comma-separated text."""
    if names is None:
        return []
    parts = names.split(",") if isinstance(names, str) else names
    return [p.strip() for p in parts if p.strip()]


def read_tables(
    source: Source,
    main: str,
    aux: str | Iterable[str] | None = None,
    where: Mapping[str, str] | str | None = None,
    limit: int | None = None,
    relationships: Iterable[Relationship] = (),
    order_by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Main and related tables.

    A limit applies to the main table only; related tables keep exactly the rows
    that belong to the samples kept. Limiting each table on its own would leave
    samples without their rows.
    """
    conditions = (lambda t: where) if isinstance(where, str) else (lambda t: (where or {}).get(t))
    out = {main: read_table(source, main, where=conditions(main), limit=limit, order_by=order_by)}
    rels = {r.table: r for r in relationships}
    for name in split_names(aux):
        df = read_table(source, name, where=conditions(name))
        if limit is not None:
            if name not in rels:
                raise PlanError(f"a limit needs the relationship of {name!r} to {main!r}")
            rel = rels[name]
            kept = out[main].select(*[quoted(m).alias(k) for k, m in zip(rel.key, rel.main_key)]).distinct()
            # The limit bounds the keys; sent to the rows, no key is too hot.
            kept = F.broadcast(kept) if limit <= MAX_SENT_KEYS else kept
            df = df.join(kept, list(as_tuple(rel.key)), "left_semi")
        out[name] = df
    return out


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def table_schema(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]


def sample_rows(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> list[dict]:
    """The first rows in a declared order, for inspection."""
    ordered = df.orderBy(*[quoted(c) for c in order_by]) if order_by else df
    return [row.asDict() for row in ordered.limit(n).collect()]
