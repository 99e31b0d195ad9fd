"""Registration of queries and the bindings of the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans.spec import MainSpec, Relationship

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


def registry() -> tuple[dict[str, Query], Callable]:
    found: dict[str, Query] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(build: Build) -> Build:
            found[name or build.__name__] = Query(build, sql)
            return build

        return add

    return found, query


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Customers with their orders and nation.
CUSTOMER_AS_OF = "2001-08-01"
CUSTOMER = MainSpec("customer", "c_custkey")
ORDERS = Relationship("orders", "o_custkey", "c_custkey", time_column="o_orderdate")
NATION = Relationship("nation", "n_nationkey", "c_nationkey", unique=True)

# Orders with their lines; the label is a finished order.
ORDER_AS_OF = "2001-11-04"
ORDER = MainSpec("orders", "o_orderkey", "is_f")
LINES = Relationship("lineitem", "l_orderkey", "o_orderkey", time_column="l_shipdate")

# Labelled documents with their text.
LABEL = MainSpec("labels", "doc_id", "quality")
DOCUMENTS = Relationship("documents", "doc_id", "doc_id", unique=True)

# Users with their events.
EVENT_AS_OF = "2024-01-31"
USER = MainSpec("users", "user_id")
EVENTS = Relationship("events", "user_id", "user_id", time_column="ts")


def customer_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: read(spark, sf, n) for n in ("customer", "orders", "nation")}


def order_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders = read(spark, sf, "orders").withColumn("is_f", (F.col("o_orderstatus") == "F").cast("int"))
    return {"orders": orders, "lineitem": read(spark, sf, "lineitem")}


def document_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: read(spark, sf, n) for n in ("labels", "documents")}


def event_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    events = read(spark, sf, "events")
    return {"users": events.select("user_id").distinct(), "events": events}


def exact(x: str, scale: int = 2, agg: str = "sum") -> str:
    """SQL for a sum (or average) that does not depend on the order of addition."""
    total = f"sum(cast({x} as decimal(18,{scale})))::double"
    return total if agg == "sum" else f"{total} / count({x})"


def within(time: str, as_of: str, days: int) -> str:
    """SQL for a row at most ``days`` before the sample date."""
    return f"({time} >= date '{as_of}' - interval {days} day and {time} < date '{as_of}' + interval 1 day)"
