"""What several operators share: words, shingles, tables in the shared folder, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path

SHINGLE = 5
SIMILARITY = 0.75
# Bytes of input that one task of an exchange is meant to hold.
TASK_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later steps see the same rows however often they or lost executors come back to them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame) -> int:
    """Number of parts of an exchange: the session's setting, more if the files read ask for it.

    Leaves that are no files have no size and don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    by_size = math.ceil(sum(x for x in sizes if x < 1 << 60) / TASK_BYTES)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but space and tab to carriage return, A-Z lower-cased (``bytes`` methods know ASCII only)."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIERS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of five words, in order; of the whole sequence if it is shorter; nothing without words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * MULTIPLIERS[i]
    return mix(total)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The bytes of a string or binary column."""
    return column.cast(pa.large_binary()).to_pylist()


def batches(columns: dict[str, tuple[list | np.ndarray, pa.DataType]], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows from whole columns."""
    names = list(columns)
    arrays = [pa.array(values, kind) for values, kind in columns.values()]
    for start in range(0, len(arrays[0]), rows):
        yield pa.RecordBatch.from_arrays([a.slice(start, rows) for a in arrays], names)


def wrapped(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns and the whole row as ``_row``: whatever a step adds can't clash with the row's own names."""
    return df.select(*[F.col(c) for c in columns], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unwrapped(df: DataFrame, names: list[str], **changed: str) -> DataFrame:
    """The rows again, columns in ``changed`` taken from beside them."""
    row = F.col("_row")
    return df.select(*[(F.col(changed[c]) if c in changed else row.getField(c)).alias(c) for c in names])


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): for every node of ``edges`` the smallest node reachable.

    Alternates joining all larger neighbours of a node, then all smaller ones, to its smallest
    neighbour until nothing changes. Every step is an aggregate and a join that adaptive execution
    can split; no node's neighbours are collected.
    """
    now = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )

