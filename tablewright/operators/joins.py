"""Left joins of one-row-per-key frames to the sample table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import quoted
from tablewright.plans.spec import PlanError


# Rows of one key that a single task handles without trouble.
TASK_ROWS = 10_000_000
# Pieces an even share of a hot key is cut into, so that pieces that meet in one
# task do not add up to much.
PIECES = 4
SALT = "_salt"


def not_null(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key has no null part; only these can match."""
    return df.filter(reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in key]))


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    """Raise when a non-null key occurs twice. Shuffles the key columns only."""
    keys = not_null(df.select(*[quoted(k) for k in key]), key)
    repeated = keys.groupBy(*key).count().filter(F.col("count") > 1).head(1)
    if repeated:
        raise PlanError(f"{what}: key {tuple(repeated[0])[:-1]} occurs {repeated[0]['count']} times")


def latest_per_key(
    df: DataFrame, key: Sequence[str], order_by: Sequence[str], values: dict[str, str], predicate: str | None = None
) -> DataFrame:
    """The values of the row with the greatest ``order_by`` in every key, of the rows that ``predicate`` selects.

    ``values`` maps output names to SQL of a row's value. One struct maximum carries all of
    them, so each map task sends one row per key whatever the size of a key.
    """
    row = F.struct(
        *[quoted(c).alias(f"o{i}") for i, c in enumerate(order_by)],
        *[F.expr(text).alias(name) for name, text in values.items()],
    )
    picked = F.max(F.when(F.expr(predicate), row) if predicate else row)
    return (
        df.groupBy(*key).agg(picked.alias("_row")).select(*key, *[F.col("_row").getField(n).alias(n) for n in values])
    )


def _key_number(key: Sequence[str], types: Mapping[str, T.DataType]) -> Column:
    """A hash of the key, equal for equal keys of either side of a join. Nulls hash like values."""
    return F.xxhash64(*[quoted(k).try_cast(types[k]) for k in key])


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: Sequence[str], task_rows: int = TASK_ROWS) -> list[tuple[int, int]]:
    """Keys that hold more than an even share of the rows, as (hash, pieces to split it into).

    Fewer keys than a shuffle has partitions, and at most ``PIECES + 1`` pieces per
    partition in all. Counts are combined on the map side: a hot key costs one
    row per task. A key of at most ``task_rows`` rows is never hot.
    """
    types = {k: df.schema[k].dataType for k in key}
    counts = df.groupBy(_key_number(key, types).alias("_hash")).count()
    seen = counts.agg(F.sum("count").alias("total"), F.max("count").alias("most")).first()
    even = even_share(df, seen["total"] or 0, task_rows)
    if (seen["most"] or 0) <= even:
        return []
    found = counts.filter(F.col("count") > even).collect()
    return [(row["_hash"], pieces(df, row["count"], seen["total"])) for row in found]


def even_share(df: DataFrame, total: int, task_rows: int = TASK_ROWS) -> float:
    """Rows of a key above which it is hot."""
    return max(total / shuffle_parts(df), task_rows)


def pieces(df: DataFrame, count: int, total: int) -> int:
    return -(-count * shuffle_parts(df) * PIECES // total)


def left_join_all(
    main: DataFrame,
    sides: Sequence[DataFrame],
    on: Sequence[str],
    hot: Sequence[tuple[int, int]] = (),
    null_safe: bool = False,
) -> DataFrame:
    """``main LEFT JOIN`` several frames with one row per key.

    With ``hot`` (from ``hot_keys``) the rows of a hot or often-null key are
    numbered by a hash of the row and go to several tasks, and the one side row
    they need is repeated for each number. The result equals the plain join. All
    joins share the key and the number, so ``main`` is shuffled once.
    """
    on, keys = list(on), list(on)
    if hot:
        keys.append(SALT)
        types = {k: main.schema[k].dataType for k in on}
        # Fewer rows than a shuffle has partitions.
        small = F.broadcast(main.sparkSession.createDataFrame(list(hot), "_hash long, _pieces int"))
        number = F.pmod(F.xxhash64(*[quoted(c) for c in main.columns]), F.col("_pieces")).cast("int")
        main = (
            main.withColumn("_hash", _key_number(on, types))
            .join(small, "_hash", "left")
            .withColumn(SALT, F.coalesce(number, F.lit(0)))
            .drop("_hash", "_pieces")
        )
    for side in sides:
        if hot:
            repeats = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
            side = (
                side.withColumn("_hash", _key_number(on, types))
                .join(small, "_hash", "left")
                .withColumn(SALT, F.explode(repeats))
                .drop("_hash", "_pieces")
            )
        if not null_safe:
            main = main.join(side, keys, "left")
            continue
        side = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
        same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"_side_{k}")) for k in keys])
        main = main.join(side, same, "left").drop(*[f"_side_{k}" for k in keys])
    return main.drop(SALT)


def group_feature(
    df: DataFrame, by: Sequence[str], name: str, aggregate: Column, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Attach an aggregate over the rows that share ``by`` to each of them.

    Aggregated first and joined back rather than windowed: a window would put
    all rows of a group into one task. Null group values form a group.
    """
    side = df.groupBy(*[quoted(c) for c in by]).agg(aggregate.alias(name))
    return left_join_all(df, [side], by, hot_keys(df, by, task_rows), null_safe=True)


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, relation: str) -> DataFrame:
    """How many child rows and keys have no parent. Both sides are reduced to their keys before the join."""
    keys = child.filter(quoted(child_key).isNotNull()).groupBy(quoted(child_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    lost = keys.join(parent.select(quoted(parent_key).alias("_key")).distinct(), "_key", "left_anti")
    return lost.agg(
        F.lit(relation).alias("relation"),
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"),
    )
