"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source has a target number of words. Complete epochs (target / size, rounded down) take every
document; the rest is filled by sampling without replacement: a document's key is ``-ln(u) / w``
with ``u`` from a hash of its id and ``w`` its quality weight, and documents are taken in order of
the key until their running number of words is nearest the rest. Only the hash bucket of each
source in which the rest runs out is ever sorted; every other row is decided by comparing its key.

Defined cases: null text counts no words; a null source is a source, last in order; rows with one
id draw one key and are taken together; unlabelled documents weigh 1; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored, unwrapped, wrapped

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
# Key ranges of a source; the sorted one holds about this share of it.
BUCKETS = 4096


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw_of(key: str, weight: Column, seed: int) -> Column:
    """The exponential draw of a row: smaller comes first, heavier rows draw smaller."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((number + F.lit(0.5)) / F.lit(float(16**13))) / weight


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``target`` of each row of ``sizes`` (source, source_size), one row per source.

    The words of all sources are shared by weight; a target stops at ``most`` times its source's
    size, and what it can't take is shared again by weight. With sources in order of size per
    weight those that stop come first, so one running sum finds the level.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1))
    limit = F.col("source_size") * F.lit(most)
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(limit / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    leveled = weighed.withColumn("_level", left / weight_left).withColumn("_full", limit / F.col("_w") <= F.col("_level"))
    level = F.max(F.when(~F.col("_full") & F.col("_first"), F.col("_level"))).over(everything)
    first = F.coalesce(F.lag("_full").over(by_ratio), F.lit(True))
    return leveled.withColumn("_first", first).withColumn(
        "target", F.when(F.col("_full"), limit.cast("double")).otherwise(level * F.col("_w"))
    ).drop("_w", "_level", "_full", "_first")


def sampling_plan(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Per source: target, size, complete epochs, and the bucket and draw up to which documents are taken once more.

    ``rows`` has source, size and draw.
    """
    rows = rows.withColumn("_b", bucket())
    in_bucket = rows.groupBy("source", "_b").agg(F.sum("size").alias("_in"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = target.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    edges = (
        in_bucket.withColumn("_upto", F.sum("_in").over(upto))
        .join(epochs.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .where("_upto > _rest")
        .groupBy("source")
        .agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_in")).alias("_before"), "_rest")).alias("_e"))
        .select("source", F.col("_e._b").alias("edge"), F.col("_e._before").alias("_before"), F.col("_e._rest").alias("_rest"))
    )
    inside = rows.join(
        edges.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("edge"))
    )
    drawn = inside.groupBy("source", "draw").agg(
        F.sum("size").alias("_in"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest")
    )
    running = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        drawn.withColumn("_upto", F.sum("_in").over(running) + F.col("_before"))
        .where("2 * _upto - _in < 2 * _rest")
        .groupBy("source")
        .agg(F.max("draw").alias("last_draw"))
    )
    return (
        epochs.drop("_rest")
        .join(edges.select(F.col("source").alias("_s1"), "edge"), F.col("source").eqNullSafe(F.col("_s1")), "left")
        .join(last.select(F.col("source").alias("_s2"), "last_draw"), F.col("source").eqNullSafe(F.col("_s2")), "left")
        .select("source", "source_size", "target", "epochs", "edge", "last_draw")
    )


def bucket(draw: str = "draw") -> Column:
    return F.floor((F.lit(1.0) - F.exp(-F.col(draw))) * F.lit(BUCKETS)).cast("int")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, draw and more) with source_size, target, copies and taken."""
    beside = plan.withColumnRenamed("source", "_s")
    # A source without an edge is taken whole, or holds no words.
    again = F.when(F.col("edge").isNull(), F.lit(False)).otherwise(
        (bucket() < F.col("edge")) | F.coalesce(F.col("draw") <= F.col("last_draw"), F.lit(False))
    )
    joined = rows.join(beside, F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("copies", (F.col("epochs") + again.cast("int")).cast("int")).withColumn(
        "taken", F.col("copies") * F.col("size")
    ).drop("_s", "epochs", "edge", "last_draw")


def quality_weights(labels: DataFrame) -> DataFrame:
    """One weight per labelled document."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.lit(1.0)
    for value, w in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("q") == value, F.lit(w)).otherwise(weight)
    return best.select(F.col("doc_id").alias("_labelled"), weight.alias("_weight"))


def mix_sources(
    documents: DataFrame,
    labels: DataFrame | None = None,
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (key, source, size, draw) of all documents, and the plan per source.

    ``with_copies`` applies the plan to these rows, or to any rows with source, size and draw.
    """
    narrow = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_in().alias("size"))
    narrow = stored(drawn(narrow, labels, seed), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    return narrow, stored(sampling_plan(narrow, targets(sizes, weights)), "plan")


def drawn(rows: DataFrame, labels: DataFrame | None, seed: int = 7) -> DataFrame:
    if labels is None:
        return rows.withColumn("draw", draw_of("doc_id", F.lit(1.0), seed))
    joined = rows.join(quality_weights(labels), F.col("doc_id") == F.col("_labelled"), "left")
    weight = F.coalesce(F.col("_weight"), F.lit(1.0))
    return joined.withColumn("draw", draw_of("doc_id", weight, seed)).drop("_labelled", "_weight")


def apply_mix(documents: DataFrame, labels: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it, with its own columns."""
    _, plan = mix_sources(documents, labels, weights=weights, seed=seed)
    rows = wrapped(documents, "doc_id", "source", "text").withColumn("size", words_in()).drop("text")
    copied = with_copies(drawn(rows, labels, seed), plan).where("copies > 0")
    repeated = copied.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unwrapped(repeated, documents.columns)
