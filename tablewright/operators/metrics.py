"""Ranking metrics from counts per distinct score."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import key_hash, no_nan, quoted
from tablewright.operators.running import running_sums

# Threshold reported when no score separates the classes. Fixed value.
NEUTRAL_THRESHOLD = 0.5


def score_counts(
    scored: DataFrame, label: str, score: str, group: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per distinct score. Combined before the shuffle."""
    value = no_nan(quoted(score).cast("double"), scored.schema[score].dataType)
    rows = scored.select(
        *[quoted(g) for g in group],
        value.alias("score"),
        quoted(label).alias("_y"),
        (F.lit(1) if weight is None else weight).alias("_w"),
    )
    return class_counts(rows.filter(F.col("score").isNotNull()), [*group, "score"])


def class_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of ``_w`` per class of ``_y`` (0 or 1), as ``pos`` and ``neg``."""
    y, w = F.col("_y"), F.col("_w")
    return (
        rows.filter(y.isin(0, 1))
        .groupBy(*by)
        .agg(F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, w).otherwise(0)).alias("neg"))
        .filter(F.col("pos") + F.col("neg") > 0)
    )


def score_steps(
    scored: DataFrame, label: str, score: str, group: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """``score_counts`` with running and total counts in ascending order of score."""
    return running_sums(score_counts(scored, label, score, group, weight), ["score"], ["pos", "neg"], group)


def auc_columns() -> list[Column]:
    pos, neg = F.max("pos_total"), F.max("neg_total")
    # A positive wins against every lower negative and half against an equal one.
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg").cast("double") / 2.0))
    pairs = pos.cast("double") * neg.cast("double")
    return [pos.alias("n_pos"), neg.alias("n_neg"), (wins / F.nullif(pairs, F.lit(0.0))).alias("auc")]


def auc(
    scored: DataFrame, label: str, score: str, group: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Exact ROC AUC per group; null when a class is absent."""
    return score_steps(scored, label, score, group, weight).groupBy(*group).agg(*auc_columns())


def _ks_columns(neutral: float = NEUTRAL_THRESHOLD) -> list[Column]:
    pos_total, neg_total = F.col("pos_total"), F.col("neg_total")
    tp = pos_total - F.col("pos_upto") + F.col("pos")
    fp = neg_total - F.col("neg_upto") + F.col("neg")
    gap = F.abs(
        tp.cast("double") / F.nullif(pos_total.cast("double"), F.lit(0.0))
        - fp.cast("double") / F.nullif(neg_total.cast("double"), F.lit(0.0))
    )
    best = F.max(F.struct(gap.alias("ks"), (-F.col("score")).alias("minus"), tp.alias("tp"), fp.alias("fp")))
    upper = F.col("score") >= neutral
    return [
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
        best.alias("_best"),
        F.coalesce(F.sum(F.when(upper, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(upper, F.col("neg"))), F.lit(0)).alias("_fp"),
    ]


def _ks_result(df: DataFrame, carried: Sequence[str], neutral: float = NEUTRAL_THRESHOLD) -> DataFrame:
    found = F.col("_best.ks") > 0
    tp = F.when(found, F.col("_best.tp")).otherwise(F.col("_tp"))
    fp = F.when(found, F.col("_best.fp")).otherwise(F.col("_fp"))
    return df.select(
        *carried,
        F.coalesce(F.col("_best.ks"), F.lit(0.0)).alias("ks"),
        F.when(found, -F.col("_best.minus")).otherwise(F.lit(neutral)).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (F.col("n_neg") - fp).alias("tn"),
        (F.col("n_pos") - tp).alias("fn"),
    )


def ks(scored: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the classes' shares at or above a score.

    The threshold is the smallest score that reaches the gap, and the confusion
    counts are those of ``score >= threshold``: all come from the same running
    counts, so the rows are not read again.
    """
    return _ks_result(score_steps(scored, label, score, group).groupBy(*group).agg(*_ks_columns()), group)


def with_rates(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Precision, recall and F1 from confusion counts; 0 where undefined."""

    def share(a: Column, b: Column) -> Column:
        out = F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
        return out if digits is None else F.round(out, digits)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_report(scored: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """AUC, KS, threshold and confusion counts in one pass over the scores."""
    steps = score_steps(scored, label, score, group).groupBy(*group).agg(*auc_columns(), *_ks_columns()[2:])
    return with_rates(_ks_result(steps, [*group, "n_pos", "n_neg", "auc"]))


# Hex digits of the row hash that make up one draw: five draws per hash.
DRAW_DIGITS = 6
DRAWS_PER_HASH = 5


def poisson_limits() -> list[str]:
    """Hex bounds of a uniform draw at which a Poisson(1) variable reaches 1, 2, 3, ..."""
    limits, term, total, k = [], math.exp(-1.0), 0.0, 0
    while True:
        total += term
        bound = math.ceil(total * 16**DRAW_DIGITS)
        if bound >= 16**DRAW_DIGITS:
            return limits
        limits.append(f"{bound:0{DRAW_DIGITS}x}")
        k += 1
        term /= k


def weight_columns(df: DataFrame, key: Sequence[str], carry: Sequence[Column], replicates: int, seed: int) -> DataFrame:
    """Carried columns and ``_w0``, ``_w1``, ...: how often the row enters each resample.

    The weight is Poisson(1) and a function of the key only. Five draws are cut
    from one md5 and compared as text, so nothing is parsed per row.
    """
    hashes = -(-replicates // DRAWS_PER_HASH)
    hashed = df.select(*carry, *[key_hash(key, seed, h).alias(f"_h{h}") for h in range(hashes)])

    def weight(r: int) -> Column:
        draw = F.substring(f"_h{r // DRAWS_PER_HASH}", 1 + DRAW_DIGITS * (r % DRAWS_PER_HASH), DRAW_DIGITS)
        out = F.lit(0)
        for limit in poisson_limits():
            out = out + F.when(draw >= limit, 1).otherwise(0)
        return out.alias(f"_w{r}")

    names = [c for c in hashed.columns if not c.startswith("_h")]
    return hashed.select(*names, *[weight(r) for r in range(replicates)])


def resample_weights(df: DataFrame, key: Sequence[str], carry: Sequence[Column], replicates: int, seed: int) -> DataFrame:
    """``weight_columns`` as one row per row and replicate, with the weight ``w``."""
    wide = weight_columns(df, key, carry, replicates, seed)
    names = [c for c in wide.columns if not c.startswith("_w")]
    pairs = F.array(*[F.struct(F.lit(r).alias("replicate"), F.col(f"_w{r}").alias("w")) for r in range(replicates)])
    return wide.select(*names, F.inline(pairs))


def bootstrap_auc(
    scored: DataFrame, key: Sequence[str], label: str, score: str, replicates: int = 5, seed: int = 42
) -> DataFrame:
    """AUC of each resample. Rows are weighted, not drawn, so no row has to be found by number.

    All resamples are summed per score side by side, so no row is repeated, and
    their running sums are taken over one order.
    """
    value = no_nan(quoted(score).cast("double"), scored.schema[score].dataType)
    rows = weight_columns(scored, key, [quoted(label).alias("_y"), value.alias("score")], replicates, seed)
    rows = rows.filter(F.col("score").isNotNull() & F.col("_y").isin(0, 1))
    sums = [f"{side}{r}" for r in range(replicates) for side in ("pos", "neg")]
    counted = rows.groupBy("score").agg(
        *[F.sum(F.when(F.col("_y") == int(s.startswith("pos")), F.col(f"_w{s[3:]}")).otherwise(0)).alias(s) for s in sums]
    )
    steps = running_sums(counted, ["score"], sums)

    def one(r: int) -> Column:
        pos, neg = F.max(f"pos{r}_total"), F.max(f"neg{r}_total")
        wins = F.sum(F.col(f"pos{r}").cast("double") * (F.col(f"neg{r}_upto") - F.col(f"neg{r}").cast("double") / 2.0))
        pairs = F.nullif(pos.cast("double") * neg.cast("double"), F.lit(0.0))
        return F.struct(F.lit(r).alias("replicate"), pos.alias("n_pos"), neg.alias("n_neg"), (wins / pairs).alias("auc"))

    return steps.agg(F.array(*[one(r) for r in range(replicates)]).alias("_r")).select(F.inline("_r")).filter("n_pos + n_neg > 0")


def auc_spread(replicates: DataFrame) -> DataFrame:
    """Population standard deviation of the resampled AUC."""
    return replicates.agg(
        F.coalesce(F.stddev_pop("auc"), F.lit(0.0)).alias("auc_std"), F.count("auc").alias("replicates")
    )
